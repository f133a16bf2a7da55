"""Helpers of the training-data operators."""

import zlib

from pyspark.sql import functions as F

from saleslens.llm import common


def test_bounded_sample(spark):
    df = spark.range(20_000).select((F.col("id") % 15_000).alias("id"), F.lit("x").alias("sample_hash"))
    some = common.bounded_sample(df, 1_000, F.col("id"))
    ids = [r.id for r in some.collect()]
    assert some.columns == df.columns and 400 < len(ids) <= 1_000 and len(set(ids)) == len(ids)
    assert {r.id for r in common.bounded_sample(df.repartition(7), 1_000, F.col("id")).collect()} == set(ids)
    assert common.bounded_sample(df, 50_000, F.col("id")).count() == 15_000
    assert common.bounded_sample(df.limit(0), 10, F.col("id")).count() == 0


def test_crc_fold(spark):
    got = spark.createDataFrame([(1,), (-20,), (None,)], "i long").select("i", common.crc_fold(F.col("i"), 10).alias("f"))
    assert {(r.i, r.f) for r in got.collect()} == {
        (i, zlib.crc32(("" if i is None else str(i)).encode()) % 10) for i in (1, -20, None)
    }


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2)], "Fp int, fp_1 int")
    assert common.fresh(df, "fp") == "fp_2"
