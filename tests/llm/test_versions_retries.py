"""Operator 8: only the digests of shards that do not peel are tried again."""

import pytest
from pyspark.sql import functions as F

from saleslens.llm import versions as v


def test_what_is_tried_again_is_what_the_failed_shards_hold(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: v._marked(F.xxhash64(i))).alias("all"))
    # one crowded shard of four, three with a digest or none
    place = lambda k: k.bitwiseAND(F.lit(3))
    few = lambda at, n: F.slice(F.filter("all", lambda k: place(k) == at), 1, n)
    df = df.select(F.concat(few(0, 1), few(2, 60), few(3, 1)).alias("a"), few(1, 1).alias("b"))
    df, size = v.Size.add(df, F.lit(2), "size")
    difference = v.subtract(v.sketch(F.col("a"), size), v.sketch(F.col("b"), size))
    df = df.withColumn("tried", F.transform(difference, lambda s: F.array_size(v._peeled_shard(s))))
    row = df.select("a", "tried", v.unpeeled("a", "tried", size).alias("more"), v.unpeeled("b", "tried", size).alias("none")).first()
    assert sorted(row.tried, key=str) == [1, 1, 1, None]
    assert row.more == [k for k in row.a if k & 3 == 2] and len(row.more) == 60
    assert row.none == []


@pytest.mark.parametrize("tries", [1, 2, 3])
def test_likeness_is_exact_after_any_number_of_tries(spark, monkeypatch, tries):
    monkeypatch.setattr(v, "TRIES", tries)
    monkeypatch.setattr(v, "SHARD_LOAD", 16)
    marked = lambda low, high: F.transform(F.sequence(F.lit(low), F.lit(high)), lambda i: v._marked(F.xxhash64(i)))
    df = spark.range(1).select(marked(1, 300).alias("a"), marked(200, 700).alias("b"))
    df = v.with_sketch(df, "a")
    got = v.with_likeness(df, "a", "b", "near").first().near
    assert got == pytest.approx(1 - (199 + 400) / (300 + 501))
