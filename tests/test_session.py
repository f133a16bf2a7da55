"""Session helpers: shared folder and shuffle sizing."""

from saleslens.session import shared_dir, size_for_input


def test_shared_dir_is_stable(spark):
    assert shared_dir(spark) == shared_dir(spark)


def test_size_for_input_scales_with_bytes(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        slots = spark.sparkContext.defaultParallelism
        assert size_for_input(spark, 1024) == slots
        assert size_for_input(spark, 100 * 1024**4) == 100 * 1024**4 // (256 * 1024**2)
        assert spark.conf.get("spark.sql.shuffle.partitions") == str(100 * 1024**4 // (256 * 1024**2))
        assert size_for_input(spark, 10**17) == -(-(10**17) // (256 * 1024**2))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
