"""Session construction and the shared folder used for landed tables."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def get_spark(
    master: str | None = None,
    app_name: str = "saleslens",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume.

    AQE stays on so shuffle partitions coalesce and skewed joins split at run
    time; the UI is off because nothing here reads it.
    """
    master = master or os.environ.get("SALESLENS_MASTER", "local[*]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by all executors for landed tables and checkpoints.

    On a cluster this is ``spark.checkpoint.dir`` as configured by the
    cluster. Only a local-mode session with no such setting (tests, local
    benches) gets a fresh scratch folder of its own.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; a cluster run needs a shared folder for landed tables"
        )
    local = tempfile.mkdtemp(prefix="saleslens-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir().rstrip("/")


#: The largest value that Spark takes for a partition count.
SPARK_INT_MAX = (1 << 31) - 1


def size_for_input(
    spark: SparkSession,
    input_bytes: int,
    target_partition_bytes: int = 256 * 1024 * 1024,
) -> int:
    """Set shuffle sizing for an input of ``input_bytes`` and return the partition count.

    The largest shuffle here (the star join) moves at most about the input
    size, so ``input / target`` initial partitions keeps each reduce task near
    ``target`` bytes and within executor memory; AQE then coalesces the small
    post-aggregation shuffles toward the same advisory size and splits skewed
    ones. Scan splits use the same target.
    """
    parts = max(spark.sparkContext.defaultParallelism, min(SPARK_INT_MAX, -(-input_bytes // target_partition_bytes)))
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target_partition_bytes))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(target_partition_bytes))
    return parts


def input_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder on any file system (0 if there is none)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside the block, what a query has shuffled is deleted as soon as the query ends.

    Otherwise it stays on the executors' disks until the driver's garbage
    collector comes by, beside what the next steps write.
    """
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)
