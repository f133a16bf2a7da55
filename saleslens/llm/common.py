"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslens.session import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(column, UPPER, LOWER)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_WATCHED: ContextVar[tuple[list[str], ...]] = ContextVar("watched", default=())


@contextmanager
def stored_folders() -> Iterator[list[str]]:
    """The folders that ``through_storage`` writes inside the block, in their order."""
    folders: list[str] = []
    token = _WATCHED.set((*_WATCHED.get(), folders))
    try:
        yield folders
    finally:
        _WATCHED.reset(token)


def delete_folders(spark: SparkSession, folders: Iterable[str]) -> None:
    """Deletes folders of ``through_storage`` that nothing reads any more, on any file system."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def through_storage(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Cuts the lineage for jobs that read an intermediate result many times; a
    lost executor then costs a re-read, never a recomputation. The folder is
    the one the cluster names in ``spark.checkpoint.dir``. Whoever has stored
    what was made from it may delete it: see ``stored_folders``.
    """
    path = f"{shared_dir(df.sparkSession)}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for folders in _WATCHED.get():
        folders.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet (case-insensitive)."""
    taken = {c.lower() for c in df.columns}
    name, i = base, 0
    while name.lower() in taken:
        i += 1
        name = f"{base}_{i}"
    return name


def crc_fold(column: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a null id counts as the empty text (0)."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % F.lit(folds)


def release_memory() -> None:
    """Gives memory that a task has freed back to the system.

    A Python worker lives on after its task, and an executor keeps several;
    Arrow's own pool keeps what its buffers leave, too. On a C library without
    the call only that is given back.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def keep_memory() -> None:
    """Lets a task use the memory of its large arrays again instead of getting new pages for each.

    Until ``release_memory``, which gives back what is free. On a C library
    without the call nothing changes.
    """
    option = getattr(ctypes.CDLL(None), "mallopt", None)
    if option is not None:
        option(-3, 8 << 20)  # arrays up to this size come from the heap,
        option(-1, 24 << 20)  # of which so much may be free at its end


def batches(rows, max_bytes: int = 2_000_000):
    """Lists of consecutive items of ``rows`` (index, bytes) holding about ``max_bytes`` each."""
    part, size = [], 0
    for item in rows:
        part.append(item)
        size += len(item[1])
        if size >= max_bytes:
            yield part
            part, size = [], 0
    if part:
        yield part


def bounded_sample(df: DataFrame, n: int, *keys: Column) -> DataFrame:
    """At most about ``n`` rows of ``df``, all if it has fewer: those whose keys hash below a bound.

    The same rows whatever the partitions, and only chosen rows are moved.
    Rows with equal keys count once. The bound leaves six standard deviations
    of room, so that more than ``n`` rows are as good as impossible.
    """
    mark = fresh(df, "sample_hash")
    marked = df.withColumn(mark, F.shiftrightunsigned(F.xxhash64(*keys), 1))
    total = df.count()
    if total > n:
        share = max(0.0, n - 6 * n**0.5) / total
        marked = marked.filter(F.col(mark) < int(share * (1 << 63)))
    return marked.dropDuplicates([mark]).select(*df.columns)
