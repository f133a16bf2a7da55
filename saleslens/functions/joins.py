"""Join helpers: broadcast only behind an explicit size check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saleslens.constants import BROADCAST_BYTE_LIMIT, BROADCAST_ROW_LIMIT


def _width(field: T.StructField) -> Column:
    """Bytes of a value in a row: 8, and its content for text and binary; nested values as text."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 8
    return F.lit(8)


def proven_small(df: DataFrame, max_rows: int = BROADCAST_ROW_LIMIT, max_bytes: int = BROADCAST_BYTE_LIMIT) -> bool:
    """True when ``df`` has at most ``max_rows`` rows and ``max_bytes`` bytes of values.

    One aggregate with partial sums in the tasks; no rows are moved.
    """
    width = reduce(lambda a, b: a + b, [_width(f) for f in df.schema.fields], F.lit(8))
    seen = df.agg(F.count(F.lit(1)).alias("n"), F.sum(width.cast("long")).alias("bytes")).first()
    return seen["n"] <= max_rows and (seen["bytes"] or 0) <= max_bytes


def sized_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_ROW_LIMIT, max_bytes: int = BROADCAST_BYTE_LIMIT
) -> DataFrame:
    """``broadcast(df)`` when its rows and bytes are proven small, else pinned to a shuffle join."""
    return F.broadcast(df) if proven_small(df, max_rows, max_bytes) else df.hint("merge")
