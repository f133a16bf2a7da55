"""Sinks for shaped results (Parquet by default, CSV for hand-off)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# A single output file is written by one task; only small dimensions qualify.
SINGLE_FILE_ROW_LIMIT = 1_000_000

# Text survives: blanks stay, an empty string is a quoted empty cell and NULL an
# empty one, quotes are doubled, and cells with line breaks are quoted.
CSV_WRITER = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "nullValue": "",
    "emptyValue": '""',
}


def export(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: list[str] | None = None,
    single_file: bool = False,
    mode: str = "overwrite",
) -> None:
    """Write ``df`` as a directory of Parquet or CSV (with header) part files.

    Facts are written in parallel, one part per task (optionally partitioned
    by columns such as the order year). ``single_file`` funnels everything
    through one task, so more than SINGLE_FILE_ROW_LIMIT rows stop the write
    with an error (checked while writing; the input runs once).
    Column names with spaces are kept as they are in both formats.
    """
    if fmt not in ("parquet", "csv"):
        raise ValueError("fmt must be 'parquet' or 'csv'")
    if single_file:
        # the limit leaves one partition, so the id counts its rows; the plan above keeps its tasks
        counted = df.limit(SINGLE_FILE_ROW_LIMIT + 1).withColumn("_row", F.monotonically_increasing_id())
        stop = F.raise_error(F.lit("single_file is only for small dimensions; write a fact as a directory"))
        df = counted.filter(
            F.when(F.col("_row") >= SINGLE_FILE_ROW_LIMIT, stop).otherwise(F.lit(True))
        ).drop("_row")
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.options(**CSV_WRITER).csv(path)
    else:
        writer.parquet(path)
