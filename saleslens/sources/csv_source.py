"""Typed CSV ingestion with rejected rows kept aside, and Parquet landing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saleslens.sources.csv_records import csv_records, lines_of
from saleslens.sources.schema import NUMERIC_RANGES, TEXT_LIMITS, sales_schema

CORRUPT = "_corrupt_record"
REJECT_REASON = "reject_reason"


def csv_reader_options(quoted_line_breaks: bool = True) -> dict[str, str]:
    """Header first, comma separated, double-quote quoting with doubled quotes.

    Cells keep their blanks; an empty cell is NULL and a quoted empty cell the
    empty string, as the writer marks them. With ``quoted_line_breaks`` a
    quoted cell may span lines; Spark's own CSV source then gives each file to
    one task, ``read_text_cells`` does not.
    """
    return {
        "header": "true",
        "sep": ",",
        "quote": '"',
        "escape": '"',
        "multiLine": "true" if quoted_line_breaks else "false",
        "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false",
        # what the parser puts for an empty cell, told apart from a quoted one
        "nullValue": "\x00",
        "emptyValue": "",
    }


def text_schema(schema: T.StructType) -> T.StructType:
    """Every declared column as text, and the raw record of lines with too few or too many cells."""
    fields = [T.StructField(f.name, T.StringType(), True) for f in schema.fields]
    return T.StructType([*fields, T.StructField(CORRUPT, T.StringType(), True)])


def _parsed(field: T.StructField) -> Column:
    cell = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType):
        return cell
    if isinstance(field.dataType, T.DateType):
        return F.expr(f"try_to_date(nullif(trim(`{field.name}`), ''), 'yyyy-MM-dd')")
    return F.expr(f"try_cast(nullif(trim(`{field.name}`), '') AS {field.dataType.simpleString()})")


def _reason(
    schema: T.StructType, ranges: dict[str, tuple[int, int]], max_lengths: dict[str, int]
) -> Column:
    """Why a row is rejected, NULL for a good one.

    Every check looks at the text cells themselves, so the verdict on a row
    needs all its columns whatever is selected from the result.
    """
    checks: list[tuple[str, Column]] = [("unparsable cell", F.col(CORRUPT).isNotNull())]
    for field in schema.fields:
        cell, value = F.col(f"`{field.name}`"), _parsed(field)
        if not isinstance(field.dataType, T.StringType):
            checks.append(("unparsable cell", (F.trim(cell) != "") & value.isNull()))
        if field.name in ranges:
            low, high = ranges[field.name]
            checks.append((f"{field.name} out of range", ~value.between(low, high)))
        if field.name in max_lengths:
            limit = max_lengths[field.name]
            checks.append((f"{field.name} longer than {limit}", F.char_length(cell) > limit))
    reason = F.lit(None).cast("string")
    for label, failed in reversed(checks):
        reason = F.when(F.coalesce(failed, F.lit(False)), F.lit(label)).otherwise(reason)
    return reason


def tag_rows(
    text_rows: DataFrame,
    schema: T.StructType,
    ranges: dict[str, tuple[int, int]] | None = None,
    max_lengths: dict[str, int] | None = None,
) -> DataFrame:
    """Typed columns, the raw record and ``reject_reason`` of rows whose cells are text."""
    ranges = NUMERIC_RANGES if ranges is None else ranges
    max_lengths = TEXT_LIMITS if max_lengths is None else max_lengths
    reason = _reason(schema, ranges, max_lengths).alias(REJECT_REASON)
    raw = F.to_csv(F.struct(*[F.col(f"`{f.name}`") for f in schema.fields]))
    return text_rows.select(
        *[_parsed(f).alias(f.name) for f in schema.fields],
        # lines of the wrong width as they stand, other rejects as their cells
        F.when(reason.isNotNull(), F.coalesce(F.col(CORRUPT), raw)).alias(CORRUPT),
        reason,
    )


def cells_of_records(records: DataFrame, schema: T.StructType) -> DataFrame:
    """The cells of ``records.record`` as text, with the raw record where their number is wrong.

    The parsed record comes out of a generator: a filter on its cells stays
    above it. Out of a projection the optimizer would move the filter below
    and parse every record again for each cell that the filter looks at.
    """
    options = {**csv_reader_options(False), "header": "false", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    # a record is parsed by itself: with the default buffer each would allocate megabytes
    options["inputBufferSize"] = "16384"
    wide = text_schema(schema)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wide.fields)
    return records.select(F.inline(F.array(F.from_csv("record", ddl, options))))


def read_text_cells(
    spark: SparkSession, path: str | list[str], schema: T.StructType, quoted_line_breaks: bool = True
) -> DataFrame:
    """The CSV's cells as text, with the raw record where their number is wrong.

    With ``quoted_line_breaks`` records are cut by ``csv_records``, so large
    files are split over tasks (rows end in LF or CR LF); without, by Spark's
    CSV source line by line.
    """
    if quoted_line_breaks:
        return cells_of_records(csv_records(lines_of(spark.read.option("lineSep", "\n").text(path))), schema)
    return (
        spark.read.options(**csv_reader_options(False))
        .schema(text_schema(schema))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(path)
    )


def load_sales_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = None,
    on_bad: str = "report",
    ranges: dict[str, tuple[int, int]] | None = None,
    max_lengths: dict[str, int] | None = None,
    quoted_line_breaks: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Read header-first, comma-separated, quoted CSV into typed columns.

    Returns ``(good, rejects)``. Cells are read as text and cast one by one; a
    row is rejected when its number of cells is wrong, a cell does not cast to
    its declared type, or a declared range or length is broken (``ranges``
    defaults to the unsigned byte of ``quantity``, ``max_lengths`` to the
    declared text limits; an empty mapping switches a check off). Which rows
    are good does not depend on the columns selected from the result. Rejects
    keep every column that parsed, the raw record and a reason.
    ``on_bad='fail'`` stops at a bad row whatever is selected. Quoted commas,
    quotes and line breaks parse, and large files are split over tasks either
    way; ``quoted_line_breaks=False`` reads every line as a row, without the
    pass that finds where records start.
    """
    if on_bad not in ("report", "fail"):
        raise ValueError("on_bad must be 'report' or 'fail'")
    schema = schema or sales_schema()
    tagged = tag_rows(read_text_cells(spark, path, schema, quoted_line_breaks), schema, ranges, max_lengths)
    if on_bad == "fail":
        stop = F.raise_error(F.concat(F.lit("rejected row: "), F.col(REJECT_REASON)))
        checked = tagged.filter(F.when(F.col(REJECT_REASON).isNotNull(), stop).otherwise(F.lit(True)))
        return checked.select(*schema.fieldNames()), spark.createDataFrame([], tagged.schema)
    return split_rejects(tagged, schema)


def split_rejects(tagged: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Split tagged rows into (good rows, rejects with a reason)."""
    good = tagged.filter(F.col(REJECT_REASON).isNull()).select(*schema.fieldNames())
    return good, tagged.filter(F.col(REJECT_REASON).isNotNull())


STATUS = "ingest_status"


def land_sales_csv(
    spark: SparkSession,
    path: str | list[str],
    out_dir: str,
    schema: T.StructType | None = None,
    ranges: dict[str, tuple[int, int]] | None = None,
    max_lengths: dict[str, int] | None = None,
    quoted_line_breaks: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Parse the CSV once and land good rows and rejects together as Parquet.

    The lazy split of ``load_sales_csv`` parses the files once per output;
    here every row is tagged in one pass and written partitioned by
    ``ingest_status`` ('good' / 'rejected'), so at scale the text is parsed a
    single time. Returns (good, rejects) read back with partition pruning.
    """
    schema = schema or sales_schema()
    cells = read_text_cells(spark, path, schema, quoted_line_breaks)
    tagged = tag_rows(cells, schema, ranges, max_lengths).withColumn(
        STATUS, F.when(F.col(REJECT_REASON).isNull(), F.lit("good")).otherwise(F.lit("rejected"))
    )
    tagged.write.mode("overwrite").partitionBy(STATUS).parquet(out_dir)
    landed = spark.read.schema(tagged.schema).parquet(out_dir)
    good = landed.filter(F.col(STATUS) == "good").select(*schema.fieldNames())
    rejects = landed.filter(F.col(STATUS) == "rejected").drop(STATUS)
    return good, rejects


def land_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Write a DataFrame as Parquet (the landing zone every later step scans)."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def land_clustered(
    df: DataFrame,
    path: str,
    by: list[str],
    partitions: int | None = None,
    row_group_bytes: int | None = None,
    mode: str = "overwrite",
) -> None:
    """Write ``df`` as Parquet in ranges of ``by``, sorted inside each, so that a filter on it skips row groups.

    Costs one full shuffle and sort at landing; pays when several readers
    filter by the same columns, as the date-ranged gates do. A hash of the row
    breaks ties between ranges, so one value with a third of all rows still
    spreads over many. ``partitions`` defaults to the session's shuffle
    partitions, ``row_group_bytes`` to Parquet's own size.
    """
    keys = [F.col(c) for c in by]
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    ranges = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    writer = df.repartitionByRange(ranges, *keys, F.xxhash64(*plain)).sortWithinPartitions(*keys).write.mode(mode)
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    writer.parquet(path)
