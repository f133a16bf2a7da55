"""Incremental CSV landing with Structured Streaming (C02 for arriving files).

The source system bulk-loads one CSV file. When files keep arriving, the same
typed load runs as a file stream: each micro-batch of new files is split into
good rows and rejects and appended to two Parquet tables. The stream's
checkpoint (in the shared folder) records which files were taken, so a restart
or a lost executor neither skips nor repeats a file.
"""

from __future__ import annotations

import hashlib

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from saleslens.session import shared_dir
from saleslens.sources.csv_records import csv_records, lines_of
from saleslens.sources.csv_source import (
    CORRUPT,
    cells_of_records,
    csv_reader_options,
    split_rejects,
    tag_rows,
    text_schema,
)
from saleslens.sources.schema import sales_schema

BATCH_COLUMN = "_ingest_batch"


def stream_land_csv(
    spark: SparkSession,
    source_dir: str,
    target_dir: str,
    schema: T.StructType | None = None,
    checkpoint: str | None = None,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
    ranges: dict[str, tuple[int, int]] | None = None,
    quoted_line_breaks: bool = True,
) -> StreamingQuery:
    """Start a file stream from ``source_dir`` into ``target_dir/{good,rejects}``.

    Each batch is written partitioned by its batch id with dynamic partition
    overwrite, so a batch replayed after a failure replaces its own output
    instead of appending it twice. ``available_now`` processes every file
    present and stops; otherwise the query keeps running for new files.
    With ``quoted_line_breaks`` a quoted cell may span lines: the lines of a
    batch's files are cut into records split by split (``csv_records``), so a
    large file is read by many tasks; without, every line is a row.
    """
    schema = schema or sales_schema()
    checkpoint = checkpoint or (
        f"{shared_dir(spark)}/saleslens/streams/"
        f"{hashlib.sha1((source_dir + '|' + target_dir).encode()).hexdigest()[:16]}"
    )
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if quoted_line_breaks:
        stream = lines_of(reader.option("lineSep", "\n").text(source_dir))
    else:
        stream = (
            reader.options(**csv_reader_options(False))
            .schema(text_schema(schema))
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT)
            .csv(source_dir)
        )

    def land(batch: DataFrame, batch_id: int) -> None:
        if quoted_line_breaks:
            batch = cells_of_records(csv_records(batch), schema)
        # Both outputs derive from one parse of the batch's files; blocks lost
        # with an executor are re-parsed from the files (MEMORY_AND_DISK).
        batch = tag_rows(batch, schema, ranges).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            good, rejects = split_rejects(batch, schema)
            for name, frame in (("good", good), ("rejects", rejects)):
                (
                    frame.withColumn(BATCH_COLUMN, F.lit(batch_id))
                    .write.mode("overwrite")
                    .option("partitionOverwriteMode", "dynamic")
                    .partitionBy(BATCH_COLUMN)
                    .parquet(f"{target_dir}/{name}")
                )
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
