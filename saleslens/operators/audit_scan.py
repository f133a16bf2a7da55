"""All hierarchy and key audits from one scan of the fact.

Each of those audits looks at the distinct combinations of two to four text
columns only. ``distinct_tuples`` takes all the combinations that are asked
for in one pass: every line gives one narrow tuple for each, tagged with its
name, and one aggregate dedupes them map-side, so only distinct tuples are
shuffled. Landed by tag, an audit reads its own folder and never the fact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAG = "tuple_of"

#: The combinations that the audits read, by name.
AUDIT_TUPLES: dict[str, tuple[str, ...]] = {
    "market_country": ("market", "country"),
    "market_region": ("market", "region"),
    "category_subcategory_product": ("category", "subcategory", "product_name"),
    "product_names": ("product_id", "product_name"),
    "customers": ("customer_name", "customer_id", "region"),
}


def distinct_tuples(df: DataFrame, tuples: Mapping[str, Sequence[str]] = AUDIT_TUPLES) -> DataFrame:
    """tuple_of, c0, c1, ..., n_lines: the distinct combinations of every entry of ``tuples``, and their lines.

    ``c0`` ... hold the entry's columns in their order, NULL beyond them. All
    columns must be text. NULLs are values here, as in a GROUP BY.
    """
    if not tuples:
        raise ValueError("no tuples asked for")
    others = sorted({c for columns in tuples.values() for c in columns if df.schema[c].dataType != T.StringType()})
    if others:
        raise ValueError(f"not text: {others}")
    width = max(len(columns) for columns in tuples.values())
    names = [f"c{i}" for i in range(width)]

    def cell(columns: Sequence[str], i: int):
        return F.col(f"`{columns[i]}`") if i < len(columns) else F.lit(None).cast("string")

    cells = F.array(
        *[
            F.struct(F.lit(tag).alias(TAG), *[cell(columns, i).alias(n) for i, n in enumerate(names)])
            for tag, columns in tuples.items()
        ]
    )
    return (
        df.select(F.explode(cells).alias("t"))
        .select("t.*")
        .groupBy(TAG, *names)
        .agg(F.count(F.lit(1)).alias("n_lines"))
    )


def land_tuples(df: DataFrame, path: str, tuples: Mapping[str, Sequence[str]] = AUDIT_TUPLES) -> None:
    """``distinct_tuples`` of ``df`` as Parquet, a folder for each entry."""
    distinct_tuples(df, tuples).write.mode("overwrite").partitionBy(TAG).parquet(path)


def tuples_of(
    spark: SparkSession, path: str, tag: str, tuples: Mapping[str, Sequence[str]] = AUDIT_TUPLES
) -> DataFrame:
    """The distinct combinations of one entry, under the names of its columns; reads that folder alone."""
    width = max(len(columns) for columns in tuples.values())
    schema = ", ".join([*[f"c{i} string" for i in range(width)], "n_lines long", f"{TAG} string"])
    rows = spark.read.schema(schema).parquet(path).filter(F.col(TAG) == tag)
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(tuples[tag])], "n_lines")
