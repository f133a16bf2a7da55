"""Hierarchy and key audits: C06-C09, C11, C12, C15, C17, C18, C20, C21."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saleslens.functions.expressions import RATIO_SCALE, pair_key, ratio


def _text(c: str, collation: str | None) -> Column:
    """The column, compared under ``collation`` when one is given.

    The source system compares text under its database collation (often
    case-insensitive); Spark compares bytes unless told otherwise, e.g.
    ``UTF8_LCASE`` (case-insensitive) or ``UTF8_LCASE_RTRIM`` (also ignores
    trailing spaces).
    """
    return F.collate(F.col(c), collation).alias(c) if collation else F.col(c)


def identifier_cardinality(
    df: DataFrame,
    name: str,
    ident: str,
    name_alias: str | None = None,
    ident_alias: str | None = None,
    collation: str | None = None,
) -> DataFrame:
    """One row: distinct names vs distinct ids (C06). Unequal counts mean the
    name-id mapping is not one-to-one.

    Spark plans two distinct counts as an Expand of the two narrow columns
    followed at once by a map-side dedupe of (column, value), so only distinct
    values are shuffled. (A dedupe written before it would be removed by the
    optimizer as redundant.)
    """
    return df.select(_text(name, collation), _text(ident, collation)).agg(
        F.count_distinct(name).alias(name_alias or f"{name}_count_distinct"),
        F.count_distinct(ident).alias(ident_alias or f"{ident}_count_distinct"),
    )


def children_per_parent(
    df: DataFrame,
    parents: str | Sequence[str],
    child: str,
    alias: str | None = None,
    order: bool = False,
    collation: str | None = None,
) -> DataFrame:
    """Distinct children per parent group.

    A single count_distinct is planned as a map-side dedupe of (parents, child),
    a shuffle on those keys and a partial count per parent, so a parent with a
    third of all rows still spreads over many tasks. ``order`` sorts by the
    first parent, then by the count descending.
    """
    parents = [parents] if isinstance(parents, str) else list(parents)
    alias = alias or f"{child}_count"
    src = df.select(*[_text(p, collation) for p in parents], _text(child, collation))
    out = src.groupBy(*parents).agg(F.count_distinct(child).alias(alias))
    if order:
        out = out.orderBy(F.col(parents[0]).asc(), F.col(alias).desc())
    return out


def distinct_pairs(df: DataFrame, a: str, b: str, collation: str | None = None) -> DataFrame:
    """Distinct (a, b) combinations ordered by a, then b.

    The second key spreads the pairs of one a over many sort ranges.
    """
    return df.select(_text(a, collation), _text(b, collation)).distinct().orderBy(a, b)


def hierarchy_check(
    df: DataFrame,
    parent: str,
    child: str,
    child_alias: str | None = None,
    map_alias: str | None = None,
    collation: str | None = None,
) -> DataFrame:
    """Distinct children vs distinct parent-child maps.

    A hierarchy is consistent when both counts are equal. ``<map>`` counts
    true pairs; ``<map>_concat`` counts the source system's separator-less
    concatenation (NULL read as ''), kept for parity with its findings.
    """
    child_alias = child_alias or f"{child}_count_distinct"
    map_alias = map_alias or f"{parent}_{child}_map_count"
    # Dedupe the pairs first (hash aggregate, map-side combine): the fact is
    # scanned once and only distinct pairs are shuffled; the three counts then
    # run over the pairs. distinct() keeps a (NULL, NULL) pair as one row, so
    # count(*) over the pairs equals count_distinct(struct(parent, child)).
    pairs = df.select(_text(parent, collation), _text(child, collation)).distinct()
    return pairs.agg(
        F.count_distinct(child).alias(child_alias),
        F.count(F.lit(1)).alias(map_alias),
        F.count_distinct(pair_key(parent, child, "concat")).alias(f"{map_alias}_concat"),
    )


def multi_parent(
    df: DataFrame, parent: str, child: str, alias: str | None = None, collation: str | None = None
) -> DataFrame:
    """Children mapped to more than one parent, with the parent count (C11)."""
    alias = alias or f"{parent}_count_distinct"
    return (
        df.select(_text(parent, collation), _text(child, collation))
        .groupBy(child)
        .agg(F.count_distinct(parent).alias(alias))
        .filter(F.col(alias) > 1)
    )


def pairs_for(
    df: DataFrame, child: str, parent: str, values: Sequence[str], collation: str | None = None
) -> DataFrame:
    """Distinct (child, parent) for the listed children.

    The literal IN list is pushed into the Parquet scan (not under a collation).
    """
    pairs = df.select(_text(child, collation), _text(parent, collation))
    return pairs.filter(F.col(child).isin(list(values))).distinct()


def multi_parent_detail(
    df: DataFrame,
    key: str = "product_name",
    parent: str = "subcategory",
    context: Sequence[str] = ("category",),
    collation: str | None = None,
) -> DataFrame:
    """Every distinct (context, parent, key) of a key that has more than one parent.

    One scan: the distinct triples are deduped map-side, and a window over the
    few triples of each key tells whether its smallest and largest parent
    differ (NULL parents excluded, as a distinct count excludes them).
    """
    cols = [*context, parent, key]
    triples = df.select(*[_text(c, collation) for c in cols]).filter(F.col(key).isNotNull()).distinct()
    w = Window.partitionBy(key)
    return (
        triples.withColumns({"_least": F.min(parent).over(w), "_most": F.max(parent).over(w)})
        .filter("_least < _most")
        .select(*cols)
    )


def values_reused_across(
    df: DataFrame, a: str = "market", b: str = "region", collation: str | None = None
) -> DataFrame:
    """Distinct (a, b) whose b value also occurs as an a value, ordered by a, then b (C17)."""
    pairs = df.select(_text(a, collation), _text(b, collation)).distinct()
    a_values = pairs.select(F.col(a).alias("_v")).distinct()
    return pairs.join(a_values, F.col(b) == F.col("_v"), "left_semi").orderBy(a, b)


def name_fanout(
    df: DataFrame,
    name: str = "customer_name",
    ident: str = "customer_id",
    region: str = "region",
    ident_alias: str | None = None,
    region_alias: str = "registered_region_count_distinct",
    collation: str | None = None,
) -> DataFrame:
    """Per name: distinct ids and distinct regions.

    Planned as an Expand of three narrow columns with an immediate map-side
    dedupe of (name, value), so only distinct pairs are shuffled and a name
    with a third of all lines still spreads over many tasks.
    """
    return df.select(*[_text(c, collation) for c in (name, ident, region)]).groupBy(name).agg(
        F.count_distinct(ident).alias(ident_alias or f"{ident}_count_distinct"),
        F.count_distinct(region).alias(region_alias),
    )


def negative_rows(df: DataFrame, measure: str = "profit") -> DataFrame:
    """All rows with a negative measure, most negative first (C20).

    A distributed range-partitioned sort; nothing is collected. Ties are
    broken by a hash of the whole row, so a single value held by a third of
    the rows still spreads over many range partitions instead of one task.
    """
    tiebreak = F.xxhash64(*[F.col(c) for c in df.columns])
    return df.filter(F.col(measure) < 0).orderBy(F.col(measure).asc(), tiebreak)


def signed_ratio_by_period(
    df: DataFrame,
    measure: str = "profit",
    date: str = "order_date",
    prefix: str = "profit",
    scale: int | None = RATIO_SCALE,
) -> DataFrame:
    """Per year: sum of negative values, sum of positive values, |neg| / pos.

    One scan with conditional sums; keeping only years that have both signs
    matches the inner join of two separately filtered aggregates.
    """
    m = F.col(measure)
    neg, pos = f"negative_{prefix}", f"positive_{prefix}"
    return (
        df.groupBy(F.year(date).alias("order_year"))
        .agg(F.sum(F.when(m < 0, m)).alias(neg), F.sum(F.when(m > 0, m)).alias(pos))
        .filter(F.col(neg).isNotNull() & F.col(pos).isNotNull())
        .select("order_year", neg, pos, ratio(F.abs(F.col(neg)), F.col(pos), scale).alias("negative_positive_ratio"))
        .orderBy("order_year")
    )
