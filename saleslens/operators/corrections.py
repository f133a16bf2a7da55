"""Rule-based corrections and field policy: C13, C14, C16a, C16b, C22.

Corrections never mutate: each returns the corrected DataFrame and a change
report (rows touched per rule) to be reviewed before the result is landed.
Rules are matched on the values they describe, not on a row id, so rows that
share an id (or have none) are corrected on their own merits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saleslens.constants import (
    BROADCAST_BYTE_LIMIT,
    BROADCAST_ROW_LIMIT,
    REFERENCE_EXCLUDED_FIELDS,
    REFERENCE_MARKET_RULES,
    REFERENCE_PRODUCT_RULE,
)
from saleslens.functions.joins import sized_broadcast

MATCHED = "_rule_matched"


def _as_text(column: Column, collation: str | None) -> Column:
    return F.collate(column, collation) if collation else column


def _rule_table(
    df: DataFrame,
    rules: Sequence[Sequence[str]] | DataFrame,
    names: Sequence[str],
    keys: int,
    collation: str | None = None,
) -> DataFrame:
    """The rules as a table whose columns carry a prefix of their own, ready to join.

    Tuples and tables are treated alike: two rules with one key (under the
    ``collation``, if one is given) are an error, and a NULL key matches no row
    (as an equality in a join never does). The table is broadcast when it is
    proven small, else joined by shuffle.
    """
    columns = [F.col(f"`{n}`").alias(f"_rule_{i}") for i, n in enumerate(names)]
    if isinstance(rules, DataFrame):
        table = rules.select(*names)
        by = [_as_text(F.col(f"`{n}`"), collation) for n in names[:keys]]
        repeated = not table.groupBy(*by).agg(F.count(F.lit(1)).alias("count")).filter("count > 1").isEmpty()
        table = sized_broadcast(table.select(*columns, F.lit(True).alias(MATCHED)))
    else:
        rows = [tuple(r) for r in rules]
        table = df.sparkSession.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))
        if collation:
            by = [_as_text(F.col(f"`{n}`"), collation) for n in names[:keys]]
            repeated = table.select(*by).distinct().count() < len(rows)
        else:
            repeated = len({r[:keys] for r in rows}) < len(rows)
        table = table.select(*columns, F.lit(True).alias(MATCHED))
        if len(rows) <= BROADCAST_ROW_LIMIT and sum(len(x or "") for r in rows for x in r) <= BROADCAST_BYTE_LIMIT:
            table = F.broadcast(table)
    if repeated:
        raise ValueError(f"rules must have unique ({', '.join(names[:keys])}) keys")
    return table


def _match(df: DataFrame, table: DataFrame, condition: Column) -> DataFrame:
    """Every row of ``df`` with its rule, if one applies."""
    return df.join(table, condition, "left").withColumn(MATCHED, F.coalesce(F.col(MATCHED), F.lit(False)))


def _assign(matched: DataFrame, df: DataFrame, targets: dict[str, str]) -> DataFrame:
    """``df`` with each target column set where a rule matched, to NULL if the rule says so."""
    return matched.select(
        *[
            F.when(F.col(MATCHED), F.col(targets[c])).otherwise(F.col(c)).alias(c) if c in targets else F.col(c)
            for c in df.columns
        ]
    )


def _report(matched: DataFrame, names: Sequence[str]) -> DataFrame:
    """rows_changed per rule that applied; the rule's own columns label each row."""
    cols = [f"_rule_{i}" for i in range(len(names))]
    return (
        matched.filter(MATCHED)
        .groupBy(*cols)
        .agg(F.count(F.lit(1)).alias("rows_changed"))
        .select(*[F.col(c).alias(n) for c, n in zip(cols, names)], "rows_changed")
    )


# ---------------------------------------------------------------- market ----


def _market_match(df: DataFrame, rules, market: str, country: str, collation: str | None = None) -> DataFrame:
    names = ("wrong_market", "country", "correct_market")
    table = _rule_table(df, rules, names, 2, collation)
    keys = [_as_text(F.col(c), collation) for c in (market, country)]
    return _match(df, table, (keys[0] == F.col("_rule_0")) & (keys[1] == F.col("_rule_1")))


def market_correction_map(
    df: DataFrame,
    rules: Sequence[tuple[str, str, str]] | DataFrame = REFERENCE_MARKET_RULES,
    key: str = "row_id",
    market: str = "market",
    country: str = "country",
    collation: str | None = None,
) -> DataFrame:
    """key + correct_market for every row a market rule applies to."""
    matched = _market_match(df.select(key, market, country), rules, market, country, collation)
    return matched.filter(MATCHED).select(key, F.col("_rule_2").alias("correct_market"))


def apply_market_correction(
    df: DataFrame,
    rules: Sequence[tuple[str, str, str]] | DataFrame = REFERENCE_MARKET_RULES,
    market: str = "market",
    country: str = "country",
    collation: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Replace the market of rows whose (market, country) a rule names (C14).

    ``rules``: (wrong_market, country, correct_market) triples, or a table
    with these columns; keys must be unique. Any number of rules goes the same
    way: a left join with the rule table, broadcast when its size is proven
    small, else by shuffle. A rule whose correct market is NULL sets NULL.
    Under a ``collation`` (``UTF8_LCASE``: letters' case does not matter) texts
    are compared by it; a corrected row takes the rule's spelling.
    Returns (corrected, report[wrong_market, country, correct_market,
    rows_changed]). Idempotent: a corrected row no longer matches its rule.
    """
    matched = _market_match(df, rules, market, country, collation)
    report = _report(matched, ("wrong_market", country, "correct_market"))
    return _assign(matched, df, {market: "_rule_2"}), report


# ----------------------------------------------------------- subcategory ----


def _as_rules(rule) -> list[tuple[str, str, str]]:
    if not rule:
        return []
    return [tuple(rule)] if isinstance(rule[0], str) else [tuple(r) for r in rule]


def _product_match(df: DataFrame, rule, product: str, subcategory: str, collation: str | None = None) -> DataFrame:
    names = ("product_name", "correct_subcategory", "correct_category")
    rules = rule if isinstance(rule, DataFrame) else _as_rules(rule)
    table = _rule_table(df, rules, names, 1, collation)
    name, filed = (_as_text(F.col(c), collation) for c in (product, subcategory))
    # <> leaves rows without a subcategory alone, as in the source system
    condition = (name == F.col("_rule_0")) & (filed != F.col("_rule_1"))
    return _match(df, table, condition)


def subcategory_correction_map(
    df: DataFrame,
    rule: tuple[str, str, str] | Sequence[tuple[str, str, str]] | DataFrame = REFERENCE_PRODUCT_RULE,
    key: str = "row_id",
    product: str = "product_name",
    subcategory: str = "subcategory",
    collation: str | None = None,
) -> DataFrame:
    """key, current subcategory, product, correct subcategory and category for
    every row of a named product filed outside its correct subcategory (C16a)."""
    matched = _product_match(df.select(key, subcategory, product), rule, product, subcategory, collation)
    return matched.filter(MATCHED).select(
        key,
        subcategory,
        product,
        F.col("_rule_1").alias("correct_subcategory"),
        F.col("_rule_2").alias("correct_category"),
    )


def apply_subcategory_correction(
    df: DataFrame,
    rule: tuple[str, str, str] | Sequence[tuple[str, str, str]] | DataFrame = REFERENCE_PRODUCT_RULE,
    product: str = "product_name",
    subcategory: str = "subcategory",
    category: str = "category",
    collation: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Move a product into its correct subcategory and category.

    ``rule``: (product_name, correct_subcategory, correct_category), a list of
    them, or a table with these columns; one rule for a product. Any number of
    rules takes the join of ``apply_market_correction``. The report counts
    rows per rule.
    """
    matched = _product_match(df, rule, product, subcategory, collation)
    report = _report(matched, (product, "correct_subcategory", "correct_category"))
    return _assign(matched, df, {subcategory: "_rule_1", category: "_rule_2"}), report


# ---------------------------------------------------------- by-key update ----


def apply_by_key(df: DataFrame, fixes: DataFrame, key: str, targets: dict[str, str]) -> DataFrame:
    """Update-by-join on a key column: ``targets`` maps df column -> fixes column.

    Only safe when ``key`` is unique in both inputs: a shared key would copy
    one row's fix onto another row. The proof needs no job of its own: rows and
    fixes are placed by the key in one shuffle, and where a row meets its fix,
    both are counted; a key that either side has twice stops the job. A NULL
    key names no row, so rows without one stay as they are, are not shuffled
    and may be many. A matched row takes the new value even if that is NULL.
    Prefer the rule-based operators above.
    """
    if df.schema[key].dataType != fixes.schema[key].dataType:
        fixes = fixes.withColumn(key, F.col(key).cast(df.schema[key].dataType))
    fix = F.struct(*[F.col(src).alias(f"v{i}") for i, src in enumerate(targets.values())])
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.struct(*df.columns).alias("row"))
    news = fixes.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), fix.alias("fix"))
    whole = Window.partitionBy("k")
    met = rows.unionByName(news, allowMissingColumns=True).select(
        "row",
        F.first("fix", ignorenulls=True).over(whole).alias("fix"),
        F.count("row").over(whole).alias("rows"),
        F.count("fix").over(whole).alias("fixes"),
    )
    checked = F.lit(True)
    for count, name in (("rows", "input"), ("fixes", "fixes")):
        stop = F.raise_error(F.lit(f"{key} is not unique in the {name}; use a rule-based correction"))
        checked = checked & F.when(F.col(count) > 1, stop).otherwise(F.lit(True))
    place = {dst: f"fix.v{i}" for i, dst in enumerate(targets)}
    updated = met.filter(checked).filter(F.col("row").isNotNull()).select(
        *[
            (F.when(F.col("fixes") > 0, F.col(place[c])).otherwise(F.col(f"row.`{c}`")) if c in place else F.col(f"row.`{c}`")).alias(c)
            for c in df.columns
        ]
    )
    return updated.unionByName(df.filter(F.col(key).isNull()))


# ---------------------------------------------------------- field policy ----


def apply_field_policy(df: DataFrame, exclude: Sequence[str] = REFERENCE_EXCLUDED_FIELDS) -> DataFrame:
    """Drop the fields excluded from analysis (C22): region, customer_name,
    product_id and profit by default."""
    unknown = [c for c in exclude if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns {unknown}")
    return df.select(*[c for c in df.columns if c not in set(exclude)])


__all__ = [
    "market_correction_map",
    "apply_market_correction",
    "subcategory_correction_map",
    "apply_subcategory_correction",
    "apply_by_key",
    "apply_field_policy",
]
