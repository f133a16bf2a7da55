"""The gates' shared state: sums and counts by all dimensions that they read.

``roll_up`` scans the fact once. Its rows are sums and counts, so they merge:
with those of rows that arrive later, and down to any of their dimensions.
Every gate reads its totals from a source with one set of methods, the fact
itself (``FactRows``) or a rollup (``Rollup``), and gives the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleslens.functions.expressions import discounted, in_years, ship_days
from saleslens.functions.joins import sized_broadcast

#: Dimensions and measures of the gates over the source's columns.
GATE_DIMENSIONS = ("market", "country", "category", "ship_mode", "segment")
GATE_MEASURES = ("sales", "shipping_cost")
#: Columns of a rollup beside its dimensions and measures.
YEAR, MONTH, DISCOUNTED, LINES, DAYS = "order_year", "order_month", "discounted", "lines", "ship_days"

#: Values that a gate is limited to: literals, a table whose first column has them, or no limit.
Values = Sequence[str] | DataFrame | None


@dataclass(frozen=True)
class FactRows:
    """Totals over a fact's lines."""

    rows: DataFrame

    def sum(self, measure: str) -> Column:
        return F.sum(measure)

    def count(self, measure: str) -> Column:
        return F.count(measure)

    def lines(self) -> Column:
        return F.count(F.lit(1))

    def sum_where(self, condition: Column, measure: str) -> Column:
        return F.sum(F.when(condition, F.col(measure)).otherwise(F.lit(0)))

    def lines_where(self, condition: Column) -> Column:
        return F.count_if(condition)

    def days(self, order_date: str, ship_date: str) -> tuple[Column, Column]:
        days = ship_days(order_date, ship_date)
        return F.sum(days), F.count(days)

    def discounted(self, discount: str) -> Column:
        return discounted(discount)

    def year(self, date: str) -> Column:
        return F.year(date)

    def month(self, date: str) -> Column:
        return F.month(date)

    def in_years(self, date: str, years: Sequence[int]) -> Column:
        """As date ranges, which reach the Parquet scan."""
        return in_years(date, years)


@dataclass(frozen=True)
class Rollup:
    """Totals over the rows of ``roll_up``, which name the fact's columns."""

    rows: DataFrame

    def _total(self, column: str) -> Column:
        # a sum of sums keeps the type of the sum
        return F.sum(column).cast(self.rows.schema[column].dataType)

    def _counted(self, column: Column) -> Column:
        return F.coalesce(F.sum(column), F.lit(0)).cast("long")

    def sum(self, measure: str) -> Column:
        return self._total(f"sum_{measure}")

    def count(self, measure: str) -> Column:
        return self._counted(F.col(f"n_{measure}"))

    def lines(self) -> Column:
        return self._counted(F.col(LINES))

    def sum_where(self, condition: Column, measure: str) -> Column:
        kind = self.rows.schema[f"sum_{measure}"].dataType
        # a condition that no line meets gives 0, one whose lines have no value too
        value = F.when(condition, F.coalesce(F.col(f"sum_{measure}"), F.lit(0).cast(kind))).otherwise(F.lit(0).cast(kind))
        none = F.sum(F.when(~condition | (F.col(f"n_{measure}") > 0), 1)).isNull()
        return F.when(~none, F.sum(value)).cast(kind)

    def lines_where(self, condition: Column) -> Column:
        return self._counted(F.when(condition, F.col(LINES)))

    def days(self, order_date: str, ship_date: str) -> tuple[Column, Column]:
        return self._total(f"sum_{DAYS}"), self.count(DAYS)

    def discounted(self, discount: str) -> Column:
        return F.col(DISCOUNTED)

    def year(self, date: str) -> Column:
        return F.col(YEAR)

    def month(self, date: str) -> Column:
        return F.col(MONTH)

    def in_years(self, date: str, years: Sequence[int]) -> Column:
        return F.col(YEAR).isin([int(y) for y in years])


Source = FactRows | Rollup


def roll_up(
    df: DataFrame,
    dimensions: Sequence[str] = GATE_DIMENSIONS,
    measures: Sequence[str] = GATE_MEASURES,
    order_date: str | None = "order_date",
    ship_date: str | None = "ship_date",
    discount: str | None = "discount",
) -> DataFrame:
    """Sums and counts of ``df`` by its dimensions, order year and month, and whether a line is discounted.

    A row has the dimensions, ``order_year`` and ``order_month`` (with
    ``order_date``), ``discounted`` (with ``discount``), ``lines``, ``sum_<m>``
    and ``n_<m>`` of each measure and of ``ship_days`` (with both dates). One
    scan and one aggregate with map-side sums; as many rows as combinations
    occur, however many lines there are.
    """
    keys = [F.col(d) for d in dimensions]
    if order_date is not None:
        keys += [F.year(order_date).alias(YEAR), F.month(order_date).alias(MONTH)]
    if discount is not None:
        keys.append(discounted(discount).alias(DISCOUNTED))
    totals = [F.count(F.lit(1)).alias(LINES)]
    for m in measures:
        totals += [F.sum(m).alias(f"sum_{m}"), F.count(m).alias(f"n_{m}")]
    if order_date is not None and ship_date is not None:
        days = ship_days(order_date, ship_date)
        totals += [F.sum(days).alias(f"sum_{DAYS}"), F.count(days).alias(f"n_{DAYS}")]
    return df.groupBy(*keys).agg(*totals)


def merge_rollups(*parts: DataFrame) -> DataFrame:
    """One rollup of several with the same columns, as of all their lines together."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    sums = [c for c in rows.columns if c == LINES or c.startswith(("sum_", "n_"))]
    return rows.groupBy(*[c for c in rows.columns if c not in sums]).agg(
        *[F.sum(c).cast(rows.schema[c].dataType).alias(c) for c in sums]
    )


def one_spelling(df: DataFrame, columns: Sequence[str], collation: str) -> DataFrame:
    """``df`` with each text in ``columns`` in the least spelling (by bytes) that equals it under ``collation``."""
    out = df
    for c in columns:
        same, least = f"_same_{c}", f"_least_{c}"
        spellings = (
            df.filter(F.col(c).isNotNull())
            .groupBy(F.collate(F.col(c), collation).alias(same))
            .agg(F.min(c).alias(least))
        )
        out = (
            out.join(sized_broadcast(spellings), F.collate(F.col(c), collation) == F.col(same), "left")
            .withColumn(c, F.col(least))
            .drop(same, least)
        )
    return out


def limited(
    df: DataFrame | Rollup,
    values: Values,
    column: str,
    dimensions: Sequence[str],
    collation: str | None = None,
    measures: Sequence[str] = (),
    order_date: str | None = None,
    ship_date: str | None = None,
    discount: str | None = None,
    broadcast_rows: int | None = None,
) -> Source:
    """The source of a gate over ``df`` whose ``column`` is among ``values``.

    Literals are a filter that reaches the scan. A table of values is a left
    semi join (its first column; NULL matches nothing, repeats do not matter)
    with the rolled-up rows, not with the fact's lines, so that no line is
    shuffled by a column that has a handful of values; the table is broadcast
    when it is proven small, else joined by shuffle. Under a ``collation`` the
    texts of ``dimensions`` are compared by it and shown in their least
    spelling; that too happens on rolled-up rows.
    """
    source: Source = df if isinstance(df, Rollup) else FactRows(df)
    table = isinstance(values, DataFrame)
    if (table or collation) and isinstance(source, FactRows):
        rolled = roll_up(source.rows, list(dict.fromkeys(dimensions)), measures, order_date, ship_date, discount)
        source = Rollup(rolled)
    text = F.collate(F.col(column), collation) if collation else F.col(column)
    if table:
        name = values.columns[0]
        wanted = values.select(F.col(f"`{name}`").alias("_wanted")).distinct()
        bound = {} if broadcast_rows is None else {"max_rows": broadcast_rows}
        source = replace(source, rows=source.rows.join(sized_broadcast(wanted, **bound), text == F.col("_wanted"), "left_semi"))
    elif values is not None:
        source = replace(source, rows=source.rows.filter(text.isin(list(values))))
    if collation:
        source = replace(source, rows=one_spelling(source.rows, list(dict.fromkeys(dimensions)), collation))
    return source
