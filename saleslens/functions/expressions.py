"""Column expressions shared by the operators (all native Spark functions)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

RATIO_SCALE = 6


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: str | Column, den: str | Column, scale: int | None = RATIO_SCALE) -> Column:
    """num / den in double, rounded to ``scale`` digits (None: not rounded); NULL when den is 0.

    Sums are kept exact (decimal) until this point, then both sides are cast
    to double, so results do not depend on an engine's decimal-division type.
    Every division is guarded: a zero denominator gives NULL, never an error.
    """
    d = col(den).cast("double")
    return rounded(col(num).cast("double") / F.nullif(d, F.lit(0.0)), scale)


def rounded(value: str | Column, scale: int | None) -> Column:
    """``value`` rounded for output; whatever still compares or formats it asks for no scale."""
    return col(value) if scale is None else F.round(value, scale)


def pair_key(a: str | Column, b: str | Column, mode: str = "strict") -> Column:
    """Key for counting distinct (a, b) pairs.

    ``strict``: the pair itself (a struct), so ``('x','yz')`` and ``('xy','z')``
    stay apart and NULL members are kept. ``concat``: the source system's
    separator-less concatenation with NULL read as '' (for parity with it).
    """
    if mode == "strict":
        return F.struct(col(a).alias("a"), col(b).alias("b"))
    if mode == "concat":
        return F.concat(F.coalesce(col(a), F.lit("")), F.coalesce(col(b), F.lit("")))
    raise ValueError("mode must be 'strict' or 'concat'")


def ship_days(order_date: str | Column, ship_date: str | Column) -> Column:
    """Day boundaries crossed from order to ship (negative when shipped first)."""
    return F.date_diff(col(ship_date), col(order_date))


def guarded_ship_days(order_date: str | Column, ship_date: str | Column) -> Column:
    """Shipping days, NULL when ship date is missing or before the order date."""
    s, o = col(ship_date), col(order_date)
    return F.when(s.isNotNull() & (s >= o), F.date_diff(s, o))


def discounted(discount: str | Column) -> Column:
    """True only for a positive discount; NULL discount counts as not discounted."""
    return F.coalesce(col(discount) > 0, F.lit(False))


def flag01(cond: Column) -> Column:
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def yes_no(cond: Column) -> Column:
    return F.when(cond, F.lit("Yes")).otherwise(F.lit("No"))


def _year_runs(years: Iterable[int]) -> list[tuple[int, int]]:
    runs: list[tuple[int, int]] = []
    for y in sorted(set(int(v) for v in years)):
        if runs and runs[-1][1] == y - 1:
            runs[-1] = (runs[-1][0], y)
        else:
            runs.append((y, y))
    return runs


def in_years(date_col: str | Column, years: Sequence[int]) -> Column:
    """``year(d) IN years`` written as date ranges so Parquet can skip row groups.

    A year() predicate cannot be pushed to the scan; ``d >= Jan 1 and d < Jan 1
    of the next year`` (one range per run of consecutive years) can.
    """
    d = col(date_col)
    runs = _year_runs(years)
    if not runs:
        return F.lit(False)
    ranges = [
        (d >= F.lit(dt.date(lo, 1, 1))) & (d < F.lit(dt.date(hi + 1, 1, 1))) for lo, hi in runs
    ]
    return reduce(lambda a, b: a | b, ranges)
