"""Presentation strings beside numeric results.

Convention (fixed, culture-independent): ``N<k>`` = thousands separators and
k decimals; ``P<k>`` = value x 100 with k decimals and a trailing '%'. Values
are rounded half-up first; ``format_number`` alone would round half-even.
NULL stays NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saleslens.functions.expressions import RATIO_SCALE, col


# The display formats the source analysis applies to each gate's
# numbers (N<k> / P<k>); "revenue_millions" is revenue / 1e6.
REPORT_FORMATS = {
    "market_performance": {
        "revenue_millions": "N2",
        "revenue_pct": "P2",
        "aov": "N0",
        "order_count": "N0",
        "order_count_pct": "P2",
    },
    "market_yoy": {"revenue_growth_yoy": "P2"},
    "category_performance": {
        "revenue_millions": "N2",
        "revenue_pct": "P2",
        "order_count": "N0",
        "order_count_pct": "P2",
    },
    "discount_over_index": {"market_revenue_pct": "P2", "discounted_revenue_pct": "P2"},
    "ship_mode_performance": {"avg_shipping_cost": "N0", "revenue_pct": "P2", "order_count_pct": "P2"},
    "segment_contribution": {"mean_pct": "P2", "std_dev": "P2", "cv_pct": "P2"},
    "organic_demand": {"discounted_order_pct": "P2"},
    "profit_ratio_by_year": {"negative_profit": "N0", "positive_profit": "N0", "negative_positive_ratio": "P2"},
}


def fmt_number(c: str | Column, digits: int = 0) -> Column:
    return F.format_number(F.round(col(c), digits), digits)


def fmt_percent(c: str | Column, digits: int = 2) -> Column:
    return F.concat(F.format_number(F.round(col(c) * 100, digits), digits), F.lit("%"))


def _apply(c: str, spec: str) -> Column:
    kind, digits = spec[0].upper(), int(spec[1:] or 0)
    if kind == "N":
        return fmt_number(c, digits)
    if kind == "P":
        return fmt_percent(c, digits)
    raise ValueError(f"unknown format spec {spec!r}; use N<k> or P<k>")


def with_millions(df: DataFrame, measure: str = "revenue") -> DataFrame:
    """Add ``<measure>_millions`` = measure / 1e6 (a double), as the source displays revenue."""
    return df.withColumn(f"{measure}_millions", F.col(measure).cast("double") / F.lit(1e6))


def format_report(df: DataFrame, spec: dict[str, str], suffix: str = "_fmt") -> DataFrame:
    """Add a formatted string column beside each numeric column named in ``spec``.

    ``spec`` maps column -> 'N0' | 'N2' | 'P2' ...; the numeric column stays,
    so downstream checks compare numbers and the string is for display only.
    Give it unrounded values (a gate's ``scale=None``): the string is rounded
    once. Doubles come out rounded to 6 digits beside their strings.
    """
    missing = [c for c in spec if c not in df.columns]
    if missing:
        raise ValueError(f"unknown columns {missing}")
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType) and f.name in spec}
    numbers = [
        F.round(c, RATIO_SCALE).alias(c) if c in doubles and spec[c][0].upper() == "P" else F.col(c) for c in df.columns
    ]
    return df.select(*numbers, *[_apply(c, s).alias(f"{c}{suffix}") for c, s in spec.items()])
