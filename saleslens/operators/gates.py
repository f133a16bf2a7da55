"""Decision gates: A01-A10.

Shared plan shape: filter (pushed into the scan) -> one hash aggregate with
map-side partial aggregation -> ratios against totals summed from the
aggregated rows (a scalar subquery evaluated once). No gate joins the fact
table to anything: the groups partition the filtered rows, so their sums are
the totals, and no separate totals query over the fact is needed.

Every gate takes the fact or a ``Rollup`` of it, which serves all gates from
one scan. Core markets are literals or a table (``rollup.limited``), and texts
may be compared under a collation.

Ratios follow ``functions.expressions.ratio``: exact decimal sums, double
division, rounded to 6 digits (``scale=None`` leaves them unrounded, for what
formats or compares them), NULL on a zero denominator.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saleslens.constants import (
    REFERENCE_CORE_MARKETS,
    REFERENCE_EXCLUDED_SEGMENT,
    REFERENCE_SEGMENT_YEARS,
    REFERENCE_SNAPSHOT_COLUMNS,
)
from saleslens.functions.expressions import RATIO_SCALE, in_years, ratio, rounded, yes_no
from saleslens.operators.rollup import Rollup, Values, limited


def with_totals(agg: DataFrame, *cols: str) -> DataFrame:
    """Add ``total_<c>`` = sum of ``c`` over all rows of an aggregated frame.

    The totals are one uncorrelated scalar subquery over the aggregated rows
    that sums every numeric column, so that it needs the very aggregate of the
    group branch and reuses its exchange: the fact is scanned once. No join is
    involved and no task ever holds all group rows, unlike a window over all
    groups.
    """
    numeric = [f.name for f in agg.schema.fields if isinstance(f.dataType, T.NumericType)]
    totals = agg.select(F.struct(*[F.sum(c).alias(c) for c in numeric])).scalar()
    return agg.select("*", *[totals.getField(c).alias(f"total_{c}") for c in cols])


def analysis_snapshot(
    df: DataFrame,
    columns: Sequence[str] = REFERENCE_SNAPSHOT_COLUMNS,
    persist: bool = False,
) -> DataFrame:
    """The 10 columns every gate reads.

    Over Parquet, Catalyst already prunes each gate's scan, so persisting only
    pays when several gates run on an expensive (non-columnar) input; it uses
    MEMORY_AND_DISK so a lost executor's blocks are recomputed, not lost.
    """
    out = df.select(*columns)
    return out.persist(StorageLevel.MEMORY_AND_DISK) if persist else out


def contribution(
    df: DataFrame | Rollup,
    by: str = "market",
    distinct_col: str | None = "country",
    measure: str = "sales",
    scale: int | None = RATIO_SCALE,
    collation: str | None = None,
) -> DataFrame:
    """Per group: distinct count, revenue, revenue share, mean line value,
    line count and line-count share; largest revenue first (A02 market_performance).

    ``order_count`` counts lines (one row = one order line) and ``aov`` is the
    mean line value, as in the source analysis.
    """
    # One row for each (group, distinct value) first, then one for each group:
    # plain aggregates, so that the totals can reuse the exchange between them.
    keys = [by, distinct_col] if distinct_col else [by]
    src = limited(df, None, by, keys, collation, [measure])
    agg = src.rows.groupBy(*keys).agg(
        src.sum(measure).alias("revenue"), src.count(measure).alias("_valued"), src.lines().alias("order_count")
    )
    if distinct_col:
        kind = agg.schema["revenue"].dataType
        agg = agg.groupBy(by).agg(
            F.count(distinct_col).alias(f"{distinct_col}_count"),
            F.sum("revenue").cast(kind).alias("revenue"),
            F.sum("_valued").alias("_valued"),
            F.sum("order_count").alias("order_count"),
        )
    out = with_totals(agg, "revenue", "order_count")
    keep = [by] + ([f"{distinct_col}_count"] if distinct_col else [])
    return out.select(
        *keep,
        "revenue",
        ratio("revenue", "total_revenue", scale=scale).alias("revenue_pct"),
        ratio("revenue", "_valued", scale=scale).alias("aov"),
        "order_count",
        ratio("order_count", "total_order_count", scale=scale).alias("order_count_pct"),
    ).orderBy(F.col("revenue").desc())


def market_performance(
    df: DataFrame | Rollup,
    market: str = "market",
    country: str = "country",
    measure: str = "sales",
    scale: int | None = RATIO_SCALE,
    collation: str | None = None,
) -> DataFrame:
    """A02 with the source's column roles."""
    return contribution(df, by=market, distinct_col=country, measure=measure, scale=scale, collation=collation)


def yoy_growth(
    df: DataFrame | Rollup,
    by: str = "market",
    date: str = "order_date",
    measure: str = "sales",
    core: Values = REFERENCE_CORE_MARKETS,
    scale: int | None = RATIO_SCALE,
    collation: str | None = None,
) -> DataFrame:
    """Yearly revenue per group and growth over the previous present year.

    lag(revenue, 1, 0): the first year of a group, and any year after a
    zero-revenue year, has NULL growth. "Previous" is the previous year that
    has rows, not necessarily the calendar year before. The window runs over
    (#groups x #years) aggregated rows.
    """
    w = Window.partitionBy(by).orderBy("order_year")
    src = limited(df, core, by, [by], collation, [measure], order_date=date)
    yearly = src.rows.groupBy(src.year(date).alias("order_year"), F.col(by)).agg(src.sum(measure).alias("revenue"))
    lagged = yearly.withColumn("lag_revenue", F.lag("revenue", 1, 0).over(w))
    return lagged.select(
        "order_year",
        by,
        "revenue",
        "lag_revenue",
        ratio(F.col("revenue") - F.col("lag_revenue"), "lag_revenue", scale=scale).alias("revenue_growth_yoy"),
    )


def stability_verdict(yoy: DataFrame, by: str = "market", max_negative_years: int = 1) -> DataFrame:
    """Pass/fail per group from a yoy_growth result (A03v).

    Fails when more than ``max_negative_years`` years show negative growth, or
    when two adjacent reported years both decline. Both flags are reported.
    The sign is that of the revenues themselves, not of the rounded growth.
    """
    w = Window.partitionBy(by).orderBy("order_year")
    now, before = F.col("revenue"), F.col("lag_revenue")
    neg = F.coalesce(F.when(before != 0, (now - before) * F.signum(before) < 0), F.lit(False))
    flagged = yoy.select(by, "order_year", neg.alias("_neg")).withColumn(
        "_prev_neg", F.lag("_neg", 1, False).over(w)
    )
    return (
        flagged.groupBy(by)
        .agg(
            F.count_if("_neg").alias("negative_yoy_years"),
            F.max(F.col("_neg") & F.col("_prev_neg")).alias("consecutive_decline"),
        )
        .select(
            by,
            "negative_yoy_years",
            "consecutive_decline",
            ((F.col("negative_yoy_years") <= max_negative_years) & ~F.col("consecutive_decline")).alias("stable"),
        )
    )


def core_totals(
    df: DataFrame | Rollup,
    core: Values = REFERENCE_CORE_MARKETS,
    market: str = "market",
    measure: str = "sales",
    collation: str | None = None,
) -> DataFrame:
    """One row: revenue and line count over the core markets."""
    src = limited(df, core, market, [market], collation, [measure])
    return src.rows.agg(src.sum(measure).alias("total_revenue"), src.lines().alias("total_order_count"))


def category_performance(
    df: DataFrame | Rollup,
    core: Values = REFERENCE_CORE_MARKETS,
    by: str = "category",
    market: str = "market",
    measure: str = "sales",
    scale: int | None = RATIO_SCALE,
    collation: str | None = None,
) -> DataFrame:
    """Per category within core markets: revenue, share of core revenue, lines,
    share of core lines; largest revenue first (A06).

    The core totals are the sums of the category rows, so no second scan and
    no join (the source cross-joins a precomputed one-row total).
    """
    src = limited(df, core, market, [market, by], collation, [measure])
    agg = src.rows.groupBy(by).agg(src.sum(measure).alias("revenue"), src.lines().alias("order_count"))
    return with_totals(agg, "revenue", "order_count").select(
        by,
        "revenue",
        ratio("revenue", "total_revenue", scale=scale).alias("revenue_pct"),
        "order_count",
        ratio("order_count", "total_order_count", scale=scale).alias("order_count_pct"),
    ).orderBy(F.col("revenue").desc())


def discount_over_index(
    df: DataFrame | Rollup,
    core: Values = REFERENCE_CORE_MARKETS,
    by: str = "market",
    discount: str = "discount",
    measure: str = "sales",
    scale: int | None = RATIO_SCALE,
    collation: str | None = None,
) -> DataFrame:
    """Per core market: share of core revenue vs share of all discounted core
    revenue, and whether the latter is larger ('Yes'/'No'); largest share first (A07).

    One aggregate with a conditional sum replaces the source's aggregate over
    (market, discount flag) followed by a re-aggregation.
    """
    src = limited(df, core, by, [by], collation, [measure], discount=discount)
    agg = src.rows.groupBy(by).agg(
        src.sum(measure).alias("revenue"),
        src.sum_where(src.discounted(discount), measure).alias("discounted_revenue"),
    )
    raw_share = F.col("revenue").cast("double") / F.nullif(F.col("total_revenue").cast("double"), F.lit(0.0))
    # a market without discounted revenue has a share of 0, also when no market has any
    raw_disc = F.when(F.col("discounted_revenue") == 0, F.lit(0.0)).otherwise(
        F.col("discounted_revenue").cast("double") / F.nullif(F.col("total_discounted_revenue").cast("double"), F.lit(0.0))
    )
    shares = with_totals(agg, "revenue", "discounted_revenue").select(
        by, "revenue", "discounted_revenue", raw_share.alias("_s"), raw_disc.alias("_d")
    )
    return shares.select(
        by,
        "revenue",
        "discounted_revenue",
        rounded("_s", scale).alias("market_revenue_pct"),
        rounded("_d", scale).alias("discounted_revenue_pct"),
        yes_no(F.col("_d") > F.col("_s")).alias("discount_over_indexes_scale"),
    ).orderBy(F.col("market_revenue_pct").desc())


def ship_mode_performance(
    df: DataFrame | Rollup,
    core: Values = REFERENCE_CORE_MARKETS,
    by: str = "ship_mode",
    market: str = "market",
    order_date: str = "order_date",
    ship_date: str = "ship_date",
    cost: str = "shipping_cost",
    measure: str = "sales",
    scale: int | None = RATIO_SCALE,
    collation: str | None = None,
) -> DataFrame:
    """Per ship mode in core markets: mean shipping days, mean shipping cost,
    revenue share and line share; fastest first (A08).

    ``avg_ship_day`` is the integer mean truncated toward zero, as an integer
    AVG is in the source; ``avg_ship_day_exact`` is the real mean. Days are
    not guarded here (a ship date before the order date counts negative),
    unlike the reporting fact.
    """
    src = limited(
        df, core, market, [market, by], collation, [measure, cost], order_date=order_date, ship_date=ship_date
    )
    days, timed = src.days(order_date, ship_date)
    agg = src.rows.groupBy(by).agg(
        days.alias("_sd"),
        timed.alias("_nd"),
        src.sum(cost).alias("_sc"),
        src.count(cost).alias("_nc"),
        src.sum(measure).alias("revenue"),
        src.lines().alias("order_count"),
    )
    return with_totals(agg, "revenue", "order_count").select(
        by,
        F.expr("_sd div nullif(_nd, 0)").alias("avg_ship_day"),
        ratio("_sd", "_nd", scale=scale).alias("avg_ship_day_exact"),
        ratio("_sc", "_nc", scale=scale).alias("avg_shipping_cost"),
        "revenue",
        ratio("revenue", "total_revenue", scale=scale).alias("revenue_pct"),
        "order_count",
        ratio("order_count", "total_order_count", scale=scale).alias("order_count_pct"),
    ).orderBy("avg_ship_day")


def _monthly_shares(
    df: DataFrame | Rollup,
    core: Values,
    years: Sequence[int],
    by: str,
    market: str,
    date: str,
    measure: str,
    collation: str | None = None,
) -> DataFrame:
    """(order_year, order_month, group, monthly_revenue, unrounded share of the month)."""
    if not isinstance(df, Rollup):
        df = df.filter(in_years(date, years))  # before anything is rolled up
    src = limited(df, core, market, [market, by], collation, [measure], order_date=date)
    monthly = (
        src.rows.filter(src.in_years(date, years))
        .groupBy(src.year(date).alias("order_year"), src.month(date).alias("order_month"), F.col(by))
        .agg(src.sum(measure).alias("monthly_revenue"))
    )
    # Month totals are joined back rather than windowed, so a month's rows are
    # never gathered into one task; the totals have one row per month (bounded
    # by the date span), and AQE broadcasts them once their size is measured.
    month_totals = monthly.groupBy("order_year", "order_month").agg(F.sum("monthly_revenue").alias("_month_total"))
    return monthly.join(month_totals, ["order_year", "order_month"]).withColumn(
        "_share",
        F.col("monthly_revenue").cast("double") / F.nullif(F.col("_month_total").cast("double"), F.lit(0.0)),
    )


def period_share(
    df: DataFrame | Rollup,
    core: Values = REFERENCE_CORE_MARKETS,
    years: Sequence[int] = REFERENCE_SEGMENT_YEARS,
    by: str = "segment",
    market: str = "market",
    date: str = "order_date",
    measure: str = "sales",
    scale: int | None = RATIO_SCALE,
    collation: str | None = None,
) -> DataFrame:
    """Each group's share of its month's revenue, core markets, chosen years.

    The month totals come from the aggregated (year, month, group) rows, not
    from a second scan. The year filter is a date range, so it reaches the
    Parquet scan.
    """
    shares = _monthly_shares(df, core, years, by, market, date, measure, collation)
    return shares.select(
        "order_year", "order_month", by, "monthly_revenue", rounded("_share", scale).alias("contribution_pct")
    )


def share_stability(
    df: DataFrame | Rollup,
    core: Values = REFERENCE_CORE_MARKETS,
    years: Sequence[int] = REFERENCE_SEGMENT_YEARS,
    by: str = "segment",
    market: str = "market",
    date: str = "order_date",
    measure: str = "sales",
    scale: int | None = RATIO_SCALE,
    collation: str | None = None,
) -> DataFrame:
    """Per group: mean monthly share, sample std-dev, coefficient of variation.

    Computed from unrounded shares; a group seen in one month only has a
    NULL std-dev and CV.
    """
    shares = _monthly_shares(df, core, years, by, market, date, measure, collation)
    stats = shares.groupBy(by).agg(F.avg("_share").alias("_m"), F.stddev_samp("_share").alias("_sd"))
    return stats.select(
        by,
        rounded("_m", scale).alias("mean_pct"),
        rounded("_sd", scale).alias("std_dev"),
        rounded(F.col("_sd") / F.nullif(F.col("_m"), F.lit(0.0)), scale).alias("cv_pct"),
    )


def flag_rate(
    df: DataFrame | Rollup,
    core: Values = REFERENCE_CORE_MARKETS,
    exclude: str | None = REFERENCE_EXCLUDED_SEGMENT,
    by: str = "segment",
    market: str = "market",
    discount: str = "discount",
    scale: int | None = RATIO_SCALE,
    collation: str | None = None,
) -> DataFrame:
    """Per group (one excluded): share of lines that carry a discount (A10 organic_demand).

    Excluding a value with ``!=`` also drops NULL groups, as the source does.
    """
    src = limited(df, core, market, [market, by], collation, discount=discount)
    rows = src.rows
    if exclude is not None:
        rows = rows.filter((F.collate(F.col(by), collation) if collation else F.col(by)) != exclude)
    agg = rows.groupBy(by).agg(
        src.lines_where(src.discounted(discount)).alias("discounted_order_count"),
        src.lines().alias("order_count"),
    )
    return agg.select(
        by,
        "discounted_order_count",
        "order_count",
        ratio("discounted_order_count", "order_count", scale=scale).alias("discounted_order_pct"),
    )
