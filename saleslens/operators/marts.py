"""Reporting marts: R01 reporting_fact, R02 date_dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleslens.constants import REFERENCE_CORE_MARKETS
from saleslens.functions.expressions import discounted, flag01, guarded_ship_days
from saleslens.functions.joins import sized_broadcast


def reporting_fact(
    df: DataFrame,
    core: Sequence[str] | DataFrame = REFERENCE_CORE_MARKETS,
    market: str = "market",
    with_year: bool = False,
) -> DataFrame:
    """The 12-column report fact with display names.

    Map-only: one projection, no shuffle. Core markets may be a table, whose
    first column lists them: it is joined to the distinct markets, and those
    (as many as there are markets) to the rows. Shipping days are NULL when the ship
    date is missing or earlier than the order date. ``with_year`` appends
    "Order Year", a column to partition the written fact by, so reports that
    filter on a year read only that year's files.
    """
    extra = [F.year("order_date").alias("Order Year")] if with_year else []
    if isinstance(core, DataFrame):
        wanted = core.select(F.col(f"`{core.columns[0]}`").alias("_wanted")).distinct()
        markets = df.select(F.col(market).alias("_core")).distinct().join(wanted, F.col("_core") == F.col("_wanted"), "left_semi")
        df = df.join(sized_broadcast(markets), F.col(market) == F.col("_core"), "left")
        is_core = F.col("_core").isNotNull()
    else:
        is_core = F.coalesce(F.col(market).isin(list(core)), F.lit(False))
    return df.select(
        F.col(market).alias("Market"),
        flag01(is_core).alias("Is Core Market"),
        F.col("country").alias("Country"),
        F.col("sales").alias("Sales"),
        F.col("discount").alias("Discount"),
        flag01(discounted("discount")).alias("Discount Applied"),
        F.col("category").alias("Category"),
        F.col("ship_mode").alias("Ship Mode"),
        F.col("order_date").alias("Order Date"),
        guarded_ship_days("order_date", "ship_date").alias("Shipping Days"),
        F.col("shipping_cost").alias("Shipping Cost"),
        F.col("segment").alias("Segment"),
        *extra,
    )


def date_dimension(df: DataFrame, date: str = "order_date") -> DataFrame:
    """One row per day from the first to the last date.

    A min/max aggregate (partial per task, one row to the final stage) then a
    ``sequence`` exploded into days: its size depends on the date span only,
    never on the row count. An empty input yields one all-NULL row, as the
    source's recursive calendar does.
    """
    bounds = df.agg(F.min(date).alias("_lo"), F.max(date).alias("_hi"))
    days = bounds.select(F.explode_outer(F.sequence("_lo", "_hi")).alias("Date"))
    return days.select(
        "Date",
        F.year("Date").alias("Year"),
        F.month("Date").alias("Month"),
        F.date_format("Date", "MMMM").alias("Month Name"),
        F.date_format("Date", "yyyy-MM").alias("Year Month"),
    )
