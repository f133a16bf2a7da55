"""Registry of named queries: every operator applied to the fixture fact.

Each entry is ``(spark, sf_dir) -> DataFrame``. Inputs are the fact landed
once as Parquet in the shared folder (``landed_sales_fact``); the clean fact
feeds audits and gates, the dirty variant feeds the market-hierarchy audit and
its correction. Parameters are the fixture stand-ins for the reference's
business literals (FIXTURES.md 2.1).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saleslens.constants import (
    FIXTURE_CORE_MARKETS as CORE,
)
from saleslens.constants import (
    FIXTURE_EXCLUDED_SEGMENT,
    FIXTURE_MARKET_RULES,
    FIXTURE_MULTI_MARKET_COUNTRIES,
    FIXTURE_PRODUCT_RULE,
    FIXTURE_SEGMENT_YEARS,
)
from saleslens.functions.formatting import REPORT_FORMATS, format_report, with_millions
from saleslens.operators import audit, corrections, gates, marts, profiling
from saleslens.operators.audit_scan import distinct_tuples, land_tuples, tuples_of
from saleslens.operators.rollup import Rollup, merge_rollups, roll_up
from saleslens.sources.csv_source import REJECT_REASON, csv_reader_options, land_clustered, load_sales_csv
from saleslens.sources.fixtures import (
    delete_folder,
    file_groups,
    finished,
    landed_sales_fact,
    landing_folder,
    mark_finished,
    sales_fact,
    sales_growing,
    sales_mixed_case,
    sales_sparse,
    sales_twins,
    write_once,
)
from saleslens.sources.schema import SALES_COLUMNS, sales_schema
from saleslens.sources.sinks import export

Query = Callable[[SparkSession, str], DataFrame]


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed_sales_fact(spark, sf_dir)


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed_sales_fact(spark, sf_dir, dirty=True)


def _market_fixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return corrections.apply_market_correction(dirty(spark, sf_dir), FIXTURE_MARKET_RULES)


def _product_fixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return corrections.apply_subcategory_correction(clean(spark, sf_dir), FIXTURE_PRODUCT_RULE)


def _csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R03 export then C02 load: the fact written as CSV and read back typed."""
    folder = f"{landing_folder(spark, sf_dir, 'clean')}-csv"
    path = write_once(spark, folder, lambda p: export(clean(spark, sf_dir), p, fmt="csv"))
    good, _rejects = load_sales_csv(spark, path, schema=sales_schema(row_id_type=T.LongType()))
    return good


def _csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C02 rejects: the fact as CSV with cells broken by row number, and why each row is turned away.

    Every 11th row has a price that is no number, every 13th a quantity out of
    its range, every 17th a market that is too long; the first reason in
    column order counts.
    """
    at = F.col("row_id")
    cells = clean(spark, sf_dir).select(
        *[
            F.when(at % 17 == 0, F.repeat(F.lit("M"), 31)).otherwise(F.col(c)).alias(c)
            if c == "market"
            else F.when(at % 11 == 0, F.lit("n/a")).otherwise(F.col(c).cast("string")).alias(c)
            if c == "sales"
            else F.when(at % 13 == 0, F.lit("256")).otherwise(F.col(c).cast("string")).alias(c)
            if c == "quantity"
            else F.col(c)
            for c in SALES_COLUMNS
        ]
    )
    folder = f"{landing_folder(spark, sf_dir, 'clean')}-bad-csv"
    path = write_once(spark, folder, lambda p: export(cells, p, fmt="csv"))
    _good, rejects = load_sales_csv(spark, path, schema=sales_schema(row_id_type=T.LongType()))
    return rejects.select("row_id", REJECT_REASON)


def _reporting_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R03 on its own: the report fact (display names with spaces) written as
    a CSV directory and read back with the fact's schema."""
    fact = marts.reporting_fact(clean(spark, sf_dir), CORE)
    folder = f"{landing_folder(spark, sf_dir, 'clean')}-report-csv"
    path = write_once(spark, folder, lambda p: export(fact, p, fmt="csv"))
    return spark.read.schema(fact.schema).options(**csv_reader_options()).csv(path)


#: The CSV of the fact is several times as large as the fact: it is made and loaded in waves of so many bytes of the
#: landed fact at least, and in so many waves at most.
WAVE_BYTES, WAVES = 128 << 20, 16


def _multiline_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C02 over cells with line breaks, quotes and separators in them, records cut by many tasks.

    The typed rows are landed once, wave by wave; the CSV of a wave is deleted
    when its rows are landed, so that only one is there at a time.
    """
    fact, schema = clean(spark, sf_dir), sales_schema(row_id_type=T.LongType())
    folder = f"{landing_folder(spark, sf_dir, 'clean')}-lines"

    def load(path: str) -> None:
        landed, text = finished(spark, landing_folder(spark, sf_dir, "clean")), f"{path}-csv"
        for i, files in enumerate(file_groups(spark, landed, WAVE_BYTES, WAVES)):
            cells = spark.read.schema(fact.schema).parquet(*files).withColumn("product_name", F.concat("product_name", F.lit('\n"a", b\n')))
            try:
                export(cells, text, fmt="csv")
                good, _rejects = load_sales_csv(spark, text, schema=schema)
                good.write.parquet(f"{path}/{i}")
            finally:
                delete_folder(spark, text)
        mark_finished(spark, path)

    path = write_once(spark, folder, load)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


# ------------------------------------------------------ shared states of the fact --


def rolled(spark: SparkSession, sf_dir: str) -> Rollup:
    """The gates' rollup, landed once."""
    folder = f"{landing_folder(spark, sf_dir, 'clean')}-rollup"
    path = write_once(spark, folder, lambda p: roll_up(clean(spark, sf_dir)).write.parquet(p))
    return Rollup(spark.read.parquet(path))


def _merged_rollup(spark: SparkSession, sf_dir: str) -> Rollup:
    """The rollup of two loads, merged."""
    fact = clean(spark, sf_dir)
    return Rollup(merge_rollups(roll_up(fact.filter("row_id % 3 = 0")), roll_up(fact.filter("row_id % 3 <> 0"))))


def audited(spark: SparkSession, sf_dir: str, tag: str) -> DataFrame:
    """The distinct combinations of one kind, landed once for all audits."""
    folder = f"{landing_folder(spark, sf_dir, 'clean')}-tuples"
    path = write_once(spark, folder, lambda p: land_tuples(clean(spark, sf_dir), p))
    return tuples_of(spark, path, tag)


def by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact landed in ranges of its order date."""
    folder = f"{landing_folder(spark, sf_dir, 'clean')}-by-date"
    return spark.read.parquet(write_once(spark, folder, lambda p: land_clustered(clean(spark, sf_dir), p, ["order_date"])))


def core_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core markets as a table: those of the fact's markets that are listed, some twice, and a NULL."""
    markets = clean(spark, sf_dir).select("market", "segment").distinct().filter(F.col("market").isin(list(CORE)))
    return markets.select("market").unionAll(markets.limit(1).select(F.lit(None).cast("string")))


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales_mixed_case(clean(spark, sf_dir))


#: Letters' case does not matter.
NO_CASE = "UTF8_LCASE"


def _by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14 as an update by key: orders are fixed by their number, some to NULL."""
    orders = clean(spark, sf_dir).groupBy("order_id").agg(F.min("market").alias("market"), F.min("segment").alias("segment"))
    fixes = orders.filter("cast(order_id as long) % 5 = 0").select(
        "order_id", F.when(F.expr("cast(order_id as long) % 10 = 0"), F.upper("segment")).alias("new_segment")
    )
    return corrections.apply_by_key(orders, fixes, "order_id", {"segment": "new_segment"})


def _sketched_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C04 from stored sketches of three loads: whether each estimate is within four standard deviations of the count."""
    fact = clean(spark, sf_dir)
    folder = f"{landing_folder(spark, sf_dir, 'clean')}-sketches"
    load = F.col("row_id") % 3

    def write(path: str) -> None:
        parts = [profiling.column_sketches(fact.filter(load == k)) for k in range(3)]
        parts[0].unionAll(parts[1]).unionAll(parts[2]).write.parquet(path)

    stored = spark.read.parquet(write_once(spark, folder, write))
    found = profiling.profile_of_sketches(profiling.merge_sketches(stored))
    exact = profiling.column_profile(fact).select("column_name", F.col("count_distinct").alias("exact"))
    off = F.abs(F.col("count_distinct") - F.col("exact"))
    bound = F.greatest(4 * 1.04 / 2 ** (profiling.SKETCH_BITS / 2) * F.col("exact"), F.lit(1.0))
    return found.join(exact, "column_name").select("column_name", "data_type", "null_count", (off <= bound).alias("within_bound"))


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales_sparse(clean(spark, sf_dir))


# The gates that have a formatted report, with unrounded numbers.
_EXACT: dict[str, Callable[[DataFrame], DataFrame]] = {
    "market_performance": lambda f: gates.market_performance(f, scale=None),
    "market_yoy": lambda f: gates.yoy_growth(f, core=CORE, scale=None),
    "category_performance": lambda f: gates.category_performance(f, CORE, scale=None),
    "discount_over_index": lambda f: gates.discount_over_index(f, CORE, scale=None),
    "ship_mode_performance": lambda f: gates.ship_mode_performance(f, CORE, scale=None),
    "segment_contribution": lambda f: gates.share_stability(f, CORE, FIXTURE_SEGMENT_YEARS, scale=None),
    "organic_demand": lambda f: gates.flag_rate(f, CORE, FIXTURE_EXCLUDED_SEGMENT, scale=None),
    "profit_ratio_by_year": lambda f: audit.signed_ratio_by_period(f, scale=None),
}


def _report(base: str) -> Query:
    """The gate's numbers plus display strings made from the unrounded values."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _EXACT[base](clean(spark, sf_dir))
        spec = REPORT_FORMATS[base]
        if "revenue_millions" in spec:
            df = with_millions(df)
        out = format_report(df, spec)
        return out.select(*[F.round(c, 6).alias(c) if t == "double" and c not in spec else c for c, t in out.dtypes])

    return build


def _gates(core) -> dict[str, Callable[..., DataFrame]]:
    """Every gate as a function of its input: the fact, or a rollup of it."""
    years, excluded = FIXTURE_SEGMENT_YEARS, FIXTURE_EXCLUDED_SEGMENT
    return {
        "market_performance": lambda f, **k: gates.market_performance(f, **k),
        "market_yoy": lambda f, **k: gates.yoy_growth(f, core=core, **k),
        "core_totals": lambda f, **k: gates.core_totals(f, core, **k),
        "category_performance": lambda f, **k: gates.category_performance(f, core, **k),
        "discount_over_index": lambda f, **k: gates.discount_over_index(f, core, **k),
        "ship_mode_performance": lambda f, **k: gates.ship_mode_performance(f, core, **k),
        "segment_monthly_share": lambda f, **k: gates.period_share(f, core, years, **k),
        "segment_contribution": lambda f, **k: gates.share_stability(f, core, years, **k),
        "organic_demand": lambda f, **k: gates.flag_rate(f, core, excluded, **k),
    }


def _shared_state_queries() -> dict[str, Query]:
    """Gates and audits over states of the fact that many of them share, and over other forms of their parameters."""
    q: dict[str, Query] = {
        "load_sales_csv_lines": _multiline_csv,
        "sample_rows_seeded": lambda s, d: profiling.sample_rows_by_hash(clean(s, d), ["row_id", "product_id"], 25, seed=7),
        "column_profile_sketched": _sketched_profile,
        "audit_tuples": lambda s, d: distinct_tuples(clean(s, d)),
        "hierarchy_check_market_country_shared": lambda s, d: audit.hierarchy_check(
            audited(s, d, "market_country"), "market", "country", "country_count_distinct", "market_country_map_count"
        ),
        "subcategory_product_count_shared": lambda s, d: audit.children_per_parent(
            audited(s, d, "category_subcategory_product"), ["category", "subcategory"], "product_name",
            "product_name_count", order=True,
        ),
        "products_multi_subcategory_shared": lambda s, d: audit.multi_parent_detail(
            audited(s, d, "category_subcategory_product")
        ),
        "region_reuses_market_shared": lambda s, d: audit.values_reused_across(
            audited(s, d, "market_region"), "market", "region"
        ),
        "product_name_multi_id_shared": lambda s, d: audit.multi_parent(
            audited(s, d, "product_names"), "product_id", "product_name", "product_id_count_distinct"
        ),
        "customer_name_fanout_shared": lambda s, d: audit.name_fanout(audited(s, d, "customers")),
        "gate_rollup": lambda s, d: rolled(s, d).rows,
        "gate_rollup_merged": lambda s, d: _merged_rollup(s, d).rows,
        "segment_monthly_share_by_date": lambda s, d: gates.period_share(by_date(s, d), CORE, FIXTURE_SEGMENT_YEARS),
        "reporting_fact_core_table": lambda s, d: marts.reporting_fact(clean(s, d), core_table(s, d)),
        "apply_by_key": _by_key,
        "apply_market_correction_no_case": lambda s, d: corrections.apply_market_correction(
            sales_mixed_case(dirty(s, d)), FIXTURE_MARKET_RULES, collation=NO_CASE
        )[0],
        "apply_subcategory_correction_no_case": lambda s, d: corrections.apply_subcategory_correction(
            clean(s, d), tuple(x.lower() for x in FIXTURE_PRODUCT_RULE), collation=NO_CASE
        )[1],
    }
    for name in _gates(CORE):
        q[f"{name}_rollup"] = lambda s, d, n=name: _gates(CORE)[n](rolled(s, d))
        if name != "market_performance":
            q[f"{name}_core_table"] = lambda s, d, n=name: _gates(core_table(s, d))[n](clean(s, d))
        q[f"{name}_no_case"] = lambda s, d, n=name: _gates([m.lower() for m in CORE])[n](mixed(s, d), collation=NO_CASE)
    for name in ("discount_over_index", "ship_mode_performance", "segment_contribution", "organic_demand"):
        q[f"{name}_sparse_rollup"] = lambda s, d, n=name: _gates(CORE)[n](Rollup(roll_up(sparse(s, d))))
    return q


def registry() -> dict[str, Query]:
    years, excluded = FIXTURE_SEGMENT_YEARS, FIXTURE_EXCLUDED_SEGMENT
    q: dict[str, Query] = {
        # F0 fixtures (the lazy star join itself, and its dirty variant)
        "sales_fact": lambda s, d: sales_fact(s, d),
        "sales_dirty": dirty,
        # sources
        "load_sales_csv": _csv_roundtrip,
        "load_sales_csv_rejects": _csv_rejects,
        "sample_rows": lambda s, d: profiling.sample_rows(clean(s, d), 10),
        # profiling and audit
        "column_profile": lambda s, d: profiling.column_profile(clean(s, d)),
        "column_profile_approx": lambda s, d: profiling.column_profile(clean(s, d), approx=True),
        "duplicate_rows": lambda s, d: profiling.duplicate_rows(clean(s, d)),
        "duplicate_rows_twins": lambda s, d: profiling.duplicate_rows(sales_twins(clean(s, d))),
        "duplicate_row_ids": lambda s, d: profiling.duplicate_rows(clean(s, d).select("row_id")),
        "identifier_cardinality_customer": lambda s, d: audit.identifier_cardinality(
            clean(s, d), "customer_name", "customer_id", "customer_count_distinct", "customer_id_count_distinct"
        ),
        "identifier_cardinality_product": lambda s, d: audit.identifier_cardinality(
            clean(s, d), "product_name", "product_id", "product_count_distinct", "product_id_count_distinct"
        ),
        "market_country_count": lambda s, d: audit.children_per_parent(
            clean(s, d), "market", "country", "country_count"
        ),
        "category_subcategory_count": lambda s, d: audit.children_per_parent(
            clean(s, d), "category", "subcategory", "subcategory_count"
        ),
        "subcategory_product_count": lambda s, d: audit.children_per_parent(
            clean(s, d), ["category", "subcategory"], "product_name", "product_name_count", order=True
        ),
        "market_region_pairs": lambda s, d: audit.distinct_pairs(clean(s, d), "market", "region"),
        "hierarchy_check_market_country": lambda s, d: audit.hierarchy_check(
            dirty(s, d), "market", "country", "country_count_distinct", "market_country_map_count"
        ),
        "hierarchy_check_category_subcategory": lambda s, d: audit.hierarchy_check(
            clean(s, d), "category", "subcategory", "subcategory_count_distinct", "category_subcategory_map_count"
        ),
        "hierarchy_check_category_subcategory_sparse": lambda s, d: audit.hierarchy_check(
            sparse(s, d), "category", "subcategory", "subcategory_count_distinct", "category_subcategory_map_count"
        ),
        "hierarchy_check_subcategory_product": lambda s, d: audit.hierarchy_check(
            clean(s, d), "subcategory", "product_name", "product_count_distinct", "subcategory_product_map_count"
        ),
        "numeric_range_stats": lambda s, d: profiling.numeric_range_stats(clean(s, d)),
        "countries_multi_market": lambda s, d: audit.multi_parent(
            dirty(s, d), "market", "country", "market_count_distinct"
        ),
        "product_name_multi_id": lambda s, d: audit.multi_parent(
            clean(s, d), "product_id", "product_name", "product_id_count_distinct"
        ),
        "country_market_pairs": lambda s, d: audit.pairs_for(
            dirty(s, d), "country", "market", FIXTURE_MULTI_MARKET_COUNTRIES
        ),
        "products_multi_subcategory": lambda s, d: audit.multi_parent_detail(clean(s, d)),
        "region_reuses_market": lambda s, d: audit.values_reused_across(clean(s, d), "market", "region"),
        "customer_name_fanout": lambda s, d: audit.name_fanout(clean(s, d)),
        "negative_profit_rows": lambda s, d: audit.negative_rows(clean(s, d), "profit"),
        "profit_ratio_by_year": lambda s, d: audit.signed_ratio_by_period(clean(s, d)),
        # corrections and field policy
        "market_correction_map": lambda s, d: corrections.market_correction_map(dirty(s, d), FIXTURE_MARKET_RULES),
        "apply_market_correction": lambda s, d: _market_fixed(s, d)[0],
        "market_correction_report": lambda s, d: _market_fixed(s, d)[1],
        "hierarchy_check_market_country_corrected": lambda s, d: audit.hierarchy_check(
            _market_fixed(s, d)[0], "market", "country", "country_count_distinct", "market_country_map_count"
        ),
        "subcategory_correction_map": lambda s, d: corrections.subcategory_correction_map(
            clean(s, d), FIXTURE_PRODUCT_RULE
        ),
        "apply_subcategory_correction": lambda s, d: _product_fixed(s, d)[0],
        "subcategory_correction_report": lambda s, d: _product_fixed(s, d)[1],
        "hierarchy_check_subcategory_product_corrected": lambda s, d: audit.hierarchy_check(
            _product_fixed(s, d)[0], "subcategory", "product_name", "product_count_distinct",
            "subcategory_product_map_count",
        ),
        "analysis_columns": lambda s, d: corrections.apply_field_policy(clean(s, d)),
        # analysis gates
        "analysis_snapshot": lambda s, d: gates.analysis_snapshot(clean(s, d)),
        "market_performance": lambda s, d: gates.market_performance(clean(s, d)),
        "market_yoy": lambda s, d: gates.yoy_growth(clean(s, d), core=CORE),
        "market_stability_verdict": lambda s, d: gates.stability_verdict(gates.yoy_growth(clean(s, d), core=CORE)),
        "market_stability_verdict_growing": lambda s, d: gates.stability_verdict(
            gates.yoy_growth(sales_growing(clean(s, d)), core=CORE)
        ),
        "core_totals": lambda s, d: gates.core_totals(clean(s, d), CORE),
        "category_performance": lambda s, d: gates.category_performance(clean(s, d), CORE),
        "discount_over_index": lambda s, d: gates.discount_over_index(clean(s, d), CORE),
        "ship_mode_performance": lambda s, d: gates.ship_mode_performance(clean(s, d), CORE),
        "segment_monthly_share": lambda s, d: gates.period_share(clean(s, d), CORE, years),
        "segment_contribution": lambda s, d: gates.share_stability(clean(s, d), CORE, years),
        "organic_demand": lambda s, d: gates.flag_rate(clean(s, d), CORE, excluded),
        # the same gates over a fact with NULL measures, dates and groups
        "category_performance_sparse": lambda s, d: gates.category_performance(sparse(s, d), CORE),
        "discount_over_index_sparse": lambda s, d: gates.discount_over_index(sparse(s, d), CORE),
        "ship_mode_performance_sparse": lambda s, d: gates.ship_mode_performance(sparse(s, d), CORE),
        "segment_contribution_sparse": lambda s, d: gates.share_stability(sparse(s, d), CORE, years),
        "organic_demand_sparse": lambda s, d: gates.flag_rate(sparse(s, d), CORE, excluded),
        # reporting marts and formatted reports
        "reporting_fact": lambda s, d: marts.reporting_fact(clean(s, d), CORE),
        "export_csv": _reporting_csv,
        "date_dimension": lambda s, d: marts.date_dimension(clean(s, d)),
        "market_performance_report": _report("market_performance"),
        "profit_ratio_report": _report("profit_ratio_by_year"),
        "market_yoy_report": _report("market_yoy"),
        "category_performance_report": _report("category_performance"),
        "discount_over_index_report": _report("discount_over_index"),
        "ship_mode_performance_report": _report("ship_mode_performance"),
        "segment_contribution_report": _report("segment_contribution"),
        "organic_demand_report": _report("organic_demand"),
    }
    return q | _shared_state_queries()
