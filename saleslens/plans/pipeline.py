"""End-to-end run: clean -> analyse -> report, with every result written out.

Stages (each output is a directory under ``out_dir``):

1. ``ingest``   a CSV path is parsed once and landed partitioned by
                ingest_status (good / rejected, with the reason), or
   ``raw``      a given DataFrame is landed as Parquet.
2. ``audit/*``  profile, duplicates, hierarchy and key checks on the raw data.
3. ``clean``    rule-based corrections applied (reports in ``corrections/*``),
                landed once: the lineage cut every later stage reads from.
4. ``gates/*``  the decision gates over the cleaned data, and ``reports/*``
                the same with formatted strings.
5. ``marts/*``  reporting fact and date dimension.

Every step is a DataFrame job on the executors; the driver only builds plans
and writes small audit results. Re-running overwrites each output.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from saleslens.constants import (
    REFERENCE_CORE_MARKETS,
    REFERENCE_EXCLUDED_SEGMENT,
    REFERENCE_MARKET_RULES,
    REFERENCE_MULTI_MARKET_COUNTRIES,
    REFERENCE_PRODUCT_RULE,
    REFERENCE_SEGMENT_YEARS,
)
from saleslens.functions.formatting import REPORT_FORMATS, format_report, with_millions
from saleslens.operators import audit, corrections, gates, marts, profiling
from saleslens.operators.audit_scan import AUDIT_TUPLES, land_tuples, tuples_of
from saleslens.operators.rollup import Rollup, Values, roll_up
from saleslens.sources.csv_source import land_clustered, land_parquet, land_sales_csv
from saleslens.sources.sinks import export


def run_pipeline(
    spark: SparkSession,
    source: str | DataFrame,
    out_dir: str,
    core: Values = REFERENCE_CORE_MARKETS,
    years: Sequence[int] = REFERENCE_SEGMENT_YEARS,
    excluded_segment: str | None = REFERENCE_EXCLUDED_SEGMENT,
    market_rules: Sequence[tuple[str, str, str]] = REFERENCE_MARKET_RULES,
    product_rule: tuple[str, str, str] | Sequence[tuple[str, str, str]] = REFERENCE_PRODUCT_RULE,
    multi_market_countries: Sequence[str] = REFERENCE_MULTI_MARKET_COUNTRIES,
    csv_marts: bool = False,
    processed_csv: bool = False,
    partition_reporting_by_year: bool = False,
    parallel_jobs: int = 4,
    quoted_line_breaks: bool = True,
    cluster_by_date: bool = False,
) -> dict[str, str]:
    """Run the whole analysis; return {output name: path}.

    Independent outputs of one stage (the audits, the gates) are submitted
    as concurrent Spark jobs from ``parallel_jobs`` driver threads, so small
    audit jobs overlap instead of leaving the cluster idle between them.
    ``quoted_line_breaks=False`` takes every line of a CSV source as a row;
    ``cluster_by_date`` lands the clean table in ranges of its order date, so
    that readers with a date filter skip row groups, for one more shuffle.
    ``core`` may be a table whose first column lists the core markets.
    """
    out = out_dir.rstrip("/")
    written: dict[str, str] = {}

    def save(
        name: str, df: DataFrame, fmt: str = "parquet", single_file: bool = False, partition_by: list[str] | None = None
    ) -> None:
        path = f"{out}/{name}"
        export(df, path, fmt=fmt, single_file=single_file, partition_by=partition_by)
        written[name] = path

    def save_all(prefix: str, frames: dict[str, DataFrame]) -> None:
        with ThreadPoolExecutor(max_workers=max(1, parallel_jobs)) as pool:
            futures = [pool.submit(save, f"{prefix}/{name}", df) for name, df in frames.items()]
            for f in futures:
                f.result()

    # 1. land the raw data
    if isinstance(source, str):
        # one parse of the text: good rows and rejects land together
        raw, _rejects = land_sales_csv(spark, source, f"{out}/ingest", quoted_line_breaks=quoted_line_breaks)
        written["ingest"] = f"{out}/ingest"
    else:
        land_parquet(source, f"{out}/raw")
        written["raw"] = f"{out}/raw"
        raw = spark.read.parquet(f"{out}/raw")

    # 2. audits on the raw data (small results). Those that look at nothing but
    # distinct combinations of texts share one scan that lands them all.
    land_tuples(raw, f"{out}/audit/tuples")
    written["audit/tuples"] = f"{out}/audit/tuples"
    lands, regions, filed, named, buyers = (tuples_of(spark, f"{out}/audit/tuples", tag) for tag in AUDIT_TUPLES)
    audits = {
        "column_profile": profiling.column_profile(raw),
        "column_sketches": profiling.column_sketches(raw),
        "duplicate_rows": profiling.duplicate_rows(raw),
        "numeric_range_stats": profiling.numeric_range_stats(raw),
        "sample_rows": profiling.sample_rows(raw),
        "identifier_cardinality_customer": audit.identifier_cardinality(buyers, "customer_name", "customer_id"),
        "identifier_cardinality_product": audit.identifier_cardinality(named, "product_name", "product_id"),
        "market_country_count": audit.children_per_parent(lands, "market", "country", "country_count"),
        "market_region_pairs": audit.distinct_pairs(regions, "market", "region"),
        "hierarchy_check_market_country": audit.hierarchy_check(lands, "market", "country"),
        "category_subcategory_count": audit.children_per_parent(filed, "category", "subcategory", "subcategory_count"),
        "hierarchy_check_category_subcategory": audit.hierarchy_check(filed, "category", "subcategory"),
        "subcategory_product_count": audit.children_per_parent(
            filed, ["category", "subcategory"], "product_name", "product_name_count", order=True
        ),
        "hierarchy_check_subcategory_product": audit.hierarchy_check(filed, "subcategory", "product_name"),
        "countries_multi_market": audit.multi_parent(lands, "market", "country"),
        "country_market_pairs": audit.pairs_for(lands, "country", "market", multi_market_countries),
        "products_multi_subcategory": audit.multi_parent_detail(filed),
        "region_reuses_market": audit.values_reused_across(regions, "market", "region"),
        "customer_name_fanout": audit.name_fanout(buyers),
        "product_name_multi_id": audit.multi_parent(named, "product_id", "product_name"),
        "negative_profit_rows": audit.negative_rows(raw, "profit"),
        "profit_ratio_by_year": audit.signed_ratio_by_period(raw),
    }
    save_all("audit", audits)

    # 3. corrections, landed once
    fixed, market_report = corrections.apply_market_correction(raw, market_rules)
    fixed, product_report = corrections.apply_subcategory_correction(fixed, product_rule)
    save_all(
        "corrections",
        {
            "market_correction_map": corrections.market_correction_map(raw, market_rules),
            "subcategory_correction_map": corrections.subcategory_correction_map(raw, product_rule),
            "market_report": market_report,
            "subcategory_report": product_report,
        },
    )
    if cluster_by_date:
        land_clustered(fixed, f"{out}/clean", ["order_date"])
    else:
        land_parquet(fixed, f"{out}/clean")
    written["clean"] = f"{out}/clean"
    clean = spark.read.parquet(f"{out}/clean")
    save_all(
        "audit",
        {
            "hierarchy_check_market_country_corrected": audit.hierarchy_check(clean, "market", "country"),
            "hierarchy_check_subcategory_product_corrected": audit.hierarchy_check(
                clean, "subcategory", "product_name"
            ),
        },
    )
    analysis = corrections.apply_field_policy(clean)
    if processed_csv:
        # the processed dataset handed to reporting tools: corrected rows,
        # excluded fields dropped, as a CSV directory (one part per task)
        save("processed_csv", analysis, fmt="csv")

    # 4. decision gates, all from one rollup of the fact
    land_parquet(roll_up(analysis), f"{out}/gates/rollup")
    written["gates/rollup"] = f"{out}/gates/rollup"
    totals = Rollup(spark.read.parquet(f"{out}/gates/rollup"))
    yoy = gates.yoy_growth(totals, core=core)
    gate_results = {
        "market_performance": gates.market_performance(totals),
        "market_yoy": yoy,
        "market_stability_verdict": gates.stability_verdict(yoy),
        "core_totals": gates.core_totals(totals, core),
        "category_performance": gates.category_performance(totals, core),
        "discount_over_index": gates.discount_over_index(totals, core),
        "ship_mode_performance": gates.ship_mode_performance(totals, core),
        "segment_monthly_share": gates.period_share(totals, core, years),
        "segment_contribution": gates.share_stability(totals, core, years),
        "organic_demand": gates.flag_rate(totals, core, excluded_segment),
    }
    save_all("gates", gate_results)

    # the gates as the analysis presents them: display strings beside the numbers
    exact = {
        "market_performance": gates.market_performance(totals, scale=None),
        "market_yoy": gates.yoy_growth(totals, core=core, scale=None),
        "category_performance": gates.category_performance(totals, core, scale=None),
        "discount_over_index": gates.discount_over_index(totals, core, scale=None),
        "ship_mode_performance": gates.ship_mode_performance(totals, core, scale=None),
        "segment_contribution": gates.share_stability(totals, core, years, scale=None),
        "organic_demand": gates.flag_rate(totals, core, excluded_segment, scale=None),
        "profit_ratio_by_year": audit.signed_ratio_by_period(raw, scale=None),
    }
    save_all(
        "reports",
        {
            name: format_report(with_millions(df) if "revenue_millions" in REPORT_FORMATS[name] else df, REPORT_FORMATS[name])
            for name, df in exact.items()
        },
    )

    # 5. reporting marts (the fact stays a directory of parts; the calendar is small)
    fmt = "csv" if csv_marts else "parquet"
    if partition_reporting_by_year:
        save(
            "marts/reporting_fact",
            marts.reporting_fact(clean, core, with_year=True),
            fmt=fmt,
            partition_by=["Order Year"],
        )
    else:
        save("marts/reporting_fact", marts.reporting_fact(clean, core), fmt=fmt)
    save("marts/date_dimension", marts.date_dimension(clean), fmt=fmt, single_file=True)
    return written
