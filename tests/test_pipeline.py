"""End-to-end pipeline over the dirty fixture fact (sf0.001)."""

from saleslens.constants import (
    FIXTURE_CORE_MARKETS,
    FIXTURE_EXCLUDED_SEGMENT,
    FIXTURE_MARKET_RULES,
    FIXTURE_MULTI_MARKET_COUNTRIES,
    FIXTURE_PRODUCT_RULE,
    FIXTURE_SEGMENT_YEARS,
)
from saleslens.plans.inspect import plan_text
from saleslens.plans.pipeline import run_pipeline


def test_pipeline_cleans_and_reports(spark, dirty_fact, fact, tmp_path):
    paths = run_pipeline(
        spark,
        dirty_fact,
        str(tmp_path / "run"),
        core=FIXTURE_CORE_MARKETS,
        years=FIXTURE_SEGMENT_YEARS,
        excluded_segment=FIXTURE_EXCLUDED_SEGMENT,
        market_rules=FIXTURE_MARKET_RULES,
        product_rule=FIXTURE_PRODUCT_RULE,
        multi_market_countries=FIXTURE_MULTI_MARKET_COUNTRIES,
        csv_marts=True,
    )
    read = lambda name: spark.read.parquet(paths[name])
    before = read("audit/hierarchy_check_market_country").first()
    after = read("audit/hierarchy_check_market_country_corrected").first()
    assert (before[0], before[1]) == (25, 27)
    assert (after[0], after[1]) == (25, 25)
    sub_after = read("audit/hierarchy_check_subcategory_product_corrected").first()
    assert (sub_after[0], sub_after[1]) == (62, 147)
    assert sum(r.rows_changed for r in read("corrections/market_report").collect()) == 68
    assert read("corrections/subcategory_report").first().rows_changed == 119
    assert read("clean").count() == fact.count() == 6000
    assert read("gates/market_performance").count() == 5
    assert read("audit/duplicate_rows").count() == 0
    cal = spark.read.option("header", True).csv(paths["marts/date_dimension"])
    assert cal.count() == 2405
    rep = spark.read.option("header", True).csv(paths["marts/reporting_fact"])
    assert rep.count() == 6000 and "Is Core Market" in rep.columns
    assert rep.filter("`Shipping Days` is null").count() == 2815


def test_reporting_fact_partitioned_by_year(spark, fact, tmp_path):
    from pyspark.sql import functions as F

    paths = run_pipeline(
        spark,
        fact,
        str(tmp_path / "run"),
        core=FIXTURE_CORE_MARKETS,
        years=FIXTURE_SEGMENT_YEARS,
        excluded_segment=FIXTURE_EXCLUDED_SEGMENT,
        market_rules=FIXTURE_MARKET_RULES,
        product_rule=FIXTURE_PRODUCT_RULE,
        partition_reporting_by_year=True,
    )
    rep = spark.read.parquet(paths["marts/reporting_fact"])
    assert rep.count() == 6000
    years = sorted(p.name for p in (tmp_path / "run" / "marts" / "reporting_fact").iterdir() if p.is_dir())
    assert years[0].startswith("Order Year=") and len(years) == 7
    one_year = rep.filter(F.col("Order Year") == 1999)
    partition_filters = [line for line in plan_text(one_year).splitlines() if "PartitionFilters" in line]
    assert any("Order Year" in line and "1999" in line for line in partition_filters)
    assert one_year.count() == fact.filter(F.year("order_date") == 1999).count()
