"""Every operator on empty input, and on a table where one key holds a third of the rows."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from saleslens.operators import audit, corrections, gates, marts, profiling
from saleslens.sources.schema import sales_schema

CORE = ("EU", "APAC")


def _all_operators(df):
    yoy = gates.yoy_growth(df, core=CORE)
    return {
        "sample_rows": profiling.sample_rows(df, 5, seed=1),
        "column_profile": profiling.column_profile(df),
        "column_profile_approx": profiling.column_profile(df, approx=True),
        "duplicate_rows": profiling.duplicate_rows(df),
        "numeric_range_stats": profiling.numeric_range_stats(df),
        "identifier_cardinality": audit.identifier_cardinality(df, "customer_name", "customer_id"),
        "children_per_parent": audit.children_per_parent(df, ["category", "subcategory"], "product_name", order=True),
        "distinct_pairs": audit.distinct_pairs(df, "market", "region"),
        "hierarchy_check": audit.hierarchy_check(df, "market", "country"),
        "multi_parent": audit.multi_parent(df, "market", "country"),
        "pairs_for": audit.pairs_for(df, "country", "market", ["Austria"]),
        "multi_parent_detail": audit.multi_parent_detail(df),
        "values_reused_across": audit.values_reused_across(df),
        "name_fanout": audit.name_fanout(df),
        "negative_rows": audit.negative_rows(df),
        "signed_ratio_by_period": audit.signed_ratio_by_period(df),
        "market_correction_map": corrections.market_correction_map(df),
        "apply_market_correction": corrections.apply_market_correction(df)[0],
        "market_report": corrections.apply_market_correction(df)[1],
        "subcategory_correction_map": corrections.subcategory_correction_map(df),
        "apply_subcategory_correction": corrections.apply_subcategory_correction(df)[0],
        "field_policy": corrections.apply_field_policy(df),
        "snapshot": gates.analysis_snapshot(df),
        "market_performance": gates.market_performance(df),
        "yoy": yoy,
        "verdict": gates.stability_verdict(yoy),
        "core_totals": gates.core_totals(df, CORE),
        "category_performance": gates.category_performance(df, CORE),
        "discount_over_index": gates.discount_over_index(df, CORE),
        "ship_mode_performance": gates.ship_mode_performance(df, CORE),
        "period_share": gates.period_share(df, CORE, (2013, 2014)),
        "share_stability": gates.share_stability(df, CORE, (2013, 2014)),
        "flag_rate": gates.flag_rate(df, CORE),
        "reporting_fact": marts.reporting_fact(df, CORE),
        "date_dimension": marts.date_dimension(df),
    }


def test_every_operator_runs_on_empty_input(spark):
    empty = spark.createDataFrame([], sales_schema())
    for name, df in _all_operators(empty).items():
        rows = df.collect()
        expected = {"column_profile": 23, "column_profile_approx": 23, "numeric_range_stats": 5,
                    "identifier_cardinality": 1, "hierarchy_check": 1, "core_totals": 1, "date_dimension": 1}
        assert len(rows) == expected.get(name, 0), name


@pytest.fixture(scope="module")
def hot(spark):
    """3,000 lines; 1,000 of them are one identical line (same market, country,
    product, profit, date), the rest spread over many keys."""
    rows = []
    hot_line = (1, "O-1", dt.date(2013, 5, 1), dt.date(2013, 5, 3), "Standard", "C-1", "Ann", "Consumer", None, None,
                "Austria", "EU", "EU", "P-1", "Office Supplies", "Fasteners", "Staples",
                Decimal("10.00"), 1, Decimal("0.100"), Decimal("-1.00"), Decimal("1.00"), "High")
    rows += [hot_line] * 1000
    for i in range(2000):
        rows.append((i + 2, f"O-{i}", dt.date(2013 + i % 2, 1 + i % 12, 1 + i % 28), dt.date(2014, 1, 1),
                     ["Standard", "First"][i % 2], f"C-{i % 50}", f"N{i % 40}", ["Consumer", "Corporate"][i % 2],
                     None, None, f"K{i % 30}", ["EU", "APAC", "US"][i % 3], "R", f"P-{i % 70}", "Tech",
                     ["Phones", "Copiers"][i % 2], f"prod{i % 60}", Decimal(i % 100 + 1), i % 5,
                     Decimal(i % 3) / 10, Decimal(i % 7 - 3), Decimal("2.00"), "Low"))
    return spark.createDataFrame(rows, sales_schema()).repartition(8)


def test_hot_group_of_copies(hot):
    dups = profiling.duplicate_rows(hot).collect()
    assert len(dups) == 1 and dups[0].duplicate_counter == 1000
    direct = profiling.duplicate_rows(hot).collect()
    assert [r.duplicate_counter for r in direct] == [1000]


def test_hot_key_aggregates_are_exact(hot):
    perf = {r.market: r for r in gates.market_performance(hot).collect()}
    assert perf["EU"].order_count == 1000 + sum(1 for i in range(2000) if i % 3 == 0)
    assert abs(sum(r.revenue_pct for r in perf.values()) - 1) < 1e-5
    profile = {r.column_name: r for r in profiling.column_profile(hot).collect()}
    assert profile["country"].count_distinct == 31 and profile["city"].null_count == 3000


def test_hot_value_sort_is_total_and_ordered(hot):
    neg = audit.negative_rows(hot)
    vals = [r.profit for r in neg.collect()]
    assert vals == sorted(vals) and len(vals) == hot.filter(F.col("profit") < 0).count()
