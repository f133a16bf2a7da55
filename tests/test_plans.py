"""Plan-shape checks: what reaches the scan, where shuffles happen, what is broadcast."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from __spark_entry__ import queries
from saleslens.constants import FIXTURE_CORE_MARKETS, FIXTURE_SEGMENT_YEARS
from saleslens.functions.expressions import in_years
from saleslens.operators import audit, corrections, gates, marts, profiling
from saleslens.plans.inspect import plan_text
from saleslens.sources.fixtures import sales_fact

from tables import SF_SMALL


def _ancestors(lines, i):
    """Operator lines above line i with smaller indentation (its ancestors)."""
    depth = len(lines[i]) - len(lines[i].lstrip(" :+-"))
    out = []
    for j in range(i - 1, -1, -1):
        d = len(lines[j]) - len(lines[j].lstrip(" :+-"))
        if d < depth:
            out.append(lines[j].strip(" :+-"))
            depth = d
    return out


def test_core_filter_and_year_range_reach_the_scan(fact):
    txt = plan_text(gates.period_share(fact, FIXTURE_CORE_MARKETS, FIXTURE_SEGMENT_YEARS))
    assert "In(market, [AFRICA,AMERICA,ASIA,EUROPE])" in txt
    assert "GreaterThanOrEqual(order_date,1999-01-01)" in txt and "LessThan(order_date,2001-01-01)" in txt
    assert "PushedFilters: [In(market" in plan_text(gates.core_totals(fact, FIXTURE_CORE_MARKETS))


def test_projections_prune_columns(fact):
    txt = plan_text(gates.market_performance(fact))
    assert "ReadSchema: struct<country:string,market:string,sales:decimal(10,2)>" in txt
    assert "ReadSchema: struct<order_date:date>" in plan_text(marts.date_dimension(fact))


def test_map_only_operators_do_not_shuffle(fact):
    for df in (
        corrections.apply_market_correction(fact)[0],
        corrections.apply_subcategory_correction(fact)[0],
        marts.reporting_fact(fact),
        corrections.apply_field_policy(fact),
    ):
        # the small rule table is broadcast; no row of the fact moves
        assert "Exchange" not in plan_text(df, "simple").replace("BroadcastExchange", "")


def test_profile_has_no_expand_and_one_scan_per_type(fact):
    txt = plan_text(profiling.column_profile(fact), "simple")
    assert "Expand" not in txt
    assert txt.count("FileScan parquet") == len(set(t for _, t in fact.dtypes))


def test_duplicates_shuffle_hashes_then_semi_join_candidates(fact):
    txt = plan_text(profiling.duplicate_rows(fact), "simple")
    assert "LeftSemi" in txt and "BroadcastExchange" in txt


def test_distinct_pairs_are_deduped_before_counting(fact):
    lines = plan_text(audit.hierarchy_check(fact, "market", "country"), "simple").splitlines()
    expand = next(i for i, line in enumerate(lines) if "Expand" in line)
    # below the Expand there is already an aggregate (the pair dedupe) and its shuffle
    below = "\n".join(lines[expand + 1 :])
    assert "HashAggregate" in below and "Exchange hashpartitioning(market" in below


def test_fact_side_is_never_broadcast(spark):
    lines = plan_text(sales_fact(spark, SF_SMALL), "simple").splitlines()
    scans = [i for i, line in enumerate(lines) if "lineitem.parquet" in line]
    assert scans
    for i in scans:
        assert not any(a.startswith("BroadcastExchange") for a in _ancestors(lines, i))


def test_dimension_sides_go_shuffle_join_above_the_bound(spark):
    txt = plan_text(sales_fact(spark, SF_SMALL, broadcast_rows=0), "simple")
    # with no proven-small side, no explicit broadcast is requested; the
    # planner may still broadcast only by its own size estimate, never lineitem
    lines = txt.splitlines()
    for i in [i for i, line in enumerate(lines) if "lineitem.parquet" in line]:
        assert not any(a.startswith("BroadcastExchange") for a in _ancestors(lines, i))


def test_no_cartesian_products_anywhere(spark):
    for name, build in queries().items():
        if name in ("load_sales_csv",):
            continue
        txt = plan_text(build(spark, SF_SMALL), "simple")
        assert "CartesianProduct" not in txt, name


def test_gate_totals_are_a_scalar_subquery_not_a_join(fact):
    txt = plan_text(gates.category_performance(fact, FIXTURE_CORE_MARKETS), "simple")
    assert "Subquery" in txt
    assert "Join" not in txt


def test_negative_rows_sort_has_a_tiebreaker(fact):
    txt = plan_text(audit.negative_rows(fact), "simple")
    assert "rangepartitioning(profit" in txt and "xxhash64(" in txt


@settings(max_examples=40, deadline=None)
@given(
    st.lists(st.integers(1990, 2010), min_size=0, max_size=5),
    st.lists(st.dates(dt.date(1989, 1, 1), dt.date(2011, 12, 31)), min_size=1, max_size=8),
)
def test_year_ranges_equal_year_membership(spark, years, dates):
    df = spark.createDataFrame([(d,) for d in dates], "d date")
    got = [r[0] for r in df.select(in_years("d", years)).collect()]
    assert got == [d.year in set(years) for d in dates]


@pytest.mark.parametrize("name", ["market_performance", "segment_contribution", "organic_demand"])
def test_gates_scan_the_fact_once_per_branch_without_joins_to_it(spark, name):
    txt = plan_text(queries()[name](spark, SF_SMALL), "simple")
    assert "SortMergeJoin" not in txt and "ShuffledHashJoin" not in txt


def test_shuffle_join_path_gives_the_same_fact(spark):
    a = sales_fact(spark, SF_SMALL)
    b = sales_fact(spark, SF_SMALL, broadcast_rows=0)
    assert "SortMergeJoin" in plan_text(b, "simple")
    assert a.count() == b.count() == 6000
    assert a.exceptAll(b).count() == 0


def _subtree(lines, i):
    """Lines of the subtree rooted at line i (deeper indentation that follows)."""
    depth = len(lines[i]) - len(lines[i].lstrip(" :+-"))
    out = []
    for line in lines[i + 1 :]:
        if len(line) - len(line.lstrip(" :+-")) <= depth:
            break
        out.append(line)
    return out


def test_nested_loop_joins_only_broadcast_one_row_aggregates(spark):
    for name, build in queries().items():
        if name in ("load_sales_csv", "export_csv"):
            continue
        lines = plan_text(build(spark, SF_SMALL), "simple").splitlines()
        for i, line in enumerate(lines):
            if "BroadcastNestedLoopJoin" not in line:
                continue
            sub = _subtree(lines, i)
            broadcast = next(j for j, s in enumerate(sub) if "BroadcastExchange" in s)
            first_agg = next(s for s in sub[broadcast:] if "HashAggregate" in s)
            assert "HashAggregate(keys=[]" in first_agg, name


def test_sample_is_one_ordered_limit(spark, fact):
    assert "TakeOrderedAndProject" in plan_text(profiling.sample_rows(fact, 10), "simple")
    fan_out = fact.select(F.explode(F.array(*[F.lit(i) for i in range(40)])).alias("k"))
    for n in (10, 20_000):
        assert profiling.sample_rows(fan_out, n).count() == n


def test_rows_without_a_twin_are_not_shuffled_whole(spark, fact):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = fact.unionAll(fact.filter("row_id % 10 = 3")).unionAll(fact.limit(5))
        found = profiling.duplicate_rows(rows)
        # the filter by candidates is a broadcast whatever the planner's estimates
        assert "SortMergeJoin" not in plan_text(found, "simple")
        plain = rows.groupBy(*fact.columns).count().filter("count > 1").select(F.col("count").alias("duplicate_counter"), *fact.columns)
        assert plain.count() > 600 and found.exceptAll(plain).isEmpty() and plain.exceptAll(found).isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_lineitem_meets_part_before_the_wider_orders(spark):
    lines = plan_text(sales_fact(spark, SF_SMALL, broadcast_rows=0), "simple").splitlines()
    above = _ancestors(lines, next(i for i, line in enumerate(lines) if "lineitem.parquet" in line))
    joins = [a for a in above if "Join" in a]
    # nearest first
    assert len(joins) == 2 and "l_partkey" in joins[0] and "l_orderkey" in joins[1]
