"""Cases that once went wrong: selection-dependent rejects, rule counts, rounding, text through CSV, landings."""

import datetime as dt
import re
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from saleslens.functions.formatting import format_report
from saleslens.operators import audit, corrections, gates
from saleslens.plans.inspect import plan_text
from saleslens.sources import export, load_sales_csv
from saleslens.sources.csv_source import csv_reader_options
from saleslens.sources.fixtures import finished, write_once
from test_sources import _row, _write


def test_good_rows_do_not_depend_on_the_selection(spark, tmp_path):
    path = _write(tmp_path, [_row(row_id="1"), _row(row_id="2", sales="x"), _row(row_id="3", order_date="2014-02-30")])
    good, rejects = load_sales_csv(spark, path)
    assert good.count() == len(good.collect()) == 1 and rejects.count() == len(rejects.collect()) == 2
    for c in good.columns:
        assert good.select(c).count() == 1 and rejects.select(c).count() == 2
    assert gates.core_totals(good, ("EU",)).first().total_order_count == 1
    failing, _ = load_sales_csv(spark, path, on_bad="fail")
    with pytest.raises(Exception, match="rejected row"):
        failing.select("market").collect()


def test_quoted_line_breaks_and_limits(spark, tmp_path):
    path = _write(tmp_path, [_row(row_id="1", product_name='"a\nb, ""c"""'), _row(row_id="2", market="M" * 31), "1,2,3"])
    good, rejects = load_sales_csv(spark, path)
    assert [r.product_name for r in good.collect()] == ['a\nb, "c"']
    assert sorted(r.reject_reason for r in rejects.collect()) == ["market longer than 30", "unparsable cell"]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.one_of(st.none(), st.text(st.characters(blacklist_categories=("Cs",), blacklist_characters="\x00"), max_size=12)),
        min_size=1, max_size=30,
    )
)
def test_text_survives_csv(spark, tmp_path_factory, values):
    # carriage returns inside cells become line feeds in Spark's reader
    values = [None if v is None else v.replace("\r", "\n") for v in values] + ["", " ", "  a ", '"', '""', "a,b", "l1\nl2", "\\"]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    path = str(tmp_path_factory.mktemp("csv") / "t")
    export(df, path, fmt="csv")
    back = spark.read.schema(df.schema).options(**csv_reader_options()).csv(path)
    assert {r.i: r.v for r in back.collect()} == dict(enumerate(values))


@pytest.mark.parametrize("n", [3, 64, 65, 1000])
def test_rules_of_any_number_work_alike(spark, n):
    rules = [(f"W{i}", "X", f"R{i}") for i in range(n - 1)] + [("gone", "X", None)]
    rows = [("W0", "X"), ("gone", "X"), ("W0", "Y"), (None, "X"), ("other", None)]
    df = spark.createDataFrame(rows, "market string, country string")
    for given_rules in (rules, spark.createDataFrame(rules, "wrong_market string, country string, correct_market string")):
        fixed, report = corrections.apply_market_correction(df, given_rules)
        assert sorted((str(r.market), str(r.country)) for r in fixed.collect()) == sorted(
            [("R0", "X"), ("None", "X"), ("W0", "Y"), ("None", "X"), ("other", "None")]
        )
        assert sorted((r.wrong_market, r.rows_changed) for r in report.collect()) == [("W0", 1), ("gone", 1)]
    with pytest.raises(ValueError, match="unique"):
        corrections.apply_market_correction(df, [*rules, ("W0", "X", "again")])
    products = [(f"P{i}", f"S{i}", f"C{i}") for i in range(n)]
    goods = spark.createDataFrame([("P1", "old", "old"), ("P1", None, "c"), ("zz", "a", "b")], "product_name string, subcategory string, category string")
    moved, _ = corrections.apply_subcategory_correction(goods, products)
    assert sorted(map(str, (tuple(r) for r in moved.collect()))) == sorted(
        ["('P1', 'S1', 'C1')", "('P1', None, 'c')", "('zz', 'a', 'b')"]
    )


def test_decline_below_the_rounding_counts(spark):
    rows = [("EU", dt.date(2010 + k, 1, 1), Decimal(90_000_000 - k)) for k in range(4)]
    yoy = gates.yoy_growth(spark.createDataFrame(rows, "market string, order_date date, sales decimal(12,2)"), core=None)
    assert [r.revenue_growth_yoy for r in yoy.collect() if r.revenue_growth_yoy is not None] == [0.0, 0.0, 0.0]
    verdict = gates.stability_verdict(yoy).first()
    assert (verdict.negative_yoy_years, verdict.consecutive_decline, verdict.stable) == (3, True, False)


def test_reports_round_once_and_no_discount_is_zero(spark):
    df = spark.createDataFrame([(0.12344996,)], "p double")
    assert format_report(df, {"p": "P2"}).first().p_fmt == "12.34%"
    rows = [("EU", Decimal(10), Decimal(0)), ("US", Decimal(5), None)]
    out = gates.discount_over_index(spark.createDataFrame(rows, "market string, sales decimal(10,2), discount decimal(5,3)"), ("EU", "US"))
    assert [r.discounted_revenue_pct for r in out.collect()] == [0.0, 0.0]


def test_half_written_landings_are_not_read(spark, tmp_path):
    folder = str(tmp_path / "land")
    spark.range(10).write.parquet(f"{folder}/attempt")
    (tmp_path / "land" / "attempt" / "_SUCCESS").unlink()
    assert finished(spark, folder) is None
    path = write_once(spark, folder, lambda p: spark.range(20).write.parquet(p))
    assert spark.read.parquet(path).count() == 20
    assert write_once(spark, folder, lambda p: pytest.fail("written twice")) == path


@pytest.mark.parametrize(
    "build",
    [
        lambda f: gates.market_performance(f),
        lambda f: gates.ship_mode_performance(f, None),
        lambda f: audit.multi_parent_detail(f),
    ],
)
def test_one_scan(spark, fact, build):
    df = build(fact)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\*\(\d+\) ColumnarToRow\n[^\n]*FileScan", plan)) == 1  # scans that ran


def test_sorted_pairs_spread_over_ranges(fact):
    for df in (audit.distinct_pairs(fact, "market", "region"), audit.values_reused_across(fact)):
        assert re.search(r"rangepartitioning\(market[^,]*ASC[^,]*, region", plan_text(df, "simple"))


def test_collations_reach_every_audit(spark):
    rows = [("p", "EU", "eu", "n", "1"), ("P", "eu", "EU", "N", "2")]
    df = spark.createDataFrame(rows, "product_name string, market string, region string, customer_name string, customer_id string")
    ci = "UTF8_LCASE"
    assert audit.distinct_pairs(df, "market", "region", collation=ci).count() == 1
    assert audit.values_reused_across(df, collation=ci).count() == 1
    assert audit.name_fanout(df, collation=ci).first().customer_id_count_distinct == 2
    assert audit.pairs_for(df, "product_name", "market", ["P"], collation=ci).count() == 1
    assert audit.multi_parent_detail(df, "product_name", "customer_id", ("market",), collation=ci).count() == 2
