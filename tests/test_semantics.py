"""Edge-case semantics on hand-made tables (FIXTURES.md section 3)."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from saleslens.functions.formatting import fmt_number, fmt_percent
from saleslens.operators import audit, corrections, gates, marts, profiling

D = Decimal


def test_pair_counting_strict_vs_concat(spark):
    df = spark.createDataFrame([("x", None), ("x", "y"), ("xy", None), (None, None)], "a string, b string")
    r = audit.hierarchy_check(df, "a", "b", "b_n", "m").first()
    assert (r["b_n"], r["m"], r["m_concat"]) == (1, 4, 3)


def test_collation_options(spark):
    df = spark.createDataFrame([("A", "1"), ("a", "1"), ("a ", "1")], "x string, id string")
    counts = [
        audit.identifier_cardinality(df, "x", "id", "n", "i", collation=c).first()["n"]
        for c in (None, "UTF8_LCASE", "UTF8_LCASE_RTRIM")
    ]
    assert counts == [3, 2, 1]


def _yoy_table(spark):
    rows = []
    series = {
        "UP": [(2010, 100), (2011, 110), (2012, 120), (2013, 130)],
        "ONE": [(2010, 100), (2011, 90), (2012, 120), (2013, 130)],
        "TWO_SEP": [(2010, 100), (2011, 90), (2012, 120), (2013, 100)],
        "TWO_CONS": [(2010, 100), (2011, 90), (2012, 80), (2013, 100)],
        "GAP": [(2010, 100), (2012, 90), (2013, 95)],
        "ZERO": [(2010, 100), (2011, 0), (2012, 50)],
    }
    for m, pts in series.items():
        for y, v in pts:
            rows.append((m, dt.date(y, 6, 1), D(v)))
    return spark.createDataFrame(rows, "market string, order_date date, sales decimal(10,2)")


def test_yoy_growth_and_verdict(spark):
    df = _yoy_table(spark)
    yoy = gates.yoy_growth(df, core=None)
    got = {(r.market, r.order_year): r.revenue_growth_yoy for r in yoy.collect()}
    assert got[("UP", 2010)] is None  # first year: lag default 0 -> NULL growth
    assert got[("UP", 2011)] == pytest.approx(0.1)
    assert got[("GAP", 2012)] == pytest.approx(-0.1)  # previous present year (2010)
    assert got[("ZERO", 2011)] == pytest.approx(-1.0)
    assert got[("ZERO", 2012)] is None  # after a zero year: NULL, not an error
    v = {r.market: (r.negative_yoy_years, r.consecutive_decline, r.stable) for r in gates.stability_verdict(yoy).collect()}
    assert v["UP"] == (0, False, True)
    assert v["ONE"] == (1, False, True)
    assert v["TWO_SEP"] == (2, False, False)
    assert v["TWO_CONS"] == (2, True, False)
    assert v["GAP"] == (1, False, True)


def test_shipping_days_truncated_and_guarded(spark):
    rows = [
        ("M", "A", dt.date(2020, 1, 1), dt.date(2020, 1, 4), D("1.00"), D("10.00")),  # 3 days
        ("M", "A", dt.date(2020, 1, 1), dt.date(2020, 1, 1), D("1.00"), D("10.00")),  # same day
        ("M", "A", dt.date(2020, 1, 5), dt.date(2020, 1, 1), D("1.00"), D("10.00")),  # shipped first: -4
        ("M", "A", dt.date(2020, 1, 1), None, D("1.00"), D("10.00")),
        ("M", "A", None, dt.date(2020, 1, 1), D("1.00"), D("10.00")),
    ]
    df = spark.createDataFrame(
        rows, "market string, ship_mode string, order_date date, ship_date date, shipping_cost decimal(10,2), sales decimal(10,2)"
    )
    r = gates.ship_mode_performance(df, core=["M"]).first()
    assert r.avg_ship_day == -0  # (3 + 0 - 4) div 3 = -1 div 3 -> 0 (toward zero)
    assert r.avg_ship_day_exact == pytest.approx(-1 / 3, abs=1e-6)
    assert r.order_count == 5
    full = df.withColumn("country", F.lit("C")).withColumn("discount", F.lit(None).cast("decimal(5,3)"))
    full = full.withColumn("category", F.lit("K")).withColumn("segment", F.lit("S"))
    days = [x["Shipping Days"] for x in marts.reporting_fact(full, core=["M"]).collect()]
    assert days == [3, 0, None, None, None]


def test_discount_flag(spark):
    df = spark.createDataFrame(
        [(D("0"),), (D("0.001"),), (None,), (D("0.800"),)], "discount decimal(5,3)"
    ).select("*", F.lit("M").alias("market"), F.lit("S").alias("segment"))
    r = gates.flag_rate(df, core=["M"], exclude=None).first()
    assert (r.discounted_order_count, r.order_count) == (2, 4)


def test_single_month_share_has_null_stddev(spark):
    rows = [
        ("M", "S1", dt.date(2013, 1, 5), D("10")),
        ("M", "S2", dt.date(2013, 1, 6), D("30")),
        ("M", "S1", dt.date(2013, 2, 5), D("20")),
    ]
    df = spark.createDataFrame(rows, "market string, segment string, order_date date, sales decimal(10,2)")
    stats = {r.segment: r for r in gates.share_stability(df, core=["M"], years=[2013]).collect()}
    assert stats["S2"].std_dev is None and stats["S2"].cv_pct is None
    assert stats["S1"].mean_pct == pytest.approx((0.25 + 1.0) / 2)
    shares = gates.period_share(df, core=["M"], years=[2013]).collect()
    by_month = {}
    for r in shares:
        by_month.setdefault((r.order_year, r.order_month), 0.0)
        by_month[(r.order_year, r.order_month)] += r.contribution_pct
    assert all(v == pytest.approx(1.0) for v in by_month.values())


def test_zero_totals_give_null_not_error(spark):
    df = spark.createDataFrame(
        [("M", "K", D("0"), D("0")), ("M", "K", D("0"), D("0"))], "market string, category string, sales decimal(10,2), discount decimal(5,3)"
    )
    r = gates.category_performance(df, core=["M"]).first()
    assert r.revenue_pct is None and r.order_count_pct == 1.0
    assert gates.category_performance(df, core=[]).count() == 0
    d = gates.discount_over_index(df, core=["M"]).first()
    assert d.market_revenue_pct is None and d.discount_over_indexes_scale == "No"


def test_duplicates(spark):
    schema = "row_id int, a string, b int"
    df = spark.createDataFrame(
        [(1, "x", 1), (1, "x", 1), (2, "y", 2), (3, "y", 2), (4, None, None), (4, None, None), (5, "z", 9)], schema
    )
    full = {(r.row_id, r.a, r.b): r.duplicate_counter for r in profiling.duplicate_rows(df).collect()}
    assert full == {(1, "x", 1): 2, (4, None, None): 2}
    payload = {(r.a, r.b): r.duplicate_counter for r in profiling.duplicate_rows(df, exclude=["row_id"]).collect()}
    assert payload == {("x", 1): 2, ("y", 2): 2, (None, None): 2}
    # the direct path (candidates above the limit) gives the same answer
    direct = {(r.a, r.b): r.duplicate_counter for r in profiling.duplicate_rows(df, ["row_id"]).collect()}
    assert direct == payload


def test_market_rules_do_not_use_row_ids(spark):
    df = spark.createDataFrame(
        [(1, "EMEA", "Austria"), (1, "APAC", "China"), (None, "EMEA", "Mongolia"), (2, "EU", "Austria"), (3, "EMEA", "France")],
        "row_id int, market string, country string",
    )
    fixed, report = corrections.apply_market_correction(df)
    # ordered by (row_id, country): (1,Austria) (1,China) (2,Austria) (3,France) (NULL,Mongolia)
    assert [r.market for r in fixed.orderBy(F.col("row_id").asc_nulls_last(), "country").collect()] == [
        "EU",
        "APAC",
        "EU",
        "EMEA",
        "APAC",
    ]
    rep = {(r.wrong_market, r.country, r.correct_market): r.rows_changed for r in report.collect()}
    assert rep == {("EMEA", "Austria", "EU"): 1, ("EMEA", "Mongolia", "APAC"): 1}
    again, report2 = corrections.apply_market_correction(fixed)
    assert again.collect() == fixed.collect() and report2.count() == 0  # idempotent
    # the table path (joined rules) agrees with the inline CASE path
    rules = spark.createDataFrame(
        [("EMEA", "Austria", "EU"), ("EMEA", "Mongolia", "APAC")], "wrong_market string, country string, correct_market string"
    )
    via_table, _ = corrections.apply_market_correction(df, rules)
    assert sorted(map(tuple, via_table.collect()), key=str) == sorted(map(tuple, fixed.collect()), key=str)
    cmap = corrections.market_correction_map(df).collect()
    assert sorted((r.row_id or 0, r.correct_market) for r in cmap) == [(0, "APAC"), (1, "EU")]
    with pytest.raises(Exception, match="not unique in the input"):
        corrections.apply_by_key(df, spark.createDataFrame(cmap), "row_id", {"market": "correct_market"}).collect()


def test_product_rule_keeps_null_subcategory(spark):
    df = spark.createDataFrame(
        [("Staples", "Paper", "Office Supplies"), ("Staples", "Fasteners", "Office Supplies"), ("Staples", None, "X")],
        "product_name string, subcategory string, category string",
    )
    fixed, report = corrections.apply_subcategory_correction(df)
    assert [tuple(r) for r in fixed.collect()] == [
        ("Staples", "Fasteners", "Office Supplies"),
        ("Staples", "Fasteners", "Office Supplies"),
        ("Staples", None, "X"),
    ]
    assert report.first().rows_changed == 1


def test_profile_negative_zero_and_nulls(spark):
    df = spark.createDataFrame([(-0.0,), (0.0,), (None,)], "v double")
    exact = profiling.column_profile(df).first()
    assert (exact.null_count, exact.count_distinct, exact.data_type) == (1, 1, "double")
    approx = profiling.column_profile(df, approx=True).first()
    assert approx.null_count == 1


def test_one_sided_year_is_dropped(spark):
    df = spark.createDataFrame(
        [(dt.date(2010, 1, 1), D("-5")), (dt.date(2010, 2, 1), D("10")), (dt.date(2011, 1, 1), D("7"))],
        "order_date date, profit decimal(10,2)",
    )
    r = audit.signed_ratio_by_period(df).collect()
    assert [x.order_year for x in r] == [2010] and r[0].negative_positive_ratio == 0.5


def test_empty_inputs_keep_schema(spark):
    from saleslens.sources.schema import sales_schema

    empty = spark.createDataFrame([], sales_schema())
    assert marts.date_dimension(empty).collect() == [Row(Date=None, Year=None, Month=None, **{"Month Name": None, "Year Month": None})]
    assert gates.market_performance(empty).count() == 0
    assert len(marts.reporting_fact(empty).columns) == 12
    assert profiling.column_profile(empty).count() == 23
    assert profiling.duplicate_rows(empty).count() == 0


def test_formatting_rounds_half_up(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (1234567.895,), (0.12345,), (-0.028,), (None,)], "x double")
    got = df.select(fmt_number("x", 0).alias("n0"), fmt_number("x", 2).alias("n2"), fmt_percent("x").alias("p2")).collect()
    assert [r.n0 for r in got] == ["3", "4", "1,234,568", "0", "0", None]
    assert got[2].n2 == "1,234,567.90"
    assert [r.p2 for r in got] == ["250.00%", "350.00%", "123,456,789.50%", "12.35%", "-2.80%", None]


def test_range_stats_rejects_unknown_columns(spark):
    df = spark.createDataFrame([(D("1.00"),)], "sales decimal(10,2)")
    with pytest.raises(ValueError):
        profiling.numeric_range_stats(df, ["sales", "ShippingCost"])


def test_calendar_covers_every_day(spark):
    df = spark.createDataFrame([(dt.date(2020, 2, 27),), (dt.date(2020, 3, 2),)], "order_date date")
    rows = marts.date_dimension(df).collect()
    assert len(rows) == 5 and rows[2]["Date"] == dt.date(2020, 2, 29)
    assert rows[-1]["Month Name"] == "March" and rows[-1]["Year Month"] == "2020-03"


def test_empty_rule_lists_change_nothing(spark):
    df = spark.createDataFrame(
        [(1, "EMEA", "Austria", "Staples", "Paper", "X")],
        "row_id int, market string, country string, product_name string, subcategory string, category string",
    )
    fixed, report = corrections.apply_market_correction(df, [])
    assert fixed.collect() == df.collect() and report.count() == 0
    assert corrections.market_correction_map(df, []).count() == 0
    fixed2, report2 = corrections.apply_subcategory_correction(df, [])
    assert fixed2.collect() == df.collect() and report2.count() == 0
    assert corrections.subcategory_correction_map(df, []).count() == 0


def test_apply_by_key_updates_unique_keys(spark):
    df = spark.createDataFrame([(1, "EMEA"), (2, "EU"), (3, "EMEA")], "row_id int, market string")
    fixes = spark.createDataFrame([(1, "EU"), (3, "APAC")], "row_id int, correct_market string")
    out = corrections.apply_by_key(df, fixes, "row_id", {"market": "correct_market"})
    assert sorted(tuple(r) for r in out.collect()) == [(1, "EU"), (2, "EU"), (3, "APAC")]
    assert out.columns == df.columns


def test_input_validation_is_explicit(spark):
    df = spark.createDataFrame([("a", {"k": 1}, 1)], "s string, m map<string,int>, n int")
    with pytest.raises(ValueError, match="numeric"):
        profiling.numeric_range_stats(df, ["n", "s"])
    with pytest.raises(ValueError, match="map columns"):
        profiling.column_profile(df)
    with pytest.raises(ValueError, match="map columns"):
        profiling.duplicate_rows(df)
    assert profiling.column_profile(df, ["s", "n"]).count() == 2
    assert profiling.duplicate_rows(df, exclude=["m"]).count() == 0
