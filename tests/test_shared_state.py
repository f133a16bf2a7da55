"""Rollups, landed tuples, core tables, collations, keyed updates, sketches and clustered landing."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from saleslens.constants import FIXTURE_CORE_MARKETS, FIXTURE_MARKET_RULES, FIXTURE_SEGMENT_YEARS
from saleslens.operators import audit, corrections, gates, profiling, rollup
from saleslens.operators.audit_scan import distinct_tuples, land_tuples, tuples_of
from saleslens.operators.rollup import Rollup, merge_rollups, one_spelling, roll_up
from saleslens.plans.inspect import plan_text
from saleslens.plans.pipeline import run_pipeline
from saleslens.plans.queries import _gates
from saleslens.sources import land_parquet
from saleslens.sources.csv_source import land_clustered

COLUMNS = (
    "market string, country string, category string, ship_mode string, segment string, order_date date, ship_date date, "
    "sales decimal(10,2), shipping_cost decimal(10,2), discount decimal(5,3)"
)


def line(market="EU", country="FR", day=1, ship=3, sales="1.00", cost="0.50", discount="0.000", segment="S", mode="M", category="C"):
    date = lambda d: None if d is None else dt.date(2013, 1, 1) + dt.timedelta(days=d)
    money = lambda x: None if x is None else Decimal(x)
    return (market, country, category, mode, segment, date(day), date(ship), money(sales), money(cost), money(discount))


def rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


# ------------------------------------------------------------------ rollups --


@pytest.fixture(scope="module")
def odd_lines(spark):
    """Nulls in every column, days shipped backwards, markets without values or discounts."""
    lines = [line(), line(sales=None), line(sales=None, discount="0.100", market="US"), line(market=None), line(country=None)]
    lines += [line(day=None), line(ship=None, discount=None), line(day=400, ship=390, cost=None), line(segment=None, mode=None, category=None)]
    lines += [line(market="US", day=d, sales="-2.50", discount="0.200") for d in (5, 40, 380)] + [line(market="AP", sales="0.00")]
    return spark.createDataFrame(lines, COLUMNS)


@pytest.mark.parametrize("gate", sorted(_gates(("EU", "US", "AP"))))
def test_gates_give_the_same_rows_from_a_rollup(odd_lines, gate):
    build = _gates(("EU", "US", "AP"))[gate]
    whole = build(odd_lines)
    from_rollup = build(Rollup(roll_up(odd_lines)))
    assert rows(from_rollup) == rows(whole) and from_rollup.columns == whole.columns
    empty = odd_lines.limit(0)
    assert rows(build(Rollup(roll_up(empty)))) == rows(build(empty))


def test_verdict_from_a_rollup(odd_lines):
    core = ("EU", "US", "AP")
    verdict = lambda src: rows(gates.stability_verdict(gates.yoy_growth(src, core=core)))
    assert verdict(Rollup(roll_up(odd_lines))) == verdict(odd_lines)


def test_rollups_merge(odd_lines):
    parts = odd_lines.randomSplit([0.5, 0.3, 0.2], seed=1)
    merged = merge_rollups(*[roll_up(p) for p in parts])
    whole = roll_up(odd_lines)
    assert merged.dtypes == whole.dtypes and rows(merged) == rows(whole)


def test_pipeline_scans_the_fact_once_for_all_gates(spark, fact, tmp_path, monkeypatch):
    scanned = []
    built = gates.with_totals

    def watched(agg, *cols):
        scanned.append(plan_text(agg))
        return built(agg, *cols)

    monkeypatch.setattr(gates, "with_totals", watched)
    paths = run_pipeline(
        spark, fact, str(tmp_path / "run"), core=FIXTURE_CORE_MARKETS, years=FIXTURE_SEGMENT_YEARS, cluster_by_date=True,
        market_rules=FIXTURE_MARKET_RULES,
    )
    assert scanned and all("gates/rollup" in plan and "/clean" not in plan for plan in scanned)
    read = lambda name: spark.read.parquet(paths[name])
    assert rows(read("gates/market_yoy")) == rows(gates.yoy_growth(read("clean"), core=FIXTURE_CORE_MARKETS))
    assert rows(read("audit/customer_name_fanout")) == rows(audit.name_fanout(fact))
    assert rows(read("audit/products_multi_subcategory")) == rows(audit.multi_parent_detail(fact))


# -------------------------------------------------------------- core tables --


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("gate", sorted(set(_gates(())) - {"market_performance"}))
def test_core_markets_from_a_table(spark, odd_lines, gate, broadcast, monkeypatch):
    if not broadcast:  # as for a table beyond the bound
        monkeypatch.setattr(rollup, "sized_broadcast", lambda df, **_: df.hint("merge"))
    table = spark.createDataFrame([("EU",), ("US",), ("US",), (None,), ("none",)], "name string")
    got = _gates(table)[gate](odd_lines)
    assert rows(got) == rows(_gates(("EU", "US"))[gate](odd_lines))
    assert ("BroadcastHashJoin" in plan_text(got)) == broadcast
    assert rows(_gates(table)[gate](Rollup(roll_up(odd_lines)))) == rows(got)


def test_lines_are_rolled_up_before_they_meet_a_core_table(spark, fact, monkeypatch):
    monkeypatch.setattr(rollup, "sized_broadcast", lambda df, **_: df.hint("merge"))
    table = spark.createDataFrame([(m,) for m in FIXTURE_CORE_MARKETS], "m string")
    plan = plan_text(gates.category_performance(fact, table), "simple").splitlines()
    scan = next(i for i, x in enumerate(plan) if "FileScan" in x and "sales" in x)
    above = [x for x in plan[:scan] if "Exchange" in x or "HashAggregate" in x]
    assert "HashAggregate" in above[-1] or "partial" in above[-1]  # next to the scan, not an exchange of lines


# --------------------------------------------------------------- collations --


def test_spellings_under_a_collation(spark):
    df = spark.createDataFrame([("EU", "x"), ("eu", "X"), ("Eu", None), (None, "y")], "a string, b string")
    got = one_spelling(df, ["a", "b"], "UTF8_LCASE")
    assert rows(got) == rows(spark.createDataFrame([("EU", "X"), ("EU", "X"), ("EU", None), (None, "y")], "a string, b string"))


@pytest.mark.parametrize("gate", sorted(_gates(())))
def test_gates_under_a_collation(odd_lines, gate):
    mixed = odd_lines.withColumns({c: F.when(F.rand(3) < 0.5, F.lower(c)).otherwise(F.col(c)) for c in ("market", "segment", "category")})
    upper = mixed.withColumns({c: F.upper(c) for c in ("market", "segment", "category")})
    got = _gates(["eu", "Us"])[gate](mixed, collation="UTF8_LCASE")
    # the least spelling that is there need not be the upper-case one
    texts = [F.upper(F.col(c)).alias(c) if t.startswith("string") else F.col(c) for c, t in got.dtypes]
    assert rows(got.select(*texts)) == rows(_gates(["EU", "US"])[gate](upper).select(*[F.upper(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in _gates(["EU", "US"])[gate](upper).dtypes]))


def test_corrections_under_a_collation(spark):
    df = spark.createDataFrame([(1, "emea", "AUSTRIA"), (2, "EU", "Austria"), (3, None, "Austria")], "row_id int, market string, country string")
    rules = [("EMEA", "Austria", "EU")]
    fixed, report = corrections.apply_market_correction(df, rules, collation="UTF8_LCASE")
    assert {r.row_id: r.market for r in fixed.collect()} == {1: "EU", 2: "EU", 3: None}
    assert report.first().rows_changed == 1 and report.first().wrong_market == "EMEA"
    assert corrections.apply_market_correction(df, rules)[1].collect() == []
    with pytest.raises(ValueError, match="unique"):
        corrections.apply_market_correction(df, [*rules, ("emea", "austria", "US")], collation="UTF8_LCASE")


# ------------------------------------------------------------- keyed update --


def test_update_by_key(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "c", 3), (None, "c", 3), (4, "d", 4)], "k int, v string, w int")
    fixes = spark.createDataFrame([(1, "x"), (2, None), (9, "z"), (None, "q"), (None, "r")], "k int, new string")
    got = corrections.apply_by_key(df, fixes, "k", {"v": "new"})
    assert got.columns == df.columns
    assert rows(got) == rows(
        spark.createDataFrame([(1, "x", 1), (2, None, 2), (None, "c", 3), (None, "c", 3), (4, "d", 4)], "k int, v string, w int")
    )
    plan = plan_text(corrections.apply_by_key(df, fixes, "k", {"v": "new"}), "simple")
    assert sum("Exchange hashpartitioning" in x for x in plan.splitlines()) == 1
    assert rows(corrections.apply_by_key(df, fixes.limit(0), "k", {"v": "new"})) == rows(df)


@pytest.mark.parametrize("shared", ["input", "fixes"])
def test_update_by_key_stops_at_a_shared_key(spark, shared):
    df = spark.createDataFrame([(1, "a"), (2, "b")] + [(2, "c")] * (shared == "input"), "k int, v string")
    fixes = spark.createDataFrame([(1, "x")] + [(7, "y"), (7, "z")] * (shared == "fixes"), "k int, v string")
    with pytest.raises(Exception, match=f"not unique in the {shared}"):
        corrections.apply_by_key(df, fixes, "k", {"v": "v"}).collect()


# ------------------------------------------------------- samples and sketches --


def test_seeded_sample_is_the_same_whatever_the_partitions(fact):
    draw = lambda df, seed: rows(profiling.sample_rows_by_hash(df, ["row_id", "product_id"], 12, seed))
    one, other = fact.coalesce(1), fact.repartition(7)
    assert draw(one, 1) == draw(other, 1) != draw(one, 2)
    assert len(draw(one, 1)) == 12
    few = fact.limit(5).cache()
    assert draw(few, 1) == rows(few)


def test_stored_sketches_merge_without_a_rescan(spark, fact, tmp_path):
    columns = ["customer_id", "sales", "order_date", "city", "row_id"]
    path = str(tmp_path / "sketches")
    for k, part in enumerate(fact.randomSplit([0.4, 0.6], seed=5)):  # the second load is added to the first
        profiling.column_sketches(part, columns).write.mode("append").parquet(path)
        merged = profiling.merge_sketches(spark.read.parquet(path))
        assert "landed" not in plan_text(merged)
    exact = {r.column_name: r for r in profiling.column_profile(fact, columns).collect()}
    assert merged.select("row_count").distinct().first()[0] == fact.count()
    for r in profiling.profile_of_sketches(merged).collect():
        e = exact[r.column_name]
        assert (r.data_type, r.null_count) == (e.data_type, e.null_count)
        assert abs(r.count_distinct - e.count_distinct) <= max(1, 4 * 1.04 / 2**6 * e.count_distinct), r
    empty = profiling.profile_of_sketches(profiling.column_sketches(fact.limit(0), columns)).collect()
    assert {(r.null_count, r.count_distinct) for r in empty} == {(0, 0)}


def test_signed_zeros_count_once_in_sketches(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (None,), (1.5,)], "x double")
    r = profiling.profile_of_sketches(profiling.column_sketches(df)).first()
    assert (r.count_distinct, r.null_count) == (2, 1)


# ------------------------------------------------------------------- audits --


def test_all_audit_tuples_from_one_scan(spark, fact, tmp_path):
    found = distinct_tuples(fact)
    assert plan_text(found, "simple").count("FileScan") == 1
    path = str(tmp_path / "t")
    land_tuples(fact, path)
    lands = tuples_of(spark, path, "market_country")
    assert rows(lands) == rows(fact.groupBy("market", "country").agg(F.count(F.lit(1)).alias("n_lines")))
    assert "market_country" in next(x for x in plan_text(lands).splitlines() if "PartitionFilters" in x)
    with pytest.raises(ValueError, match="not text"):
        distinct_tuples(fact, {"x": ("market", "sales")})


def test_audits_keep_null_tuples(spark, tmp_path):
    df = spark.createDataFrame([("EU", None), ("EU", None), (None, "FR"), ("US", "FR")], "market string, country string")
    kinds = {"market_country": ("market", "country")}
    path = str(tmp_path / "t")
    land_tuples(df, path, kinds)
    lands = tuples_of(spark, path, "market_country", kinds)
    assert rows(audit.hierarchy_check(lands, "market", "country")) == rows(audit.hierarchy_check(df, "market", "country"))
    assert lands.agg(F.sum("n_lines")).first()[0] == 4


# ----------------------------------------------------------- date clustering --


def test_clustered_landing_skips_row_groups(spark, fact, tmp_path):
    plain, sorted_ = str(tmp_path / "plain"), str(tmp_path / "sorted")
    land_parquet(fact, plain)
    land_clustered(fact, sorted_, ["order_date"], partitions=12)

    def rows_read(path):
        year = spark.read.parquet(path).filter((F.col("order_date") >= dt.date(1995, 1, 1)) & (F.col("order_date") < dt.date(1996, 1, 1)))
        picked = year.select("sales")
        n = len(picked.collect())
        leaf = picked._jdf.queryExecution().executedPlan().collectLeaves().head()
        return n, leaf.metrics().apply("numOutputRows").value()

    (n, before), (m, after) = rows_read(plain), rows_read(sorted_)
    assert n == m and before == fact.count() and after < before / 2
    assert rows(spark.read.parquet(sorted_)) == rows(fact)


def test_one_date_spreads_over_many_ranges(spark, tmp_path):
    df = spark.range(2000).select("id", F.lit(dt.date(2013, 5, 5)).alias("order_date"))
    land_clustered(df, str(tmp_path / "d"), ["order_date"], partitions=6)
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "d")).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 3 and max(sizes) < 1000
