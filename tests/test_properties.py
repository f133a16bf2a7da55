"""Property tests: operators against brute-force Python on random small tables."""

from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from saleslens.operators import audit, gates, profiling

VALUES = st.one_of(st.none(), st.sampled_from(["x", "y", "xy", "z", ""]))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(VALUES, VALUES), min_size=0, max_size=12))
def test_hierarchy_counts_match_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "a string, b string")
    r = audit.hierarchy_check(df, "a", "b", "n_child", "n_map").first()
    assert r["n_child"] == len({b for _, b in rows if b is not None})
    assert r["n_map"] == len(set(rows))
    assert r["n_map_concat"] == len({(a or "") + (b or "") for a, b in rows})


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), VALUES), min_size=0, max_size=14))
def test_duplicate_rows_match_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "k int, v string")
    expected = {t: c for t, c in Counter(rows).items() if c > 1}
    got = {(r.k, r.v): r.duplicate_counter for r in profiling.duplicate_rows(df).collect()}
    assert got == expected
    direct = {(r.k, r.v): r.duplicate_counter for r in profiling.duplicate_rows(df).collect()}
    assert direct == expected


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=7))
def test_stability_verdict_matches_brute_force(spark, revenues):
    import datetime as dt
    from decimal import Decimal

    rows = [("M", dt.date(2000 + i, 1, 1), Decimal(v)) for i, v in enumerate(revenues)]
    df = spark.createDataFrame(rows, "market string, order_date date, sales decimal(10,2)")
    growth = []
    prev = 0
    for v in revenues:
        growth.append(None if prev == 0 else (v - prev) / prev)
        prev = v
    neg = [g is not None and g < 0 for g in growth]
    consecutive = any(a and b for a, b in zip(neg, neg[1:]))
    r = gates.stability_verdict(gates.yoy_growth(df, core=None)).first()
    assert (r.negative_yoy_years, r.consecutive_decline) == (sum(neg), consecutive)
    assert r.stable == (sum(neg) <= 1 and not consecutive)


@settings(max_examples=12, deadline=None)
@given(
    st.lists(
        st.tuples(VALUES, st.one_of(st.none(), st.sampled_from([0.0, -0.0, 1.5, 2.0])), st.one_of(st.none(), st.integers(-2, 2))),
        min_size=0,
        max_size=12,
    )
)
def test_column_profile_matches_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "s string, d double, i int")
    got = {r.column_name: (r.null_count, r.count_distinct) for r in profiling.column_profile(df).collect()}
    for j, name in enumerate(["s", "d", "i"]):
        vals = [r[j] for r in rows]
        # typed distinct: -0.0 == 0.0
        distinct = {v + 0.0 if isinstance(v, float) else v for v in vals if v is not None}
        assert got[name] == (sum(v is None for v in vals), len(distinct)), name


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(2000, 2003), st.integers(-5, 5)), min_size=0, max_size=12))
def test_signed_ratio_matches_brute_force(spark, rows):
    import datetime as dt
    from decimal import Decimal

    df = spark.createDataFrame(
        [(dt.date(y, 3, 1), Decimal(p)) for y, p in rows], "order_date date, profit decimal(10,2)"
    )
    expected = {}
    for y in {y for y, _ in rows}:
        neg = sum(p for yy, p in rows if yy == y and p < 0)
        pos = sum(p for yy, p in rows if yy == y and p > 0)
        if any(yy == y and p < 0 for yy, p in rows) and any(yy == y and p > 0 for yy, p in rows):
            expected[y] = round(abs(neg) / pos, 6)
    got = {r.order_year: r.negative_positive_ratio for r in audit.signed_ratio_by_period(df).collect()}
    assert got == expected


@settings(max_examples=10, deadline=None)
@given(
    st.lists(
        st.tuples(st.sampled_from(["S1", "S2", "S3"]), st.integers(1, 4), st.integers(1, 50)),
        min_size=1,
        max_size=15,
    )
)
def test_segment_shares_match_pandas(spark, rows):
    import datetime as dt
    from decimal import Decimal

    import pandas as pd

    data = [("M", seg, dt.date(2013, month, 1), Decimal(v)) for seg, month, v in rows]
    df = spark.createDataFrame(data, "market string, segment string, order_date date, sales decimal(10,2)")
    pdf = pd.DataFrame(rows, columns=["segment", "month", "sales"]).astype({"sales": float})
    monthly = pdf.groupby(["month", "segment"], as_index=False)["sales"].sum()
    monthly["share"] = monthly["sales"] / monthly.groupby("month")["sales"].transform("sum")
    stats = monthly.groupby("segment")["share"].agg(["mean", "std"])
    got = {r.segment: r for r in gates.share_stability(df, core=["M"], years=[2013]).collect()}
    assert set(got) == set(stats.index)
    for seg, row in stats.iterrows():
        assert abs(got[seg].mean_pct - row["mean"]) < 1e-6
        if pd.isna(row["std"]):
            assert got[seg].std_dev is None
        else:
            assert abs(got[seg].std_dev - row["std"]) < 1e-6
    shares = gates.period_share(df, core=["M"], years=[2013]).collect()
    per_month = Counter()
    for r in shares:
        per_month[r.order_month] += r.contribution_pct
    assert all(abs(v - 1) < 1e-5 for v in per_month.values())


@settings(max_examples=10, deadline=None)
@given(
    st.lists(st.tuples(st.sampled_from(["A", "B", "C", None]), st.integers(1, 100)), min_size=1, max_size=15),
    st.lists(st.integers(0, 400), min_size=1, max_size=6),
)
def test_shares_sum_to_one_and_calendar_spans_every_day(spark, rows, offsets):
    import datetime as dt
    from decimal import Decimal

    from saleslens.operators import marts

    df = spark.createDataFrame(
        [(m, "c", Decimal(v)) for m, v in rows], "market string, country string, sales decimal(10,2)"
    )
    perf = gates.market_performance(df).collect()
    assert abs(sum(r.revenue_pct for r in perf) - 1) < 1e-5
    assert sum(r.order_count for r in perf) == len(rows)
    days = [dt.date(2010, 1, 1) + dt.timedelta(days=o) for o in offsets]
    cal = marts.date_dimension(spark.createDataFrame([(d,) for d in days], "order_date date")).collect()
    assert len(cal) == (max(days) - min(days)).days + 1
    assert cal[0]["Date"] == min(days) and cal[-1]["Date"] == max(days)
