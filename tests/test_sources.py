"""Schema, CSV ingestion with rejects, sinks."""

import datetime as dt
from decimal import Decimal

import pytest

from saleslens.sources import export, land_parquet, load_sales_csv, sales_schema
from saleslens.sources.schema import SALES_COLUMNS

HEADER = ",".join(SALES_COLUMNS)


def _row(**over):
    base = dict(
        row_id="1", order_id="O-1", order_date="2014-01-02", ship_date="2014-01-05", ship_mode="Standard Class",
        customer_id="C-1", customer_name="Ann", segment="Consumer", city="Vienna", state="Vienna",
        country="Austria", market="EU", region="Central", product_id="P-1", category="Office Supplies",
        subcategory="Fasteners", product_name="Staples", sales="10.50", quantity="2", discount="0.100",
        profit="1.25", shipping_cost="2.00", order_priority="High",
    )
    base.update(over)
    return ",".join(base[c] for c in SALES_COLUMNS)


def _write(tmp_path, lines):
    p = tmp_path / "in.csv"
    p.write_text("\n".join([HEADER, *lines]) + "\n")
    return str(p)


def test_schema_is_declared():
    s = sales_schema()
    assert len(s) == 23 and all(f.nullable for f in s)
    assert s["quantity"].dataType.simpleString() == "smallint"
    assert s["sales"].dataType.simpleString() == "decimal(10,2)"


def test_csv_good_and_rejects(spark, tmp_path):
    path = _write(
        tmp_path,
        [
            _row(row_id="1"),
            _row(row_id="2", product_name='"Staples, 10 pack"'),
            _row(row_id="3", product_name='"The ""Best"" Chair"'),
            _row(row_id="4", city=""),
            _row(row_id="5", sales="12.345"),
            _row(row_id="6", quantity="200"),
            _row(row_id="7", sales="abc"),
            _row(row_id="8", order_date="2014-13-45"),
            _row(row_id="9", quantity="300"),
        ],
    )
    good, rejects = load_sales_csv(spark, path)
    rows = {r.row_id: r for r in good.collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5, 6]
    assert rows[2].product_name == "Staples, 10 pack"
    assert rows[3].product_name == 'The "Best" Chair'
    assert rows[4].city is None
    assert rows[5].sales == Decimal("12.35")
    assert rows[6].quantity == 200
    assert rows[1].order_date == dt.date(2014, 1, 2)
    bad = {r.row_id: r.reject_reason for r in rejects.collect()}
    assert bad[9] == "quantity out of range"
    assert set(bad.values()) == {"unparsable cell", "quantity out of range"}
    assert len(bad) == 3


def test_csv_failfast(spark, tmp_path):
    path = _write(tmp_path, [_row(), _row(row_id="2", sales="abc")])
    good, _ = load_sales_csv(spark, path, on_bad="fail")
    with pytest.raises(Exception):
        good.collect()
    path2 = _write(tmp_path, [_row(), _row(row_id="2", quantity="300")])
    good2, _ = load_sales_csv(spark, path2, on_bad="fail")
    with pytest.raises(Exception):
        good2.collect()


def test_parquet_and_csv_sinks_keep_names(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "`Is Core Market` int, `Ship Mode` string")
    land_parquet(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).columns == ["Is Core Market", "Ship Mode"]
    export(df, str(tmp_path / "c"), fmt="csv", single_file=True)
    back = spark.read.option("header", True).csv(str(tmp_path / "c"))
    assert back.columns == ["Is Core Market", "Ship Mode"] and back.count() == 1


def test_land_csv_parses_once_and_splits_by_status(spark, tmp_path):
    from saleslens.sources import land_sales_csv

    path = _write(tmp_path, [_row(row_id="1"), _row(row_id="2", sales="abc"), _row(row_id="3", quantity="256")])
    good, rejects = land_sales_csv(spark, path, str(tmp_path / "landed"))
    assert [r.row_id for r in good.collect()] == [1]
    assert sorted(r.reject_reason for r in rejects.collect()) == ["quantity out of range", "unparsable cell"]
    assert sorted(p.name for p in (tmp_path / "landed").iterdir() if p.is_dir()) == [
        "ingest_status=good",
        "ingest_status=rejected",
    ]
    clean_only = _write(tmp_path, [_row(row_id="9")])
    good2, rejects2 = land_sales_csv(spark, clean_only, str(tmp_path / "landed2"))
    assert good2.count() == 1 and rejects2.count() == 0


def test_pipeline_from_csv(spark, tmp_path):
    from saleslens.plans.pipeline import run_pipeline

    path = _write(tmp_path, [_row(row_id=str(i), market="EMEA" if i % 2 else "EU") for i in range(1, 7)] + [_row(row_id="7", discount="x")])
    paths = run_pipeline(spark, path, str(tmp_path / "run"))
    fixed = spark.read.parquet(paths["clean"])
    assert fixed.count() == 6 and {r.market for r in fixed.collect()} == {"EU"}
    rep = spark.read.parquet(paths["corrections/market_report"]).first()
    assert (rep.country, rep.rows_changed) == ("Austria", 3)


def test_command_line_run(spark, tmp_path, capsys):
    from saleslens.__main__ import main

    path = _write(tmp_path, [_row(row_id=str(i)) for i in range(1, 4)])
    main([path, str(tmp_path / "cli"), "--processed-csv", "--csv-marts"])
    out = capsys.readouterr().out
    assert "processed_csv" in out and "gates/market_performance" in out
    processed = spark.read.option("header", True).csv(str(tmp_path / "cli" / "processed_csv"))
    assert processed.count() == 3 and "profit" not in processed.columns


def test_declared_text_limits_reject_long_values(spark, tmp_path):
    from saleslens.sources.schema import TEXT_LIMITS

    path = _write(tmp_path, [_row(row_id="1"), _row(row_id="2", market="M" * 31)])
    good, rejects = load_sales_csv(spark, path, max_lengths=TEXT_LIMITS)
    assert [r.row_id for r in good.collect()] == [1]
    assert [r.reject_reason for r in rejects.collect()] == ["market longer than 30"]
