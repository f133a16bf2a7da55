"""Incremental CSV landing: each file once, rejects kept aside, restart-safe."""

import pytest

from saleslens.streaming import stream_land_csv

from test_sources import HEADER, _row


def _file(d, name, lines):
    (d / name).write_text("\n".join([HEADER, *lines]) + "\n")


def test_stream_lands_new_files_once(spark, tmp_path):
    src, out, ckpt = tmp_path / "src", tmp_path / "out", tmp_path / "ckpt"
    src.mkdir()
    _file(src, "a.csv", [_row(row_id="1"), _row(row_id="2", sales="bad")])
    _file(src, "b.csv", [_row(row_id="3")])
    q = stream_land_csv(spark, str(src), str(out), checkpoint=str(ckpt))
    q.awaitTermination(120)
    good = spark.read.parquet(str(out / "good"))
    assert sorted(r.row_id for r in good.collect()) == [1, 3]
    assert spark.read.parquet(str(out / "rejects")).count() == 1

    # a restarted stream only takes the new file
    _file(src, "c.csv", [_row(row_id="4"), _row(row_id="5", quantity="999")])
    q = stream_land_csv(spark, str(src), str(out), checkpoint=str(ckpt))
    q.awaitTermination(120)
    good = spark.read.parquet(str(out / "good"))
    assert sorted(r.row_id for r in good.collect()) == [1, 3, 4]
    reasons = sorted(r.reject_reason for r in spark.read.parquet(str(out / "rejects")).collect())
    assert reasons == ["quantity out of range", "unparsable cell"]


@pytest.mark.parametrize("breaks", [True, False])
def test_stream_with_and_without_quoted_line_breaks(spark, tmp_path, breaks):
    src, out = tmp_path / "src", tmp_path / "out"
    src.mkdir()
    _file(src, "a.csv", [_row(row_id="1", city='"two\nlines"'), _row(row_id="2")])
    q = stream_land_csv(spark, str(src), str(out), checkpoint=str(tmp_path / "ckpt"), quoted_line_breaks=breaks)
    q.awaitTermination(120)
    good = {r.row_id: r.city for r in spark.read.parquet(str(out / "good")).collect()}
    assert good == ({1: "two\nlines", 2: "Vienna"} if breaks else {2: "Vienna"})
    if breaks:  # without a reject no file is written
        assert not list((out / "rejects").rglob("*.parquet"))
    else:
        assert spark.read.parquet(str(out / "rejects")).count() == 2
