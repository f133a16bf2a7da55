"""Driver contract: entry, query registry, oracle SQL (checked on sf0.001)."""

import datetime as dt
import decimal
import os
import subprocess
import sys

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from saleslens.plans.oracle import oracle_queries
from saleslens.plans.queries import registry

from tables import SF_SMALL

TABLES = "region nation customer supplier part orders lineitem".split()


def _norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        f = round(float(v), 6)
        return 0.0 if f == 0 else f
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return v


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=lambda t: tuple((x is None, str(x)) for x in t))
    return [cols[i] for i in order], out


def test_entry_flagship(spark):
    df = entry(spark)
    rows = df.collect()
    assert len(rows) == 5
    assert df.columns == ["market", "country_count", "revenue", "revenue_pct", "aov", "order_count", "order_count_pct"]
    assert abs(sum(r.revenue_pct for r in rows) - 1) < 1e-5


def test_every_query_has_an_oracle_except_random_ones():
    assert set(oracle_sql()) <= set(queries())
    assert set(registry()) - set(oracle_sql()) == {"sample_rows", "column_profile_approx"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t + '.parquet')}')")
    return con


@pytest.mark.parametrize("name", sorted(set(oracle_queries()) & set(registry())))
def test_query_matches_oracle(spark, duck, name):
    sdf = queries()[name](spark, SF_SMALL)
    res = duck.execute(oracle_sql()[name])
    sc, sr = _canon(sdf.columns, [tuple(r) for r in sdf.collect()])
    dc, dr = _canon([d[0] for d in res.description], res.fetchall())
    assert sc == dc
    assert sr == dr


@pytest.mark.parametrize("missing", ["saleslens.llm.queries", "corpus_pipeline", "xxhash"])
def test_other_queries_live_without_the_training_data_ones(missing):
    """In a process of its own: an import that fails there takes no other query with it."""
    code = (
        f"import sys; sys.modules[{missing!r}] = None\n"
        "import __spark_entry__ as e\n"
        "from saleslens.plans.queries import registry\n"
        "assert set(registry()) <= set(e.queries()) and 'pipeline' not in e.queries()\n"
        "assert set(e.oracle_sql()) <= set(e.queries())\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
