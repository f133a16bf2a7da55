"""Operator 8 against set differences."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from saleslens.llm import versions

UNIT = re.compile(r"[^ \t\n\x0b\f\r]+(?:[ \t\x0b\f\r]+[^ \t\n\x0b\f\r]+){0,15}")


def units(text):
    return set(UNIT.findall(text or ""))


def likeness(a, b):
    a, b = units(a), units(b)
    return 1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0


@pytest.fixture(scope="module")
def rows(words):
    draw = random.Random(8)
    some = lambda n: "\n".join(" ".join(draw.choices(words, k=draw.randint(1, 40))) for _ in range(n))
    out = [(i * 3, some(draw.randint(0, 12))) for i in range(40)] + [(1, some(400)), (2, "é" * 7), (4, None), (5, "")]
    return out + [(7, out[3][1])]


def check(docs, rows):
    got = {r.doc_id: r for r in versions.fingerprint_versions(docs).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    seen = {}
    for k, (i, t) in enumerate(ordered):
        t, after = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        r = got[i]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(likeness(t, edited))
        assert r.near_next == pytest.approx(likeness(t, after))
        for text, mark in ((t, r.fingerprint), (edited, r.edited_fingerprint)):
            assert seen.setdefault(text, mark) == mark


def test_rows_equal_direct_computation(docs_of, rows):
    check(docs_of(rows), rows)


def test_null_id_comes_last(docs_of, rows):
    check(docs_of([*rows, (None, "the last one")]), [*rows, (None, "the last one")])


def test_largest_and_odd_ids(spark, docs_of):
    rows = [(2**63 - 1, "a b\nc d"), (5, "x y z w")]
    check(docs_of(rows), rows)
    texts = {"9": "x y z w", "10": "a b c d", "n": "k l m n"}  # numbers first, in their order
    odd = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    got = {r.doc_id: r.edited_sha256 for r in versions.fingerprint_versions(odd).collect()}
    for (i, text), after in zip(texts.items(), ["a b c d", "k l m n", "x y z w"], strict=True):
        cut = len(text) // 4
        assert got[i] == hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()


def test_retries_recover_the_same_difference(docs_of, rows, monkeypatch):
    monkeypatch.setattr(versions, "SHARD_LOAD", 40)  # first tries that mostly fail
    check(docs_of(rows), rows)


def test_repeated_rows_and_small_tables(docs_of):
    got = versions.fingerprint_versions(docs_of([(1, "a b c d"), (1, "a b c d"), (2, "x y z w")])).collect()
    assert len(got) == 3 and len({tuple(r) for r in got if r.doc_id == 1}) == 1
    edited = {1: "a b c x", 2: "x y z a"}
    assert all(r.edited_sha256 == hashlib.sha256(edited[r.doc_id].encode()).hexdigest() for r in got)
    one = versions.fingerprint_versions(docs_of([(1, "a b c d")])).first()
    assert one.near_next == 1.0
    assert versions.fingerprint_versions(docs_of([(1, "a")]).limit(0)).collect() == []


def test_peeling_recovers_the_digests(spark):
    a, b = list(range(1, 30)), list(range(20, 45))
    df = spark.createDataFrame([(a, b)], "a array<long>, b array<long>")
    mark = lambda c: F.transform(c, lambda x: versions._marked(F.xxhash64(x)))
    df = df.select(mark("a").alias("a"), mark("b").alias("b"))
    df, roomy = versions.Size.add(df, F.lit(4), "roomy")
    df, tight = versions.Size.add(df, F.lit(0), "tight")
    differing = lambda size: versions.peeled(
        versions.subtract(versions.sketch(F.col("a"), size), versions.sketch(F.col("b"), size))
    )
    row = df.select(
        F.array_sort(F.transform(differing(roomy), lambda q: q["x"])).alias("got"),
        F.array_sort(F.concat(F.array_except("a", "b"), F.array_except("b", "a"))).alias("want"),
        differing(tight).alias("crowded"),
    ).first()
    assert row.got == row.want and row.crowded is None


def test_runs_in_the_jvm_alone(docs_of, rows):
    plan = versions.fingerprint_versions(docs_of(rows))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|InArrow", plan)
