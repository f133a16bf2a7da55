"""Operator 4 against a brute-force scan."""

import hashlib
import random
import re

import pytest

from saleslens.llm import decontamination as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    w, hit, named = split(text), set(), set()
    for item, body in items:
        v = split(body)
        n = min(10, len(v))
        for i in range(len(v) - n + 1) if n else ():
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[i : i + n]:
                    hit.update(range(p, p + n))
                    named.add(str(item))
    names = ",".join(sorted(named))
    return len(w), len(hit), len(named), hashlib.sha256(names.encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def case():
    draw = random.Random(2)
    vocabulary = [a + b for a in "abcdé" for b in "xyz"]
    some = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = [(i, some(draw.randint(8, 40))) for i in range(12)] + [(12, "One, two!"), (13, "..."), (14, None), (3, some(15))]
    rows = []
    for i in range(40):
        text = some(draw.randint(0, 30))
        if i % 3 == 0:
            text += ". " + draw.choice(items[:12])[1].upper().replace(" ", " - ") + " " + some(5)
        rows.append((i, text))
    rows += [(1, "say ONE-TWO again"), (1, "say ONE-TWO again"), (None, some(20)), (50, None), (51, "")]
    return rows, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_scan_equals_brute_force(spark, docs_of, case, block_bytes):
    rows, items = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = d.contamination(docs_of(rows), bench, block_bytes=block_bytes).collect()
    expected = [(i, *brute(t, items)) for i, t in rows]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, expected))


def test_removal_leaves_clean_documents_alone(spark, docs_of, case):
    rows, items = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(rows)
    kept = d.remove_contamination(docs, bench)
    assert kept.columns == docs.columns
    after = sorted(((r.doc_id, r.text, r.n_chars) for r in kept.collect()), key=str)
    clean = [(i, t) for i, t in rows if not brute(t, items)[4]]
    for i, t in clean:
        assert (i, t, len(t) if t is not None else None) in after
    assert all(n is None or n == len(t) for _, t, n in after) and len(after) == len(rows)
    assert sorted(map(str, ((i, t) for i, t, _ in after if not brute(t, items)[1]))) == sorted(map(str, ((i, t) for i, t, _ in after)))
    gone = d.remove_contamination(docs, bench, mode="documents")
    assert sorted(map(str, ((r.doc_id, r.text) for r in gone.collect()))) == sorted(map(str, clean))


def test_empty_tables(spark, docs_of, case):
    rows, items = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert d.contamination(docs_of(rows).limit(0), bench).collect() == []
    assert not any(r.contaminated for r in d.contamination(docs_of(rows), bench.limit(0)).collect())
