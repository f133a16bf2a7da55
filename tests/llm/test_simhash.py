"""Operator 7 against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash

from saleslens.llm import simhash
from saleslens.llm.components import components


def print_of(text):
    w = text.encode().lower().split() if text else []
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(keys, distance=3):
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            if (int(keys[i]) ^ int(keys[j])).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(keys))]


def clustered(draw, n, flips=4):
    base = draw.integers(0, 2**63, 12, dtype=np.uint64)
    keys = draw.choice(base, n)
    for _ in range(flips):
        bit = np.uint64(1) << draw.integers(0, 64, n).astype(np.uint64)
        keys = np.where(draw.random(n) < 0.6, keys ^ bit, keys)
    return np.unique(keys)


@pytest.mark.parametrize("seed", range(8))
def test_walk_finds_all_links(seed, monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 64)
    keys = clustered(np.random.default_rng(seed), 150)
    assert simhash.walk(np.zeros(len(keys), int), keys, 3).tolist() == groups(keys)


@pytest.mark.parametrize("hot_node", [2, 20, 100_000])
def test_distributed_links_equal_brute_force(spark, hot_node, monkeypatch):
    monkeypatch.setattr(simhash, "TASK_ROWS", 50)
    keys = clustered(np.random.default_rng(9), 250)
    signed = keys.view(np.int64).tolist()
    df = spark.createDataFrame([(k,) for k in signed], "fp long")
    found = {r.node: r.root for r in components(simhash.near_links(df, 3, hot_node)).collect()}
    ours = {}
    for k in signed:
        ours.setdefault(found.get(k, k), set()).add(k)
    expected = {}
    for k, g in zip(signed, groups(keys), strict=True):
        expected.setdefault(g, set()).add(k)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, expected.values()))


def test_components_of_chains_and_hubs(spark):
    draw = random.Random(1)
    chain = [(i, i + 1) for i in range(0, 40)]
    hub = [(100, i) for i in range(101, 160)]
    links = [p if draw.random() < 0.5 else p[::-1] for p in chain + hub] + [(200, 200), (100, 101)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.fixture(scope="module")
def rows(words):
    draw = random.Random(6)
    texts = [" ".join(draw.choices(words, k=draw.randint(0, 120))) for _ in range(25)]
    near = [t + " extra" for t in texts[:10]] + [t.upper() for t in texts[:5]]
    odd = [(None, texts[0]), (None, "lone words here now"), (900, None), (901, ""), (902, " \t "), (3, texts[3]), (905, "w " * 20_000)]
    return list(enumerate(texts + near)) + odd


def expected_rows(rows):
    keys = [print_of(t) for _, t in rows]
    root = groups(keys)
    least = {}
    for (i, _), g in zip(rows, root, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return [(i, f"{k:016x}", least.get(g)) for (i, _), k, g in zip(rows, keys, root, strict=True)]


def test_rows_equal_brute_force(docs_of, rows):
    got = [tuple(r) for r in simhash.near_duplicates(docs_of(rows)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected_rows(rows)))
    assert simhash.near_duplicates(docs_of(rows).limit(0)).collect() == []


def test_one_of_each_group_stays(docs_of, rows):
    docs = docs_of(rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    expected = expected_rows(rows)
    ids = sorted({c for _, _, c in expected if c is not None})
    got = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in got if i is not None) == ids
    assert got.count(None) == len({f for i, f, c in expected if c is None})
