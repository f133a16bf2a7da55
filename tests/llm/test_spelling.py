"""Operator 13 against comparisons of all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from saleslens.llm import spelling


def words_of(rows):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(counts):
    form, out = {}, {}
    for w, n in counts.items():
        found = [v for v in counts if near(w, v)]
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
        out[w] = len(found)
    rows = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n, out[w], counts.get(form[w])))
    return sorted(map(str, rows))


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(13)
    base = ["aabbcc", "abcde", "éclair", "straÿe", "aaaaaa", "bananas", "ÀBCDE", "zzzzzzz"]
    made = []
    for b in base:
        made += [b] * draw.randint(3, 40)
        for _ in range(25):
            k, c = draw.randrange(len(b)), draw.choice("abcé")
            v = draw.choice([b[:k] + c + b[k + 1 :], b[:k] + b[k + 1 :], b[:k] + c + b[k:]])
            made += [v] * draw.randint(1, 12)
    draw.shuffle(made)
    out = [(i, draw.choice([" ", ", ", "1", "\n"]).join(made[at : at + 9])) for i, at in enumerate(range(0, len(made), 9))]
    out += [(900 + i, f"common thing number {i} commun") for i in range(300)]  # enough for damaged runs
    out += [(None, "abcde Abcde nullid nullid nullid"), (7, None), (8, ""), (9, "x" * 3000 + " "), (9, "x" * 3000), (9, "x" * 3000)]
    return out + [(10, "y" * 2999 + "z"), (11, "y" * 2999 + "z " + "y" * 3000), (12, "y" * 2999 + "z")] + [(5, "abcde")] * 3


@pytest.mark.parametrize("partitions", ["1", "8", "61"])
def test_rows_equal_brute_force(spark, docs_of, rows, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = spelling.spelling_variants(docs_of(rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(str(tuple(r)) for r in got) == brute(words_of(rows))


def test_chains_lead_to_one_root(spark):
    chain = [("abcde" + "f" * k, 3 * 2**k) for k in range(20)]
    counts = spark.createDataFrame(chain + [("other", 5)], "word string, n long")
    got = {r.word: r for r in spelling.group_words(counts).collect()}
    assert {got[w].root for w, _ in chain} == {chain[-1][0]} and got["other"].root == "other"
    assert got["abcde"].form == "abcdef" and got[chain[-1][0]].form is None


def test_empty_tables(docs_of):
    docs = docs_of([(1, None), (2, "")])
    assert spelling.spelling_variants(docs).collect() == []
    assert spelling.spelling_variants(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        spelling.spelling_variants(docs, ratio=1)
