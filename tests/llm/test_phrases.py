"""Operator 12 against counts of all runs of words."""

import random
import re
from collections import Counter

import pytest

from saleslens.llm import phrases


def pieces_of(rows):
    for _, text, lang in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            yield lang or "und", re.findall("[^ \t]+", piece)


def brute_counts(rows, most):
    f = Counter()
    for lang, w in pieces_of(rows):
        for s in range(1, most + 1):
            f.update((lang, tuple(w[i : i + s])) for i in range(len(w) - s + 1))
    return f


def brute(rows, most=3, least=10, share=50, top=2000):
    f = brute_counts(rows, most)
    frequent = {k: n for k, n in f.items() if len(k[1]) >= 2 and n >= least}
    hidden = set()
    for (lang, p), n in frequent.items():
        for s in range(2, len(p)):
            for i in range(len(p) - s + 1):
                part = (lang, p[i : i + s])
                if 100 * n >= share * f[part]:
                    hidden.add(part)
    out = []
    for lang in {k[0] for k in f}:
        found = []
        for (where, p), a in frequent.items():
            if where != lang or (lang, p) in hidden:
                continue
            cuts = [(f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
            score, _, l, r = min((1000000 * a * a // (l * r), k, l, r) for k, (l, r) in enumerate(cuts))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        n = sum(c for (where, p), c in f.items() if where == lang and len(p) == 1)
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -score))
    return sorted(map(str, out))


@pytest.fixture(scope="module")
def rows(words):
    draw = random.Random(12)
    some = lambda n: " ".join(draw.choices(words, weights=range(1, len(words) + 1), k=n))
    lines = ["one long Line that is often said, in the very same words. every time", "tic tac tic tac tic tac tic tac", "naïve é\tü"]
    out = []
    for i in range(150):
        text = ". ".join(draw.choice([some(draw.randint(0, 30)), draw.choice(lines)]) for _ in range(draw.randint(0, 6)))
        out.append((i, draw.choice(["", "!\n"]) + text, draw.choice(["en", "de", None, "und"])))
    out += [(200, None, "en"), (201, "", None), (202, " \t.;", "fr"), (203, "a " * 30, "x y\tz"), (204, some(5000), "en")]
    return out + [(205, lines[0], "en")] * 60


@pytest.fixture
def table(spark):
    def build(rows):
        full = [(i, t, lang, 0, "x", "y") for i, t, lang in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, n long, phrase string, size string")

    return build


@pytest.mark.parametrize("small", [False, True])
def test_rows_equal_brute_force(table, rows, small, monkeypatch):
    if small:  # many buckets, blocks, pieces of texts and rows of paths
        for name, size in (("BUCKET_BYTES", 5_000), ("HELD_WORDS", 300), ("CHUNK", 100), ("SEGMENT", 3), ("RANK_PARTS", 3)):
            monkeypatch.setattr(phrases, name, size)
    got = phrases.collocations(table(rows)).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)


@pytest.mark.parametrize("most,least,share,top", [(2, 5, 50, 2000), (5, 4, 80, 2000), (3, 3, 10, 7)])
def test_other_parameters(table, rows, most, least, share, top):
    got = phrases.collocations(table(rows), most, least, share, top).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows, most, least, share, top)


def test_paths_hold_all_counts(table, rows, monkeypatch):
    monkeypatch.setattr(phrases, "SEGMENT", 4)
    counts = phrases.phrase_counts(table(rows))
    paths = phrases.compact_paths(counts)
    assert any("one long line that" in r.path for r in paths.collect())
    got = {(r.lang, tuple(r.phrase.split(" "))): r.n for r in phrases.path_counts(counts, paths).collect()}
    wanted = {k: n for k, n in brute_counts(rows, 3).items() if len(k[1]) == 1 or n >= 10}
    assert got == wanted


def test_one_path_a_piece(table):
    text = " ".join(f"w{i}" for i in range(40))
    paths = phrases.compact_paths(phrases.phrase_counts(table([(i, text, "en") for i in range(12)])))
    assert [tuple(r) for r in paths.collect()] == [("en", text, 12)]


def test_large_counts_are_exact(spark):
    big = 3_000_000_000_000
    counts = spark.createDataFrame(
        [("en", 1, "a", big + 7), ("en", 1, "b", big + 1), ("en", 2, "a b", big)], "lang string, size int, phrase string, n long"
    )
    row = phrases.score_phrases(counts, 2, 10, 50).first()
    assert row.score == 1000000 * big * big // ((big + 7) * (big + 1)) and (row.l, row.r) == (big + 7, big + 1)


def test_empty_tables(table):
    assert phrases.collocations(table([(1, None, "en"), (2, "", "de")])).collect() == []
    assert phrases.collocations(table([(1, None, "en")]).limit(0)).collect() == []
