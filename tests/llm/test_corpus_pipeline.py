"""The corpus pipeline: each stage against plain Python on its own input, and the registered queries."""

import hashlib
import os
import random
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_decontamination import WORD, split
from test_simhash import groups, print_of
from test_substrings import brute as repeats_of

from __spark_entry__ import oracle_sql, queries
from saleslens.llm import oracle, quality
from saleslens.llm.common import stored_folders, through_storage
from saleslens.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, words, tmp_path_factory):
    """Documents with junk, copies, near copies, repeated and benchmark passages, nulls, repeated ids and long texts."""
    draw = random.Random(21)
    some = lambda n: " ".join(draw.choice(words) + draw.choice(["", ",", "."]) for _ in range(n))
    items = [(i, some(30)) for i in range(5)] + [(5, None), (6, "...")]
    passage = some(25)
    texts = {i: some(draw.randint(30, 120)) for i in range(150)}
    for i in range(0, 150, 7):
        texts[i] += " " + passage + " " + some(9)
    for i in range(3, 150, 11):
        texts[i] += " " + items[i % 5][1].upper() + " " + some(4)
    rows = [(i, t, "good") for i, t in texts.items()]
    rows += [(200 + i, texts[i], "good") for i in range(12)]  # copies
    rows += [(220 + i, texts[40 + i].replace(" ", "  ", 3) + " Q", "good") for i in range(12)]  # near copies
    rows += [(300 + i, " ".join([draw.choice(["#!", "zz9", "%%"])] * 200), "junk") for i in range(30)]
    rows += [(None, some(40), "good"), (None, None, "good"), (400, "", "good"), (401, None, "good"), (402, some(6000), "good")]
    rows += [(5, texts[5], "good")] * 3 + [(6, some(50), "good")]
    full = [(i, t, "en", s, None if t is None else len(t), "x") for i, t, s in rows]
    where = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, fingerprint string").write.parquet(
        f"{where}/documents.parquet"
    )
    labels = [(i, int(s == "good"), 0) for i, _, s in rows if i is not None and i % 3]
    spark.createDataFrame(labels + [(None, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


@pytest.fixture(scope="module")
def stages(spark, folder):
    """Input and output of every stage."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = through_storage(stage(spark, docs, folder), f"test-{name}")
        out[name] = (docs, after)
        docs = after
    return out


def listed(rows):
    return sorted(str(tuple(r)) for r in rows)


def test_columns_stay_and_counts_are_true(stages):
    for name, (before, after) in stages.items():
        if name != "sentencepiece":
            assert after.columns == before.columns
            assert after.filter("n_chars <> length(text)").count() == 0


def test_quality_stage_equals_plain_selection(spark, folder, stages):
    before, after = stages["quality"]
    known = {r.doc_id: r for r in quality._labelled(spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    rows = before.withColumn("noise", quality.gumbel(F.col("doc_id"), F.xxhash64("text"))).collect()
    grams = [Counter(quality.ngram_buckets(r.text.encode()).tolist()) if r.text else Counter() for r in rows]
    raw, good, learned = Counter(), Counter(), {}
    for r, g in zip(rows, grams, strict=True):
        raw.update(g)
        if r.doc_id in known:
            learned[r.doc_id, r.text] = (known[r.doc_id], g)
    for label, g in learned.values():
        if label.good and not label.for_cut:
            good.update(g)
    n_raw, n_good = sum(raw.values()) + 0.5 * quality.BUCKETS, sum(good.values())

    def weight(g):
        out = 0.0
        for b, n in g.items():
            p = (raw[b] + 0.5) / n_raw
            out += n * np.log((1 - quality.PRIOR) * good[b] / n_good / p + quality.PRIOR)
        return out

    held = [(weight(g), label.good) for label, g in learned.values() if label.for_cut]
    cut = quality.best_cut(np.array([w for w, _ in held]), np.array([g for _, g in held]))
    weights = [weight(g) for g in grams]
    k = sum(w >= cut for w in weights)
    keys = sorted((w + r.noise for w, r in zip(weights, rows, strict=True)), reverse=True)
    kept = [r[:-1] for w, r in zip(weights, rows, strict=True) if w + r.noise >= keys[k - 1] - 1e-6]
    assert k < len(rows) and listed(after.collect()) == listed(kept)
    assert not any(r.source == "junk" for r in after.collect())


def test_simhash_stage_equals_all_pairs(stages):
    before, after = stages["simhash"]
    rows = before.collect()
    root = groups([print_of(r.text) for r in rows])
    members = {}
    for r, g in zip(rows, root, strict=True):
        members.setdefault(g, []).append(r)
    got = after.collect()
    assert len(got) == len(members) < len(rows) and {tuple(r) for r in got} <= {tuple(r) for r in rows}
    least = [min((r.doc_id for r in m if r.doc_id is not None), default=None) for m in members.values()]
    assert sorted(map(str, least)) == sorted(str(r.doc_id) for r in got)


def test_suffix_array_stage_equals_all_windows(stages):
    before, after = stages["suffix_array"]
    rows, expected = before.collect(), []
    for r, flags in zip(rows, repeats_of([(r.doc_id, r.text) for r in rows]), strict=True):
        raw = np.frombuffer((r.text or "").encode(), np.uint8)
        text = None if r.text is None else raw[~flags].tobytes().decode(errors="ignore")
        expected.append((r.doc_id, text, r.lang, r.source, None if text is None else len(text), r.fingerprint))
    assert listed(after.collect()) == listed(expected) != listed(rows)


def test_decontamination_stage_equals_a_plain_scan(spark, folder, stages):
    before, after = stages["decontamination"]
    windows = set()
    for item in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = split(item.text)
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    expected = []
    for r in before.collect():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")
        text, found = r.text, list(WORD.finditer(low))
        w = split(text)
        hit = {p for v in windows for i in range(len(w) - len(v) + 1) if tuple(w[i : i + len(v)]) == v for p in range(i, i + len(v))}
        for p in sorted(hit, reverse=True):  # from the end, so that places stay
            if p + 1 not in hit:
                end = found[p].end()
            if p - 1 not in hit:
                text = text[: found[p].start()] + "\n" + text[end:]
        expected.append((r.doc_id, text, r.lang, r.source, None if text is None else len(text), r.fingerprint))
    assert listed(after.collect()) == listed(expected) != listed(before.collect())


def test_sentencepiece_stage_equals_the_library(folder, spark, stages):
    before, after = stages["sentencepiece"]
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    sha, expected = lambda t: hashlib.sha256(t.encode()).hexdigest(), []
    for r in before.collect():
        ids = library.encode(r.text or "", add_eos=True)
        expected.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    assert listed(after.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == listed(expected)
    with stored_folders() as folders:
        assert listed(corpus_pipeline.run(spark, folder).collect()) == listed(after.collect())
    # the last stage's input is left, what it was made from is gone
    assert [os.path.exists(f.removeprefix("file:")) for f in folders] == [False] * (len(folders) - 1) + [True]


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []


def test_every_operator_has_a_query():
    names = list(queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(oracle.oracle_queries()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries()[name](spark, SF)
    wanted = con.execute(oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(df.columns) == sorted(columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert sorted(map(str, got)) == sorted(map(str, wanted.fetchall()))
