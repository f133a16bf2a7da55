"""Operator 5: the models, the cut, the selection and the sampled rows against direct counts."""

import math
import random

import numpy as np
import pytest

from saleslens.llm import quality


@pytest.fixture(scope="module")
def rows(words):
    draw = random.Random(1)
    good = [" ".join(draw.choice(words) for _ in range(draw.randint(20, 60))) for _ in range(120)]
    bad = [" ".join(w.upper() + "!!" for w in draw.choices(words, k=150)) for _ in range(15)]
    bad += [" ".join([draw.choice(words)] * 150) for _ in range(15)]
    return [(i, t, 1 if i < 120 else 0) for i, t in enumerate(good + bad)]


def tables(spark, docs_of, rows):
    docs = docs_of([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 2], "doc_id long, quality int")
    return docs, labels


def test_junk_goes_and_clean_documents_stay(spark, docs_of, rows):
    docs, labels = tables(spark, docs_of, rows)
    got = {r.doc_id: r.kept for r in quality.resample(docs, labels).collect()}
    assert all(not got[i] for i, _, q in rows if q == 0)
    assert sum(got[i] for i, _, q in rows if q) >= 117
    kept = quality.keep_resampled(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}


def test_weights_are_the_log_ratio_of_the_models(spark, docs_of, rows):
    docs, labels = tables(spark, docs_of, rows)
    ratio, _ = quality.fit(docs, labels)
    # buckets that the target never shows keep the raw model's share of it
    assert ratio.min() == pytest.approx(math.log(quality.PRIOR))
    unseen = set(quality.ngram_buckets("ALPHA!!".encode()).tolist())
    assert ratio[sorted(unseen)].min() == pytest.approx(math.log(quality.PRIOR))
    scored = {r.doc_id: r.log_weight for r in quality.resample(docs, labels).collect()}
    for i, t, _ in rows:
        assert scored[i] == pytest.approx(float(ratio[quality.ngram_buckets(t.encode())].sum()))


def test_cut_has_the_fewest_errors():
    draw = np.random.default_rng(0)
    for _ in range(100):
        w, good = draw.normal(size=12).round(1), draw.random(12) < 0.6
        cut = quality.best_cut(w, good)
        errors = lambda c: int((good & (w < c)).sum() + (~good & (w >= c)).sum())
        assert errors(cut) == min(errors(c) for c in [-np.inf, np.inf, *w, *(w + 1e-9)])


@pytest.mark.parametrize("k", [1, 7, 50, 200])
def test_kth_largest(spark, k):
    draw = random.Random(k)
    values = [draw.choice([draw.randint(-(1 << 50), 1 << 50), draw.randint(-5, 5)]) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert quality.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]


def test_sampling_follows_the_weights(spark):
    # Gumbel top-1 of two rows draws each in proportion to its weight
    from pyspark.sql import functions as F

    draws = spark.range(20_000).select(quality.gumbel(F.col("id"), F.lit(1)).alias("a"), quality.gumbel(F.col("id"), F.lit(2)).alias("b"))
    share = draws.selectExpr(f"avg(cast(a + {math.log(3.0)} > b as int)) AS s").first().s
    assert share == pytest.approx(0.75, abs=0.015)


def test_odd_rows(spark, docs_of, rows):
    odd = [(None, "alpha beta"), (500, None), (501, ""), (1, rows[1][1])]
    docs = docs_of([(i, t) for i, t, _ in rows] + odd)
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None), (5, 1)], "doc_id long, quality int")
    assert quality.resample(docs, labels).count() == len(rows) + 4
    none = labels.limit(0)
    assert all(r.kept for r in quality.resample(docs, none).collect())
    assert quality.keep_resampled(docs, none).count() == len(rows) + 4
    assert quality.resample(docs.limit(0), labels).collect() == []


@pytest.mark.parametrize("good", [0, 1])
def test_an_id_of_a_third_of_all_rows_counts_once(spark, docs_of, rows, good):
    docs, labels = tables(spark, docs_of, rows)
    known = {r.doc_id: r for r in quality._labelled(labels).collect()}
    hot = next((i, t) for i, t, q in rows if i in known and q == good and known[i].for_cut != bool(good))
    repeated = docs_of([(i, t) for i, t, _ in rows] + [hot] * 80)
    plain, crowded = quality.fit(docs, labels)[0], quality.fit(repeated, labels)[0]

    def raw_share(texts):
        raw = sum(np.bincount(quality.ngram_buckets(t.encode()), minlength=quality.BUCKETS) for t in texts)
        return (raw + 0.5) / (raw.sum() + 0.5 * quality.BUCKETS)

    texts = [t for _, t, _ in rows]
    once, many = raw_share(texts), raw_share(texts + [hot[1]] * 80)
    # the raw model sees every row, the target model one document
    assert np.allclose(np.exp(plain) * once - quality.PRIOR * once, np.exp(crowded) * many - quality.PRIOR * many, atol=1e-9)


def test_kept_rows_are_the_largest_keys(spark, docs_of, rows):
    docs, labels = tables(spark, docs_of, rows)
    got = quality.resample(docs, labels).collect()
    k = sum(r.kept for r in got)
    first = sorted(got, key=lambda r: -r.key)[:k]
    assert 0 < k < len(got) and all(r.kept for r in first)
