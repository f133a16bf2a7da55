"""Operator 6: held-out accuracy, and the parts against direct computations."""

import random
import zlib

import numpy as np
import pytest

from saleslens.llm import toxicity

RUDE = "moron idiot scum lowei lostra".split()


@pytest.fixture(scope="module")
def rows(words):
    draw = random.Random(3)
    out = []
    for i in range(900):
        t = draw.choices(words, k=draw.randint(10, 50))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(draw.randint(1, 3)):
                w = draw.choice(RUDE)
                t.insert(draw.randrange(len(t)), w + draw.choice(["ab", "cd", "ef", "gh"]) if w[0] == "l" else w)
        out.append((i, " ".join(t).capitalize() + ".", int(toxic)))
    return out


@pytest.fixture(scope="module")
def scored(spark, rows):
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows] + [(None, None, None), (2000, "", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(None, 1), (7, None)], "doc_id long, toxic int")
    return toxicity.score_toxicity(docs, labels).collect()


def test_held_out_accuracy(rows, scored):
    label = {i: x for i, _, x in rows}
    held = [r for r in scored if r.doc_id in label and r.held_out]
    assert {r.doc_id for r in held} == {i for i in label if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == label[r.doc_id] for r in held]) >= 0.97
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in scored)


def test_held_out_labels_do_not_matter(spark, rows, scored):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    flipped = [(i, 1 - x if zlib.crc32(str(i).encode()) % 5 == 0 else x) for i, _, x in rows]
    again = toxicity.score_toxicity(docs, spark.createDataFrame(flipped, "doc_id long, toxic int")).collect()
    before = {r.doc_id: r.score for r in scored}
    assert all(r.score == pytest.approx(before[r.doc_id]) for r in again)


def test_odd_texts_have_a_score(scored):
    odd = [r for r in scored if r.doc_id in (None, 2000)]
    assert len(odd) == 2 and odd[0].score == odd[1].score and odd[0].predicted == 0


def test_without_labels_or_rows(spark, rows):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score_toxicity(docs, none).collect()] == [0.5, 0.5]
    assert toxicity.score_toxicity(docs.limit(0), none).collect() == []


def test_isotonic_is_the_best_rising_curve():
    draw = np.random.default_rng(1)
    for _ in range(50):
        x, y = draw.integers(0, 6, 30).astype(float), (draw.random(30) < 0.5).astype(float)
        xs, ys = toxicity.isotonic(x, y)
        assert (np.diff(ys) >= 0).all() and (np.diff(xs) >= 0).all()


def test_trees_learn_an_interaction():
    draw = np.random.default_rng(2)
    x = draw.random((2000, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 2] > 0.3)).astype(float)
    model = toxicity.fit_trees(x[:1500], y[:1500])
    assert np.mean((model.raw(x[1500:]) > 0) == (y[1500:] > 0)) > 0.97


def test_features_on_odd_texts():
    lexicon = toxicity.Lexicon({b"=moron": 4.0, b"lowe": 3.5})
    for text in (None, b"", b" \n ", "é".encode() * 10, b"a" * 200_000, b"you moron! YOU M0R0N", b"\x00 1.2.3"):
        values = toxicity.features(text, lexicon)
        assert len(values) == len(toxicity.FEATURES) and np.isfinite(values).all()
    named = dict(zip(toxicity.FEATURES, toxicity.features(b"you moron", lexicon), strict=True))
    assert named["near_share"] == 0.5 and named["second_person_share"] == 0.5 and named["tier_2_share"] == 0.5
    assert dict(zip(toxicity.FEATURES, toxicity.features(b"a m0r0n", lexicon), strict=True))["masked_count"] > 0


def test_an_id_of_a_third_of_all_rows_counts_once(spark, rows):
    docs = [(i, t) for i, t, _ in rows]
    hot = next((i, t) for i, t, x in rows if x and zlib.crc32(str(i).encode()) % 5)
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    plain, repeated = (
        toxicity.fit(spark.createDataFrame(d, "doc_id long, text string"), labels) for d in (docs, docs + [hot] * 400)
    )
    texts = [t.encode() for _, t in docs]
    assert np.array_equal(plain.score(texts), repeated.score(texts))
    assert (plain.lexicon.whole, plain.lexicon.stems) == (repeated.lexicon.whole, repeated.lexicon.stems)
