"""Operator 6, toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features are lexicon densities (a lexicon of words and word beginnings,
learned from the labels), nearness of second-person words, capitals,
punctuation and signs of obfuscation. Lexicon, trees and calibration are
fitted on a bounded sample of labelled rows, each cross-fitted: a row never
takes part in what makes its own features or its own calibration score. The
whole table is then scored where it lies.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleslens.llm.common import bounded_sample, crc_fold, through_storage
from saleslens.llm.decontamination import words

#: Labelled rows that the model is fitted on, at most (chosen by their id hashes).
MAX_LABELLED = 20_000
#: One row in HOLD_OUT (by crc32 of the id) gives no label to the model.
HOLD_OUT = 5
#: Parts for cross-fitting.
FOLDS = 3
#: Documents of label 1 that a lexicon entry needs, and the entries kept (the surest ones).
MIN_DOCS, MAX_ENTRIES = 3, 20_000
#: Bytes of a word's beginning that can be an entry.
STEMS = (4, 5, 6)
#: Lower bounds of an entry's log odds that part the lexicon in tiers.
TIERS = (1.0, 2.0, 3.0)
#: Words within which a second-person word counts as near.
NEAR = 5
TREES, DEPTH, RATE, BINS, LEAST_ROWS = 60, 3, 0.2, 64, 5

# Second-person words of the languages in use (a fixed list).
SECOND_PERSON = frozenset(
    w.encode()
    for w in (
        "you your yours yourself u ur du dich dir dein deine deinen deiner euch euer ihr tu te toi ton ta tes vous "
        "votre vos tú ti tuyo tuya usted ustedes vosotros"
    ).split()
)
# Signs that stand for letters when words are masked (fixed pairs).
_LEET = bytes.maketrans(b"013457@$!|", b"oieastasii")
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_LOUD = b"!?"
_PUNCT = bytes(b for b in range(33, 127) if not chr(b).isalnum())

FEATURES = (
    *(f"tier_{i}_share" for i in range(len(TIERS))),
    *(f"tier_{i}_count" for i in range(len(TIERS))),
    "stem_share", "best_odds", "odds_per_root_words",
    "second_person_share", "near_share", "near_count",
    "capital_share", "shout_share", "loud_share", "punct_share",
    "mixed_share", "masked_count", "repeat_share", "log_words",
)


# --------------------------------------------------------------- features --


class Lexicon:
    """Entries (words as ``b"=word"``, beginnings as they are) with the lower bound of their log odds."""

    def __init__(self, odds: dict[bytes, float]):
        self.whole = {k[1:]: v for k, v in odds.items() if k[:1] == b"="}
        self.stems = [{k: v for k, v in odds.items() if k[:1] != b"=" and len(k) == n} for n in STEMS]

    def odds(self, word: bytes) -> float:
        return max(self.whole.get(word, 0.0), *(s.get(word[:n], 0.0) for n, s in zip(STEMS, self.stems)))


def features(text: bytes | None, lexicon: Lexicon) -> list[float]:
    """The dense features of a UTF-8 text; an empty one has zeros."""
    text = text or b""
    tokens = words(text)
    n, size = max(len(tokens), 1), max(len(text), 1)
    whole = lexicon.whole
    s0, s1, s2 = lexicon.stems
    k0, k1, k2 = STEMS
    at = [i for i, w in enumerate(tokens) if w in whole or w[:k0] in s0 or w[:k1] in s1 or w[:k2] in s2]
    odds = [lexicon.odds(tokens[i]) for i in at]
    tiers = [sum(v >= t for v in odds) for t in TIERS]
    stems = sum(tokens[i] not in whole for i in at)
    you = [i for i, w in enumerate(tokens) if w in SECOND_PERSON]
    strong = [i for i, v in zip(at, odds) if v >= TIERS[1]]
    near = 0
    if you and strong:
        after = np.searchsorted(you, strong)
        edge = np.concatenate(([-NEAR - 1 - len(tokens)], you, [2 * len(tokens) + NEAR + 1]))
        near = int((np.minimum(edge[after + 1] - strong, strong - edge[after]) <= NEAR).sum())
    capitals = size - len(text.translate(None, _UPPER))
    letters = max(capitals + size - len(text.translate(None, _LOWER)), 1)
    raw = text.split()
    masked, mixed, shouts, repeats = 0, 0, 0, 0
    for w in raw:
        if w.isalpha():
            shouts += len(w) > 2 and w.isupper()
            continue
        if w.isupper() and len(w) > 2:
            shouts += 1
        core = w.strip(_PUNCT)
        if not core.isalpha() and core.isascii() and core:
            mixed += 1
            plain = core.lower().translate(_LEET, b".*-_'~^")
            if plain != core.lower() and plain.isalpha() and lexicon.odds(plain) >= TIERS[0]:
                masked += 1
    for w in tokens:
        if len(w) > 3 and (w[0] == w[1] == w[2] or w[-1] == w[-2] == w[-3]):
            repeats += 1
    return [
        *(t / n for t in tiers),
        *(math.log1p(t) for t in tiers),
        stems / n, max(odds, default=0.0), sum(odds) / math.sqrt(n),
        len(you) / n, near / n, math.log1p(near),
        capitals / letters, shouts / n,
        (size - len(text.translate(None, _LOUD))) / size, (size - len(text.translate(None, _PUNCT))) / size,
        mixed / n, math.log1p(masked), repeats / n, math.log1p(len(tokens)),
    ]


def units(text: bytes | None) -> set[bytes]:
    """What a text can teach the lexicon: its words and their beginnings."""
    found = set()
    for w in set(words(text)):
        found.add(b"=" + w)
        found.update(w[:n] for n in STEMS if len(w) >= n)
    return found


def _bound_column(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    """The bound that ``lexicon_of`` ranks by."""
    odds = F.ln((toxic + 0.5) / F.lit(n_toxic + 1.0)) - F.ln((clean + 0.5) / F.lit(n_clean + 1.0))
    return odds - 1.64 * F.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


def lexicon_of(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, names: list[bytes]) -> Lexicon:
    """Entries whose log odds are above the lowest tier with 95 % confidence."""
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    bound = odds - 1.64 * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    good = np.flatnonzero((toxic >= MIN_DOCS) & (bound >= TIERS[0]))
    good = good[np.argsort(-bound[good], kind="stable")][:MAX_ENTRIES]
    return Lexicon({names[i]: float(bound[i]) for i in good})


# ------------------------------------------------------------------ trees --


@dataclass
class Trees:
    """Boosted regression trees of log odds: complete binary trees over binned features."""

    base: float
    edges: list[np.ndarray]
    feature: np.ndarray  # (trees, 2**DEPTH - 1)
    split: np.ndarray  # go right when the bin is above
    leaf: np.ndarray  # (trees, 2**DEPTH)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned, out = self.bins(x), np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, s, v in zip(self.feature, self.split, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (binned[rows, f[node]] > s[node])
            out += v[node - (2**DEPTH - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Newton boosting of the logistic loss on histograms of the features."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(float(np.log(share / (1 - share))), edges, *(np.zeros((0, 0)) for _ in range(3)))
    binned, raw = model.bins(x), np.full(len(y), model.base)
    nodes, leaves = 2**DEPTH - 1, 2**DEPTH
    features_, splits, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        feature, split = np.zeros(nodes, dtype=np.int64), np.full(nodes, BINS, dtype=np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            for j in range(x.shape[1]):
                cell = (node - first) * BINS + binned[:, j]
                g, h, c = (
                    np.bincount(cell, w, width * BINS).reshape(width, BINS).cumsum(axis=1) for w in (grad, hess, None)
                )
                gr, hr, cr = g[:, -1:] - g, h[:, -1:] - h, c[:, -1:] - c
                gain = g**2 / (h + 1) + gr**2 / (hr + 1) - g[:, -1:] ** 2 / (h[:, -1:] + 1)
                gain[(c < LEAST_ROWS) | (cr < LEAST_ROWS)] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better] = top[better]
                feature[first : first + width][better] = j
                split[first : first + width][better] = at[better]
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > split[node])
        leaf = node - nodes
        g, h = np.bincount(leaf, grad, leaves), np.bincount(leaf, hess, leaves)
        value = RATE * g / (h + 1)
        raw += value[leaf]
        features_.append(feature)
        splits.append(split)
        values.append(value)
    model.feature, model.split, model.leaf = (np.stack(v) for v in (features_, splits, values))
    return model


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step curve that fits ``y`` best (pool adjacent violators), shrunk by one half row."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum, count, first and last raw score
    for r, v in zip(raw[order], y[order], strict=True):
        blocks.append([float(v), 1.0, r, r])
        while len(blocks) > 1 and (blocks[-1][2] <= blocks[-2][3] or blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]):
            s, c, _, last = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += c
            blocks[-1][3] = last
    xs, ys = [], []
    for s, c, a, b in blocks:
        value = (s + 0.25) / (c + 0.5)
        xs += [a, b]
        ys += [value, value]
    return np.array(xs), np.maximum.accumulate(np.array(ys))


# -------------------------------------------------------------------- fit --


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, texts) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), float(self.knots[1][0]))
        x = np.array([features(t, self.lexicon) for t in texts], dtype=float).reshape(len(texts), len(FEATURES))
        return np.clip(np.interp(self.trees.raw(x), *self.knots), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model, from at most MAX_LABELLED labelled rows that are not held out.

    An id with both labels counts as label 1. Of rows with equal id and text
    one is learned from, and at most MAX_LABELLED rows in all, so an id that
    many rows repeat does not outweigh the others. Without rows of either
    label every text gets the smoothed share of label 1.
    """
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .filter(crc_fold(F.col("doc_id"), HOLD_OUT) != 0)
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    known = through_storage(bounded_sample(known, MAX_LABELLED, F.col("doc_id")), "toxicity-labels")
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(
        F.broadcast(known), "doc_id"  # at most MAX_LABELLED rows
    )
    rows = bounded_sample(rows, MAX_LABELLED, F.col("doc_id"), F.col("text"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    sample = through_storage(rows.select("text", "toxic", fold.alias("fold")), "toxicity-sample")
    sizes = {(r.fold, r.toxic): r.n for r in sample.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = np.array([[sizes.get((f, t), 0) for t in (0, 1)] for f in range(FOLDS)])
    clean, toxic = n.sum(axis=0)
    if not clean or not toxic:
        return Model(Lexicon({}), None, (np.zeros(1), np.array([(toxic + 0.5) / (toxic + clean + 1)])))

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for part in parts:
            for text, label, f in part.itertuples(index=False):
                seen.update((u, 2 * f + label) for u in units(text))
        if seen:
            keys = list(seen)
            yield pd.DataFrame({"unit": [k[0] for k in keys], "slot": [k[1] for k in keys], "n": list(seen.values())})

    counts = sample.mapInPandas(count, "unit binary, slot int, n long").groupBy("unit").agg(
        *[F.sum(F.when(F.col("slot") == s, F.col("n")).otherwise(0)).alias(f"s{s}") for s in range(2 * FOLDS)]
    )
    # The entries of each lexicon, ranked by their own bound: of all rows, and of those outside each fold.
    bounds = {}
    for left_out in (None, *range(FOLDS)):
        used = [k for k in range(FOLDS) if k != left_out]
        in_clean, in_toxic = (sum((F.col(f"s{2 * k + t}") for k in used), F.lit(0)) for t in (0, 1))
        sizes_used = [int(n[used, t].sum()) for t in (0, 1)]
        bounds[f"b{left_out}"] = F.when(in_toxic >= MIN_DOCS, _bound_column(in_toxic, in_clean, sizes_used[1], sizes_used[0]))
    ranked = counts.select("*", *[b.alias(name) for name, b in bounds.items()])
    ranked = through_storage(ranked.filter(F.greatest(*bounds) >= TIERS[0] - 1e-6), "toxicity-units")
    chosen = [ranked.filter(F.col(b).isNotNull()).orderBy(F.desc(b), "unit").limit(MAX_ENTRIES) for b in bounds]
    table = reduce(DataFrame.unionAll, chosen).dropDuplicates(["unit"]).orderBy("unit").toPandas()  # (FOLDS + 1) * MAX_ENTRIES
    names = [bytes(u) for u in table["unit"]]
    slots = table[[f"s{s}" for s in range(2 * FOLDS)]].to_numpy(dtype=float).reshape(len(names), FOLDS, 2)
    total = slots.sum(axis=1)
    lexicons = [
        lexicon_of(total[:, 1] - slots[:, f, 1], total[:, 0] - slots[:, f, 0], toxic - n[f, 1], clean - n[f, 0], names)
        for f in range(FOLDS)
    ]
    shared = docs.sparkSession.sparkContext.broadcast(lexicons)  # at most FOLDS * MAX_ENTRIES entries

    @F.pandas_udf("array<double>")
    def others(text: pd.Series, fold: pd.Series) -> pd.Series:
        return pd.Series([features(t, shared.value[f]) for t, f in zip(text, fold, strict=True)])

    fitted = sample.select("toxic", "fold", others("text", "fold").alias("x")).toPandas()  # numbers only
    fitted = fitted.sort_values(["fold", "toxic"], kind="stable")
    x = np.array(fitted["x"].tolist(), dtype=float)
    order = np.lexsort((*x.T, fitted["toxic"]))  # the same model whatever the order of rows
    x, y, f = x[order], fitted["toxic"].to_numpy(dtype=float)[order], fitted["fold"].to_numpy()[order]
    unseen = np.zeros(len(y))
    for k in range(FOLDS):
        rest = f != k
        unseen[~rest] = fit_trees(x[rest], y[rest]).raw(x[~rest]) if rest.any() and (~rest).any() else 0.0
    final = lexicon_of(total[:, 1], total[:, 0], toxic, clean, names)
    return Model(final, fit_trees(x, y), isotonic(unseen, y))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text).

    ``held_out``: crc32 of the id as text is divisible by HOLD_OUT (a null id
    counts as the empty text, which is); such labels are never used. Scores
    depend on the text alone: equal texts score alike, null and empty texts
    get the score of all-zero features. ``labels``: doc_id, toxic (0, 1; rows
    with nulls are ignored). An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts.tolist()))

    return docs.select(
        "doc_id",
        (crc_fold(F.col("doc_id"), HOLD_OUT) == 0).alias("held_out"),
        score(F.col("text").cast("binary")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
