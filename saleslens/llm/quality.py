"""Operator 5, quality classifier by importance resampling.

Two generative models over hashed word n-grams, one of the target text (rows
labelled good) and one of the raw text (all rows), give every document an
importance weight: the log ratio of its probabilities. Gumbel noise, a pure
function of the row, is added to the log weight and the k largest keys are
kept, which samples k rows without replacement in proportion to their weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleslens.llm.common import bounded_sample, fresh, release_memory, through_storage

#: Buckets of hashed n-grams (words and word pairs).
BUCKETS = 1 << 14
#: Labelled rows that the target model and the cut are fitted on, at most (chosen by their id hashes).
MAX_LABELLED = 50_000
#: Share of the raw model in the smoothed target model.
PRIOR = 0.2
#: Steps of a key that the selection tells apart, for each unit of log weight.
STEPS = 1 << 20

_TOKENS = re.compile(rb"[a-z0-9_\x80-\xff]+|[^a-z0-9_\x80-\xff\s]+").findall
#: Stands for a word that repeats the one before it.
_AGAIN = crc32(b"<again>")


def ngram_buckets(text: bytes | None) -> np.ndarray:
    """Buckets of the words, punctuation runs and neighbouring pairs of ``text`` (A-Z lower-cased)."""
    tokens = _TOKENS(text.lower()) if text else []
    if not tokens:
        return np.zeros(0, dtype=np.int64)
    h = np.array([crc32(t) for t in tokens], dtype=np.uint64)
    h[1:][h[1:] == h[:-1]] = _AGAIN
    mix = np.uint64(0x9E3779B97F4A7C15)
    grams = np.concatenate((h * mix, (h[:-1] * mix ^ (h[1:] + np.uint64(1))) * mix))
    return (grams >> np.uint64(64 - (BUCKETS - 1).bit_length())).astype(np.int64)


def _labelled(labels: DataFrame) -> DataFrame:
    """doc_id, good, for_cut: a bounded sample of labelled ids; ids with two labels count as bad."""
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg((F.min("quality") > 0).alias("good"))
    )
    return bounded_sample(known, MAX_LABELLED, F.col("doc_id")).select(
        "doc_id", "good", (F.pmod(F.xxhash64("doc_id", F.lit("cut")), F.lit(3)) == 0).alias("for_cut")
    )


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Log ratio of each bucket, and the log weight that best parts good from bad rows.

    The raw model counts every row of ``docs``; the target model counts two
    thirds of the labelled good rows, the cut is set on the other third, bad
    ones included. All rows of one id together count as one document in the
    target model, and equal ones once for the cut, so an id that many rows
    repeat neither outweighs the others nor reaches the driver many times.
    Without labels all ratios are 0 and the cut is minus infinity: nothing is
    rejected.
    """
    known = F.broadcast(through_storage(_labelled(labels), "labelled"))  # at most MAX_LABELLED rows
    sizes = docs.select("doc_id").join(known, "doc_id").groupBy("doc_id", "good", "for_cut").agg(F.count(F.lit(1)).alias("n"))
    sized = F.broadcast(through_storage(sizes, "labelled-sizes"))  # no more rows than before
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(sized, "doc_id", "left")
    share = F.when(F.col("good") & ~F.col("for_cut"), 1.0 / F.col("n")).otherwise(F.lit(0.0))

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, good = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS)
        for part in parts:
            for text, part_of in zip(part["text"], part["share"], strict=True):
                grams = np.bincount(ngram_buckets(text), minlength=BUCKETS) if text else 0
                raw += grams
                if part_of:
                    good += grams * part_of
        at = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": at, "raw": raw[at], "good": good[at]})
        release_memory()

    counts = (
        rows.select("text", F.coalesce(share, F.lit(0.0)).alias("share"))
        .mapInPandas(count, "bucket long, raw long, good double")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
        .toPandas()  # one row for each bucket
    )
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[counts["bucket"]] = counts["raw"]
    good[counts["bucket"]] = counts["good"]
    if not good.sum():
        return np.zeros(BUCKETS), -np.inf
    raw_p = (raw + 0.5) / (raw.sum() + 0.5 * BUCKETS)
    ratio = np.log((1 - PRIOR) * good / good.sum() + PRIOR * raw_p) - np.log(raw_p)

    weighed = through_storage(
        with_log_weight(rows.filter("for_cut").select("doc_id", "text", "good"), ratio, "w").select("doc_id", "w", "good"),
        "cut",
    )
    # equal rows have equal weights; MAX_LABELLED rows at most
    held = bounded_sample(weighed, MAX_LABELLED, F.col("doc_id"), F.col("w")).toPandas()
    return ratio, best_cut(held["w"].to_numpy(), held["good"].to_numpy(dtype=bool))


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The weight from which rows are kept with the fewest errors: the lowest such place, midway between two rows."""
    if not len(good) or good.all():
        return -np.inf
    order = np.argsort(weights, kind="stable")
    weights, good = weights[order], good[order]
    # errors when the first i rows go
    errors = np.concatenate(([0], np.cumsum(good))) + np.concatenate((np.cumsum(~good[::-1])[::-1], [0]))
    places = np.flatnonzero(np.concatenate(([True], weights[1:] > weights[:-1], [True])))
    i = places[errors[places].argmin()]
    if i == 0:
        return -np.inf
    if i == len(weights):
        return float(np.nextafter(weights[-1], np.inf))
    return float((weights[i - 1] + weights[i]) / 2)


def with_log_weight(docs: DataFrame, ratio: np.ndarray, name: str) -> DataFrame:
    """``docs`` with the column ``name``: the log ratio of each text under the two models; 0 without words."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    @F.pandas_udf("double")
    def weigh(texts: pd.Series) -> pd.Series:
        table = shared.value
        found = pd.Series([float(table[ngram_buckets(t)].sum()) if t else 0.0 for t in texts], dtype="float64")
        release_memory()
        return found

    return docs.withColumn(name, weigh(F.col("text").cast("binary")))


def gumbel(*columns: Column) -> Column:
    """Standard Gumbel noise that depends on ``columns`` alone, so a lost task draws the same again."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit("gumbel"), *columns), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def kth_largest(values: DataFrame, name: str, k: int) -> int:
    """The k-th largest of the longs ``values.name`` (1 is the largest), by four passes of counts."""
    chosen, left = None, k
    for shift in (48, 32, 16, 0):
        part = values if chosen is None else values.filter(F.shiftright(name, shift + 16) == chosen)
        counts = part.groupBy(F.shiftright(name, shift).alias("p")).count().collect()  # at most 2^16 rows
        for row in sorted(counts, key=lambda r: -r["p"]):
            if left <= row["count"]:
                chosen = row["p"]
                break
            left -= row["count"]
    return chosen


def _keyed(docs: DataFrame, ratio: np.ndarray, weight: str, key: str) -> DataFrame:
    noise = gumbel(F.col("doc_id"), F.xxhash64("text"))
    return with_log_weight(docs, ratio, weight).withColumn(key, F.floor((F.col(weight) + noise) * STEPS).cast("long"))


def _select(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, DataFrame, int | None]:
    """The ratios, the scored rows (doc_id, log_weight, key) in storage, and the smallest key kept (None: all)."""
    ratio, cut = fit(docs, labels)
    scored = through_storage(
        _keyed(docs.select("doc_id", "text"), ratio, "log_weight", "key").select("doc_id", "log_weight", "key"),
        "weights",
    )
    k = scored.filter(F.col("log_weight") >= cut).count() if np.isfinite(cut) else None
    if k is None:
        return ratio, scored, None
    return ratio, scored, kth_largest(scored, "key", k) if k else 1 << 62


def resample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, log_weight, key, kept for every row of ``docs`` (doc_id, text).

    ``kept``: among the k largest keys, where k is the number of rows whose
    log weight reaches the cut that best parts labelled good from labelled bad
    rows; rows that share the k-th key (repeated rows) are kept together. A
    null or empty text has weight 0; a null id is as good as any; without
    labels, or without bad ones, every row is kept; an empty table gives an
    empty result. ``labels``: doc_id, quality (over 0 is good); other columns
    are not read.
    """
    _, scored, least = _select(docs, labels)
    kept = F.lit(True) if least is None else F.col("key") >= least
    return scored.select("doc_id", "log_weight", (F.col("key") / STEPS).alias("key"), kept.alias("kept"))


def keep_resampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``resample`` keeps, with all their columns.

    Weights are computed again beside the text, which costs a scan and spares
    a shuffle of the texts.
    """
    ratio, _, least = _select(docs, labels)
    if least is None:
        return docs
    weight, key = fresh(docs, "log_weight"), fresh(docs, "sample_key")
    return _keyed(docs, ratio, weight, key).filter(F.col(key) >= least).select(*docs.columns)
