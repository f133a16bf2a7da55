"""Operator 4, benchmark decontamination.

Normalised windows of the benchmark's words form a hash set that is broadcast
in blocks of proven size; every document's token windows are scanned against
it and hits are verified word for word. A benchmark beyond one block is
scanned block by block, so the result does not depend on its size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleslens.llm.common import through_storage

#: Words in a window.
WINDOW = 10
#: Bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 32_000_000

#: Bytes of words: digits, lower-case letters and everything beyond ASCII; A-Z are lower-cased, the rest separate.
WORD_BYTES = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text; null has none."""
    return text.translate(WORD_BYTES).split() if text else []


class Windows:
    """The hash set of one block: windows of word numbers, and the items that hold them."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.sets: dict[int, dict[bytes, set]] = {}
        for item_id, text in items:
            ids = np.array(
                [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], dtype=np.int32
            )
            if not len(ids):
                continue
            size = min(window, len(ids))
            table = self.sets.setdefault(size, {})
            for at in range(len(ids) - size + 1):
                table.setdefault(ids[at : at + size].tobytes(), set()).add(item_id)

    def scan(self, tokens: list[bytes]) -> tuple[np.ndarray, set]:
        """A flag for each token inside an occurrence of a window; the items that occur."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in tokens], dtype=np.int32)
        hit, found = np.zeros(len(ids) + 1, dtype=np.int32), set()
        known = np.concatenate(([0], np.cumsum(ids != 0)))
        for size, table in self.sets.items():
            if len(ids) < size:
                continue
            for at in np.flatnonzero(known[size:] - known[:-size] == size):  # every word is the benchmark's
                owners = table.get(ids[at : at + size].tobytes())  # compares the words, not a hash alone
                if owners is not None:
                    found |= owners
                    hit[at] += 1
                    hit[at + size] -= 1
        return np.cumsum(hit[:-1]) > 0, found


_loaded: list[tuple[object, int, Windows]] = []


def _windows(items: list[tuple], window: int) -> Windows:
    """The block's hash set, built once in each Python worker (a broadcast value is one object there)."""
    if not (_loaded and _loaded[0][0] is items and _loaded[0][1] == window):
        _loaded[:] = [(items, window, Windows(items, window))]
    return _loaded[0][2]


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """The benchmark's items in lists of about ``block_bytes``; the driver holds one at a time."""
    items = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    for k in range(count):
        yield [(r.item_id, r.text.encode()) for r in items.filter(part == k).toLocalIterator()]


def scan_documents(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``docs`` (any columns, among them ``text``) with the benchmark's traces in each row.

    Adds n_words (int), hits (array of [first, end) word numbers of maximal
    runs inside occurrences of a window) and items (distinct item ids, as
    strings, in order). Names that clash with these are replaced.

    A window is ``window`` consecutive words of an item, or the whole item if
    it has fewer. Null or empty texts have no words; items without words have
    no window; items with a null id mark words but are not named; equal items,
    repeated ids and repeated documents are all fine, and either table may be
    empty. Every text is scanned whole.
    """
    out = docs.select(
        *[c for c in docs.columns if c.lower() not in ("n_words", "hits", "items")],
        F.lit(0).alias("n_words"),
        F.expr("cast(array() as array<struct<first:int,end:int>>)").alias("hits"),
        F.expr("cast(array() as array<string>)").alias("items"),
    )
    sc = docs.sparkSession.sparkContext
    for k, items in enumerate(_blocks(benchmark, block_bytes)):
        if k:
            out = through_storage(out, "decontamination")  # one block in memory at a time
        shared = sc.broadcast(items)
        schema = out.schema

        def scan(parts: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            found = _windows(shared.value, window)
            for part in parts:
                for at in range(0, len(part), 1000):
                    yield _scanned(part.iloc[at : at + 1000].copy(), found)

        out = out.mapInPandas(scan, schema)
    return out


def _scanned(part: pd.DataFrame, windows: Windows) -> pd.DataFrame:
    counts, spans, names = [], [], []
    for text, before, named in zip(part["text"], part["hits"], part["items"], strict=True):
        tokens = words(text.encode() if text is not None else None)
        hit, found = windows.scan(tokens)
        for r in before:
            hit[r["first"] : r["end"]] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
        counts.append(len(tokens))
        spans.append([{"first": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
        names.append(sorted({x for x in found if x is not None} | set(named)))
    return part.assign(n_words=np.array(counts, dtype=np.int32), hits=spans, items=names)


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = scan_documents(docs.select("doc_id", "text"), benchmark, **options)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["first"])
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def without_spans(text: str, runs: list) -> str:
    """``text`` without the words of ``runs`` ([first, end) word numbers) and what stands between them."""
    raw = text.encode()
    flat = raw.translate(WORD_BYTES)
    starts, at = [], 0
    for w in flat.split():
        at = flat.index(w, at)
        starts.append((at, at + len(w)))
        at += len(w)
    kept, at = [], 0
    for r in runs:
        kept.append(raw[at : starts[r["first"]][0]])
        at = starts[r["end"] - 1][1]
    return b"\n".join([*kept, raw[at:]]).decode()


def remove_contamination(docs: DataFrame, benchmark: DataFrame, mode: str = "spans", **options) -> DataFrame:
    """``docs`` without the benchmark's passages; the columns stay as they are.

    ``mode`` "spans" cuts each maximal run of hit words (a line break takes its
    place) and leaves all other documents untouched; "documents" removes every
    document with a hit. A column n_chars, if there is one, is counted anew for
    changed texts.
    """
    if mode not in ("spans", "documents"):
        raise ValueError("mode is spans or documents")
    found = scan_documents(docs, benchmark, **options)
    if mode == "documents":
        return found.filter(F.size("hits") == 0).select(*docs.columns)

    @F.pandas_udf("string")
    def cut(text: pd.Series, hits: pd.Series) -> pd.Series:
        return pd.Series(
            [without_spans(t, h) if len(h) else t for t, h in zip(text, hits, strict=True)], dtype=object
        )

    changed = F.size("hits") > 0
    out = found.withColumn("text", F.when(changed, cut(F.when(changed, F.col("text")), "hits")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn(
            "n_chars",
            F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")),
        )
    return out.select(*docs.columns)
