"""Operator 12, phrase collocations from a weighted de Bruijn graph.

An edge is a run of ``size`` words with its count, from the node of its first
``size - 1`` words to that of its last. Only edges are counted: one starts at
every word of a piece, and near the piece's end it is cut short by an end mark,
which makes the pieces' ends edges of their own. The count of a shorter phrase
is the flow out of it: the edges that begin with it, those with an end mark
included. Frequent edges whose node carries one flow in and the same flow out
are put together to paths, and the nodes inside a path take its count.

Tasks count edges over numbered words and send them packed, a block for each
bucket of first two words; all edges of a node meet in one bucket, however
frequent the node is, as distinct edges with their counts.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saleslens.llm.common import LOWER, UPPER, release_memory, through_storage

#: Words in a candidate, its least count, and the share of a longer one's count (in hundredths) that hides it.
MIN_WORDS, MAX_WORDS, MIN_COUNT, HIDDEN_SHARE = 2, 3, 10, 50
#: Phrases reported for each language.
TOP = 2000
#: A piece ends at each of these.
SEPARATORS = ".,;:!?\n\x0b\x0c\r"
NO_LANG = "und"
#: Bytes of text for each bucket of edges; words that a task holds before it passes their edges on.
BUCKET_BYTES, HELD_WORDS = 16_000_000, 2_000_000
#: Bytes of a text that are split at once.
CHUNK = 1_000_000
#: Edges in a path's row; longer paths go on in further rows.
SEGMENT = 256
#: Parts of a language that are ranked before the whole is.
RANK_PARTS = 64
MAX_ROUNDS = 64

_END = b"."
_TABLE = bytes.maketrans(
    (UPPER + SEPARATORS + "\t").encode(), (LOWER + "." * len(SEPARATORS) + " ").encode()
)


# ------------------------------------------------------------------ counting --


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, ends of pieces as _END, some at a time."""
    text = text.translate(_TABLE)
    at = 0
    while at < len(text):
        to = len(text)
        if to - at > CHUNK:
            # a word has neither a space nor an end in it
            to = max(text.rfind(b" ", at, at + CHUNK), text.rfind(_END, at, at + CHUNK)) + 1
            if to <= at:
                found = [p for p in (text.find(b" ", at), text.find(_END, at)) if p >= 0]
                to = min(found) + 1 if found else len(text)
        yield text[at:to].replace(_END, b" . ").split()
        at = to
    yield [_END]


def distinct_rows(columns: list[np.ndarray], n: np.ndarray, ids: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of ``columns`` (numbers below ``ids``) in ascending order, and the sums of ``n``."""
    key, top = columns[0].astype(np.int64), ids
    for column in columns[1:]:
        if top * ids >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            top = len(key)
        key = key * ids + column
        top *= ids
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    return [c[order[first]] for c in columns], np.add.reduceat(n[order], first) if len(key) else n


class _Edges:
    """Edges of one language that a task has met, over words numbered in the task."""

    def __init__(self, size: int):
        self.size = size
        self._start([])

    def _start(self, words: list[bytes]) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.numbers[_END]  # the end is number 0
        self.stream = array("i")
        self.add(words)

    def add(self, words: list[bytes]) -> None:
        self.stream.extend(map(self.numbers.__getitem__, words))

    def take(self, last: bool) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
        """(words, columns, counts) of what is held; all but the last words, which wait for others, unless ``last``."""
        names, ahead = list(self.numbers), self.size - 1
        held = np.frombuffer(self.stream, dtype=np.int32).copy()
        starts = len(held) if last else max(0, len(held) - ahead)
        padded = np.concatenate((held, np.zeros(ahead, np.int32)))
        columns = [padded[:starts]]
        for k in range(1, self.size):
            columns.append(np.where(columns[-1] == 0, 0, padded[k : k + starts]))
        word = columns[0] != 0
        columns = [c[word] for c in columns]
        waiting = [names[i] for i in held[starts:]]
        self._start(waiting)
        columns, counts = distinct_rows(columns, np.ones(len(columns[0]), np.int64), len(names))
        return names, columns, counts


def _pack(columns: list[np.ndarray], counts: np.ndarray, names: list[bytes]) -> tuple[bytes, bytes]:
    """(words, numbers): a block of edges over words of its own."""
    used, own = np.unique(np.concatenate(columns), return_inverse=True)
    table = np.concatenate((own, counts)).astype("<i4").reshape(len(columns) + 1, -1)
    table[0, 1:] -= table[0, :-1].copy()
    planes = np.ascontiguousarray(table.view(np.uint8).reshape(-1, 4).T)
    pack = zstandard.ZstdCompressor(level=1).compress
    return pack(b" ".join([names[i] for i in used])), pack(planes.tobytes())


def _unpack(words: bytes, numbers: bytes, size: int) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
    open_ = zstandard.ZstdDecompressor().decompress
    planes = np.frombuffer(open_(numbers), np.uint8).reshape(4, -1)
    table = np.ascontiguousarray(planes.T).view("<i4").reshape(size + 1, -1)
    columns = [table[0].cumsum(), *table[1:size]]
    return open_(words).split(b" "), columns, table[size].astype(np.int64)


def _blocks(lang: str, edges: _Edges, buckets: int, last: bool) -> Iterator[tuple[int, str, bytes, bytes]]:
    names, columns, counts = edges.take(last)
    if not len(counts):
        return
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in names], dtype=np.uint64)
    seed = np.uint64(xxhash.xxh64_intdigest(lang.encode()))
    place = hashes[columns[0]] * np.uint64(0x9E3779B97F4A7C15) + seed
    if edges.size > 1:
        place = (place ^ hashes[columns[1]]) * np.uint64(0xC2B2AE3D27D4EB4F)
    place = ((place >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    place = place[order]
    cuts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1], [True])))
    for a, b in zip(cuts[:-1], cuts[1:]):
        at = order[a:b]
        yield int(place[a]), lang, *_pack([c[at] for c in columns], counts[at], names)


def _flows(columns: list[np.ndarray], counts: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, flow) of the phrases that sorted distinct edges begin with: all words, longer ones from ``least``."""
    changed = np.zeros(len(counts), bool)
    changed[:1] = True
    for k, column in enumerate(columns, 1):
        changed[1:] |= column[1:] != column[:-1]
        rows = np.flatnonzero(changed)
        flow = np.add.reduceat(counts, rows)
        real = (column[rows] != 0) & ((flow >= least) if k > 1 else True)
        yield k, rows[real], flow[real]


def phrase_counts(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> DataFrame:
    """lang, size, phrase, n: all words of ``docs`` (lang, text), and its phrases of 2 to ``max_words`` words from ``min_count``."""
    rows = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.col("text").cast("binary").alias("text"))
    rows = rows.filter(F.col("text").isNotNull())
    volume = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = 1 + volume // BUCKET_BYTES
    packed = pa.schema([("bucket", pa.int64()), ("lang", pa.string()), ("words", pa.binary()), ("numbers", pa.binary())])

    def batch(blocks: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*blocks), packed)], schema=packed)

    def some(blocks: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for block in blocks:
            held.append(block)
            size += len(block[2]) + len(block[3])
            if size > 4_000_000:
                yield batch(held)
                held, size = [], 0
        if held:
            yield batch(held)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[str, _Edges] = {}
        held = 0
        for part in parts:
            for lang, text in zip(part.column("lang"), part.column("text")):
                name = lang.as_py()
                edges = met.get(name) or met.setdefault(name, _Edges(max_words))
                for words in _words(text.as_buffer().to_pybytes()):
                    edges.add(words)
                    held += len(words)
                    if held >= HELD_WORDS:
                        for name_, edges_ in met.items():
                            yield from some(_blocks(name_, edges_, buckets, False))
                        held = 0
        for name, edges in met.items():
            yield from some(_blocks(name, edges, buckets, True))
        met.clear()
        release_memory()

    found = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])

    def merge(blocks: pa.Table) -> pa.Table:
        out = []
        langs = blocks.column("lang")
        for lang in langs.unique():
            part = blocks.filter(pc.equal(langs, lang))
            numbers: defaultdict[bytes, int] = defaultdict()
            numbers.default_factory = numbers.__len__
            numbers[_END]
            tables, counts = [], []
            for words, packed_numbers in zip(part.column("words"), part.column("numbers")):
                names, columns, n = _unpack(words.as_py(), packed_numbers.as_py(), max_words)
                common = np.fromiter(map(numbers.__getitem__, names), np.int64, len(names))
                tables.append([common[c].astype(np.int32) for c in columns])
                counts.append(n)
            columns = [np.concatenate(c) for c in zip(*tables)]
            columns, n = distinct_rows(columns, np.concatenate(counts), len(numbers))
            names = list(numbers)
            for k, rows, flow in _flows(columns, n, min_count):
                phrases = [b" ".join([names[i] for i in r]) for r in zip(*(c[rows].tolist() for c in columns[:k]))]
                out.append(
                    pa.table(
                        [
                            pa.array([lang.as_py()] * len(rows), pa.string()), pa.array([k] * len(rows), pa.int32()),
                            pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(flow, pa.int64()),
                        ],
                        schema=found,
                    )
                )
        release_memory()
        return pa.concat_tables(out)

    def merge_all(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One bucket after the other, each whole."""
        held: list[pa.RecordBatch] = []
        for part in parts:
            bucket = part.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1), len(bucket)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if held and held[0].column("bucket")[0].as_py() != bucket[a]:
                    yield from merge(pa.Table.from_batches(held)).to_batches()
                    held = []
                held.append(part.slice(a, b - a))
        if held:
            yield from merge(pa.Table.from_batches(held)).to_batches()

    blocks = rows.mapInArrow(count, "bucket long, lang string, words binary, numbers binary")
    # buckets are numbered, so they are dealt out evenly instead of by their hash
    tasks = min(buckets, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = blocks.repartitionById(tasks, F.pmod("bucket", F.lit(tasks)).cast("int")).sortWithinPartitions("bucket")
    merged = dealt.mapInArrow(merge_all, "lang string, size int, phrase string, n long")
    # a word's nodes are in many buckets
    return through_storage(merged.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")), "phrases")


# --------------------------------------------------------------------- paths --


def compact_paths(counts: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """lang, path, n: the frequent edges of ``counts`` (lang, size, phrase, n), unary paths put together.

    A node is inside a path if one edge brings its whole flow and one takes it
    all. Such a path cannot close: its pieces begin somewhere. Paths of more
    than SEGMENT edges go on in further rows, each starting with an edge.
    """
    edges = counts.filter(F.col("size") == max_words).select("lang", "phrase", "n")
    nodes = counts.filter(F.col("size") == max_words - 1).select("lang", F.col("phrase").alias("node"), "n")
    into = edges.select("lang", F.substring_index("phrase", " ", 1 - max_words).alias("node"), "n", F.col("phrase").alias("before"))
    out = edges.select("lang", F.substring_index("phrase", " ", max_words - 1).alias("node"), "n", "phrase")
    # equal counts: no other edge can share the node
    inside = nodes.join(into, ["lang", "node", "n"]).join(out, ["lang", "node", "n"])
    known = through_storage(
        inside.select("lang", "phrase", F.col("before").alias("head"), F.lit(1).cast("long").alias("steps")), "inside"
    )
    for _ in range(MAX_ROUNDS):
        ahead = known.select("lang", F.col("phrase").alias("head"), F.col("head").alias("next"), F.col("steps").alias("more"))
        moved = through_storage(
            known.join(ahead, ["lang", "head"], "left").select(
                "lang", "phrase", F.coalesce("next", "head").alias("head"),
                (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("moved"),
            ),
            "paths",
        )
        known = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            break
    placed = edges.join(known, ["lang", "phrase"], "left").select(
        "lang", F.coalesce("head", "phrase").alias("head"), F.coalesce("steps", F.lit(0)).alias("steps"), "phrase", "n"
    )
    rows = placed.groupBy("lang", "head", F.floor(F.col("steps") / SEGMENT).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("steps", "phrase"))).alias("edges"), F.max("n").alias("n")
    )
    later = F.transform(F.slice("edges", F.lit(2), F.size("edges")), lambda e: F.substring_index(e["phrase"], " ", -1))
    return rows.select("lang", F.array_join(F.concat(F.array(F.get("edges", F.lit(0))["phrase"]), later), " ").alias("path"), "n")


def path_counts(counts: DataFrame, paths: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """lang, size, phrase, n of all phrases: those of ``paths``, the nodes between paths, and shorter ones."""
    words = paths.select("lang", F.split("path", " ").alias("w"), "n")

    def runs(size: int, first: int) -> DataFrame:
        # edges: from the first word on; nodes inside: between the first and the last edge
        last = F.size("w") - max_words + 1
        at = F.sequence(F.lit(first), last) if first == 1 else F.filter(F.sequence(F.lit(1), last), lambda i: i > 1)
        phrases = F.transform(at, lambda i: F.array_join(F.slice("w", i, F.lit(size)), " "))
        return words.select("lang", F.lit(size).alias("size"), F.explode(phrases).alias("phrase"), "n")

    edges, inner = runs(max_words, 1), runs(max_words - 1, 2)
    between = counts.filter(F.col("size") == max_words - 1).join(inner.select("lang", "phrase"), ["lang", "phrase"], "left_anti")
    shorter = counts.filter(F.col("size") < max_words - 1)
    columns = ["lang", "size", "phrase", "n"]
    return edges.unionAll(inner).unionAll(between.select(*columns)).unionAll(shorter.select(*columns))


# ------------------------------------------------------------------- phrases --


def score_phrases(
    counts: DataFrame, max_words: int, min_count: int, hidden_share: int, min_words: int = MIN_WORDS
) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates in ``counts`` (lang, size, phrase, n) that no longer one hides."""
    frequent = counts.filter(F.col("n") >= min_count)
    candidates = frequent.filter(F.col("size") >= min_words)
    inside = F.flatten(
        F.transform(
            F.filter(F.sequence(F.lit(min_words), F.lit(max(min_words, max_words - 1))), lambda s: s < F.col("size")),
            lambda s: F.transform(
                F.sequence(F.lit(1), F.col("size") - s + 1), lambda i: F.array_join(F.slice(F.split("phrase", " "), i, s), " ")
            ),
        )
    )
    longer = (
        candidates.filter(F.col("size") > min_words)
        .select("lang", F.explode(inside).alias("phrase"), "n")
        .groupBy("lang", "phrase")
        .agg(F.max("n").alias("longer"))
    )
    shown = (
        candidates.join(longer, ["lang", "phrase"], "left")
        .filter(F.col("longer").isNull() | (F.col("longer").cast("decimal(28,0)") * 100 < F.col("n").cast("decimal(28,0)") * hidden_share))
        .select("lang", "phrase", "size", F.col("n").alias("a"))
    )
    cuts = (
        shown.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
        .withColumn("left", F.call_function("substring_index", F.col("phrase"), F.lit(" "), F.col("k")))
        .withColumn("right", F.call_function("substring_index", F.col("phrase"), F.lit(" "), F.col("k") - F.col("size")))
    )
    known = frequent.filter(F.col("size") < max_words)
    cut = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(
        known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"]
    )
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    scored = (
        cut.withColumn("top", (wide("a") * wide("a")).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)"))
        .withColumn("below", (wide("l") * wide("r")).cast("decimal(38,0)"))
        .withColumn("score", F.expr("top div below"))
    )
    return (
        scored.groupBy("lang", "phrase")
        .agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("best"))
        .select("lang", "phrase", "best.a", "best.l", "best.r", "best.score")
    )


def collocations(
    docs: DataFrame,
    max_words: int = MAX_WORDS,
    min_count: int = MIN_COUNT,
    hidden_share: int = HIDDEN_SHARE,
    top: int = TOP,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language of ``docs`` (lang, text).

    Texts have A-Z lower-cased and are cut to pieces at SEPARATORS, pieces to
    words at spaces and tabs. Candidates are phrases of ``min_words`` to
    ``max_words`` words with ``min_count`` occurrences within pieces, overlaps
    included. A cut into l and r scores floor(1000000 a a / (l r)), the lowest
    cut counts (ties: the first); a candidate inside a longer one with
    ``hidden_share`` hundredths of its count is left out. Ordered by score, a
    (both descending) and phrase. A null text is empty, a null lang is ``und``,
    repeated rows count as often as they occur; pieces of any length are
    counted whole; an empty table gives an empty result; other columns are not
    read.
    """
    if not 2 <= min_words <= max_words:
        raise ValueError("phrases have two words at least")
    counted = phrase_counts(docs, max_words, min_count)
    paths = through_storage(compact_paths(counted, max_words), "unitigs")
    counts = path_counts(counted, paths, max_words)
    best = score_phrases(counts, max_words, min_count, hidden_share, min_words)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).orderBy(*order)
    some = best.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top).drop("rank")
    # RANK_PARTS * top rows of a language at most are left
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    totals = counted.filter(F.col("size") == 1).groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
