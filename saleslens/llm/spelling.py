"""Operator 13, spelling variants by a dictionary of trie-node pairs.

Every prefix of a word is a node of the forward trie, every suffix one of the
reversed trie, and nodes have integer numbers. A word with a position skipped
is the pair (node of what stands before, node of what follows); a word with a
gap at a position is such a pair too. Two words differ by one replaced code
point exactly if they share a skipped pair, and by one inserted code point
exactly if a skipped pair of the longer equals a gapped pair of the shorter.
So near words meet in an equality join of integers, with nothing to verify.

A word's position in the sorted vocabulary names it, so that ties are settled
by integers too. Tries are numbered range by range of the sorted words; the
nodes that a range shares with the one before are looked up in a table with
one row for each range.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saleslens.llm.common import ascii_lower, through_storage

#: Runs of these are words.
LETTERS = "A-Za-zÀ-ÿ"
#: One in so many (document, run) pairs loses a code point.
DAMAGE = 97
MIN_LENGTH, MIN_COUNT = 5, 3
#: A form occurs so many times as often as its variant.
RATIO = 2
#: Bits of a node's or word's number inside its range.
LOCAL_BITS = 40
#: Rounds of pointer jumping; counts double along a chain of forms, so 64 links are the most there can be.
MAX_ROUNDS = 7

_SKIP, _GAP = 0, 1


def damaged_runs(docs: DataFrame, damage: int = DAMAGE) -> DataFrame:
    """word for every run of letters of ``docs`` (doc_id, text): A-Z lower-cased, one in ``damage`` less a code point.

    The crc32 of ``<doc_id>:<run>`` decides which runs are damaged and where.
    A null text has no runs; a null id counts as the empty text.
    """
    runs = docs.select(
        F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("mark"),
        F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(f"[{LETTERS}]++"), F.lit(0))).alias("run"),
    ).withColumn("h", F.crc32(F.concat("mark", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return runs.select(F.when(F.col("h") % damage == 0, shorter).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n for the words of at least ``min_length`` code points and ``min_count`` occurrences."""
    return (
        words.filter(F.length("word") >= min_length)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_count)
    )


# --------------------------------------------------------------------- tries --


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _scan(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(part, place, nodes, starts) of the sorted strings of one range, with ``rows``' own values.

    ``nodes[d]`` numbers the prefix of length d; ``starts[i]`` tells whether a
    run of equal code points starts at i. The first string's nodes are 0, 1, ...
    """
    context = TaskContext.get()
    base = (context.partitionId() if context else 0) << LOCAL_BITS
    path, before, unused = [base], "", base + 1
    for place, (text, *rest) in enumerate(rows):
        k = _common(before, text)
        del path[k + 1 :]
        path.extend(range(unused, unused + len(text) - k))
        unused += len(text) - k
        before = text
        yield (base + place, text, list(path), [x != y for x, y in zip(text, "\0" + text)], *rest)


def _numbered(strings: DataFrame, extra: str, label: str) -> DataFrame:
    """place, text, nodes, starts, ``extra`` for the distinct ``strings`` (text, extra), trie nodes numbered.

    ``place`` ascends with the text in code-point order. Strings are sorted in
    ranges; a node that starts in an earlier range takes that range's number.
    """
    spark = strings.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = pa.schema(
        [("place", pa.int64()), ("text", pa.string()), ("nodes", pa.list_(pa.int64())), ("starts", pa.list_(pa.bool_())), (extra, pa.int64())]
    )

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in parts for r in zip(b.column("text").to_pylist(), b.column(extra).to_pylist()))
        held, size = [], 0
        for row in _scan(rows):
            held.append(row)
            size += len(row[1])
            if size > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    placed = through_storage(
        strings.select("text", extra)
        .repartitionByRange(ranges, "text")
        .sortWithinPartitions("text")
        .mapInArrow(scan, f"place long, text string, nodes array<long>, starts array<boolean>, {extra} long"),
        label,
    )
    part = F.shiftrightunsigned("place", LOCAL_BITS)
    edges = (
        placed.groupBy(part.alias("part"))
        .agg(
            F.min_by("text", "place").alias("first"),
            F.max_by(F.struct("text", "nodes"), "place").alias("last"),
        )
        .collect()  # one row for each range
    )
    shared, before, carried = [], None, []
    for edge in sorted(edges, key=lambda e: e.part):
        depth = -1 if before is None else _common(before, edge.first)
        # the nodes of depth 0..depth of the first string are those of the last string before it
        held = carried[: depth + 1]
        shared.append((edge.part, held))
        base = edge.part << LOCAL_BITS
        carried = [held[x - base] if x - base <= depth else x for x in edge.last.nodes]
        before = edge.last.text
    table = spark.createDataFrame(shared, "part long, held array<long>")
    low = F.lit((1 << LOCAL_BITS) - 1)
    nodes = F.transform(
        "nodes",
        lambda x: F.when(x.bitwiseAND(low) < F.size("held"), F.get("held", x.bitwiseAND(low).cast("int"))).otherwise(x),
    )
    joined = placed.withColumn("part", part).join(F.broadcast(table), "part")  # one row for each range
    return joined.select("place", "text", nodes.alias("nodes"), "starts", extra)


# --------------------------------------------------------------------- pairs --


def _pairs(words: DataFrame) -> DataFrame:
    """place, n, kind, p, s, opens: the skipped and gapped pairs of ``words`` (place, n, fwd, rev, starts)."""
    length = F.size("starts")

    def pair(kind: int, i: Column, after: Column, opens: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), F.get("fwd", i).alias("p"), F.get("rev", after).alias("s"), opens.alias("opens")
        )

    skipped = F.transform("starts", lambda opens, i: pair(_SKIP, i, length - 1 - i, opens))
    gapped = F.transform("fwd", lambda _, i: pair(_GAP, i, length - i, F.lit(False)))
    return words.select("place", "n", F.explode(F.concat(skipped, gapped)).alias("x")).select("place", "n", "x.*")


def near_counts(words: DataFrame) -> DataFrame:
    """place, n_near, best for every word of ``words`` (place, n, fwd, rev, starts) that has near words.

    ``best`` is (-n, place) of the near word of largest n, the smallest place
    among equals. A pair (p, s) has as many skipped words as there are code
    points to put between, and one gapped word at most; no pairs of words are
    written out. Of equal neighbouring code points only the first one counts as
    the inserted one, so each pair of words meets once.
    """
    whole = Window.partitionBy("p", "s")
    ordered = whole.orderBy("kind", "rank")
    skip, gap = F.col("kind") == _SKIP, F.col("kind") == _GAP
    inserted = skip & F.col("opens")
    seen = (
        _pairs(words)
        .withColumn("rank", F.struct((-F.col("n")).alias("negated"), F.col("place").alias("place")))
        # one word of a group is often all there is
        .withColumn("rows", F.count(F.lit(1)).over(whole))
        .withColumn("skips", F.count(F.when(skip, 1)).over(whole))
        .withColumn("gaps", F.count(F.when(gap, 1)).over(whole))
        .withColumn("longer", F.count(F.when(inserted, 1)).over(whole))
        .withColumn("gap_best", F.min(F.when(gap, F.col("rank"))).over(whole))
        .withColumn("longer_best", F.min(F.when(inserted, F.col("rank"))).over(whole))
        .withColumn("turn", F.row_number().over(ordered))
        .withColumn("first", F.first("rank").over(ordered))
        .withColumn("second", F.lead("rank").over(ordered))
        .filter("rows > 1")
    )
    replaced = F.when(skip, F.col("skips") - 1).otherwise(0)
    shorter = F.when(inserted, F.col("gaps")).otherwise(0)
    longer = F.when(gap, F.col("longer")).otherwise(0)
    other = F.when(skip & (F.col("skips") > 1), F.when(F.col("turn") == 1, F.col("second")).otherwise(F.col("first")))
    return (
        seen.select(
            "place",
            (replaced + shorter + longer).alias("near"),
            F.least(other, F.when(inserted, F.col("gap_best")), F.when(gap, F.col("longer_best"))).alias("best"),
        )
        .filter("near > 0")
        .groupBy("place")
        .agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    )


def _roots(forms: DataFrame) -> DataFrame:
    """place, root: the last word that forms lead to, by pointer jumping over ``forms`` (place, form)."""
    known = through_storage(forms.select("place", F.col("form").alias("root")), "forms")
    for _ in range(MAX_ROUNDS):
        ahead = known.select(F.col("place").alias("root"), F.col("root").alias("next"))
        moved = known.join(ahead, "root", "left").select(
            "place", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        moved = through_storage(moved, "roots")
        known = moved.select("place", "root")
        if moved.filter("moved").isEmpty():
            return known
    return known


def group_words(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of ``counts`` (word, n), whose words are distinct."""
    forward = _numbered(counts.select(F.col("word").alias("text"), "n"), "n", "forward")
    forward = through_storage(forward, "vocabulary")
    backward = _numbered(
        forward.select(F.reverse("text").alias("text"), F.col("place").alias("of")), "of", "backward"
    ).select(F.col("of").alias("place"), F.col("nodes").alias("rev"))
    words = forward.select("place", "n", F.col("nodes").alias("fwd"), "starts").join(backward, "place")
    near = through_storage(near_counts(words), "near")
    texts = forward.select("place", F.col("text").alias("word"), "n")
    best = F.when(-F.col("best.negated") >= ratio * F.col("n"), F.col("best"))
    chosen = through_storage(
        texts.join(near, "place", "left").select(
            "place", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            best["place"].alias("form"), (-best["negated"]).alias("form_n"),
        ),
        "chosen",
    )
    roots = _roots(chosen.filter("form is not null"))
    named = chosen.select(F.col("place").alias("at"), F.col("word").alias("named"))
    return (
        chosen.join(roots, "place", "left")
        .join(named.select(F.col("at").alias("form"), F.col("named").alias("form_word")), "form", "left")
        .join(named.select(F.col("at").alias("root"), F.col("named").alias("root_word")), "root", "left")
        .select(
            "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n"
        )
    )


def spelling_variants(
    docs: DataFrame,
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    ratio: int = RATIO,
    damage: int = DAMAGE,
) -> DataFrame:
    """word, form, root, n, n_near, form_n for every frequent word of ``docs`` (doc_id, text).

    Words are the runs of letters with A-Z lower-cased, some with a code point
    taken out (``damaged_runs``); those of ``min_length`` code points and
    ``min_count`` occurrences over all rows stay. Near words differ by one
    inserted, deleted or replaced code point. ``form`` is the near word of
    largest n (ties: the smallest in code-point order) if that is at least
    ``ratio`` times n, else null; ``root`` the last word that forms lead to,
    the word itself if it has none. A null or empty text has no words, a null
    doc_id counts as the empty text, repeated rows count as often as they
    occur, words may be of any length, an empty table gives an empty result,
    and other columns are not read.
    """
    if ratio < 2:
        raise ValueError("forms must be at least twice as frequent, or chains may not end")
    counts = vocabulary(damaged_runs(docs.select("doc_id", "text"), damage), min_length, min_count)
    return group_words(counts, ratio)
