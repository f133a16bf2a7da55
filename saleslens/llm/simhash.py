"""Operator 7, SimHash near-duplicates.

Fingerprints of word shingles, then a self-join of the fingerprints' binary
trie: pairs of nodes go down together, add up differing bits and are dropped
when they differ in more than the budget allows.

The trie is distributed by the pigeonhole rule: of ``distance + 1`` blocks of
bits, two fingerprints within the distance agree in one. Each fingerprint
goes, once for each block, to the subtrie under that block's value, where the
other bits are walked. A subtrie that would be too large for a task is dealt
out again by blocks of its remaining bits. Equal fingerprints meet once,
before anything is linked, and a subtrie gives back only the links that hold
its groups together: never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saleslens.llm.common import fresh, release_memory, through_storage
from saleslens.llm.components import components

BITS = 64
#: Words in a shingle, and the most bits in which linked fingerprints differ.
SHINGLE, DISTANCE = 3, 3
#: Fingerprints under one node beyond which it is dealt out again by further bits.
HOT_NODE = 20_000
#: Free bits at which nodes are not dealt again: their fingerprints agree in all the others.
LAST_BITS = 27
#: Fingerprints that a task walks at a time.
TASK_ROWS = 500_000
#: Node pairs walked at a time; bounds the memory of a walk.
FRONTIER = 1 << 17


# ------------------------------------------------------------ fingerprints --


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of UTF-8 ``text``: words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.

    Shingles count as often as they occur; fewer words than a shingle form
    one; no words give zero. A bit is 1 if set in over half the hashes.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    digest = xxhash.xxh64_intdigest
    parts = [words[i:] for i in range(shingle)]
    votes, total = np.zeros(BITS, dtype=np.int64), len(words) - shingle + 1
    hashes = np.array([digest(b" ".join(s), 42) for s in zip(*parts)], dtype=np.uint64)
    for at in range(0, total, 4096):
        octets = hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > total, bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, name: str, shingle: int = SHINGLE, text: str = "text") -> DataFrame:
    """``docs`` with the column ``name``: the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        found = pd.Series([fingerprint(t, shingle) for t in texts], dtype=np.uint64).astype(np.int64)
        release_memory()
        return found

    return docs.withColumn(name, of(F.col(text).cast("binary")))


# ---------------------------------------------------------------- trie walk --


class _Sets:
    """Union-find over positions, with vectorised linking."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        p = self.parent
        while True:
            q = p[p]
            if np.array_equal(p, q):
                self.parent = p
                return p
            p = q

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            roots = self.roots()
            a, b = roots[a], roots[b]
            low, high = np.minimum(a, b), np.maximum(a, b)
            open_ = low != high
            a, b = low[open_], high[open_]
            if len(a):
                np.minimum.at(self.parent, b, a)


def walk(subtrie: np.ndarray, keys: np.ndarray, distance: int, width: int = BITS) -> np.ndarray:
    """For each fingerprint the position of the first one that it is linked with, over chains.

    ``subtrie`` numbers the node under which a fingerprint hangs and ``keys``
    (uint64) are the fingerprints; they are sorted by (subtrie, key) and
    distinct. Pairs of nodes are walked from the roots down, both branches of
    each at every bit; ``distance`` is the budget of differing bits. Pairs
    whose leaves are all in one group already need no more walking, so a
    dense group costs little more than its spanning links.
    """
    n = len(keys)
    sets = _Sets(n)
    if n < 2:
        return sets.roots()
    starts = np.flatnonzero(np.concatenate(([True], subtrie[1:] != subtrie[:-1])))
    ends = np.append(starts[1:], n)
    many = ends - starts > 1
    root = np.stack((starts[many], ends[many]), axis=1)
    for budget in sorted({min(1, distance), distance}):  # near links first: they spare the far ones
        _walk(root, keys, budget, width, sets)
    return sets.roots()


def _walk(root: np.ndarray, keys: np.ndarray, budget: int, width: int, sets: _Sets) -> None:
    # A frontier: first node [a0, a1), second [b0, b1), differing bits so far; the same node twice is a pair.
    todo = [(width - 1, np.concatenate((root, root, np.zeros((len(root), 1), dtype=root.dtype)), axis=1))]
    while todo:
        bit, pairs = todo.pop()
        if len(pairs) > FRONTIER:
            todo += [(bit, pairs[at : at + FRONTIER]) for at in range(0, len(pairs), FRONTIER)]
            continue
        # leaves of one group: nothing new below
        roots = sets.roots()
        steps = np.concatenate(([0], np.cumsum(roots[1:] != roots[:-1])))
        a0, a1, b0, b1, spent = pairs.T
        settled = (steps[a0] == steps[a1 - 1]) & (steps[b0] == steps[b1 - 1]) & (roots[a0] == roots[b0])
        pairs = pairs[~settled]
        if not len(pairs):
            continue
        if bit < 0:
            sets.link(pairs[:, 0], pairs[:, 2])
            continue
        a0, a1, b0, b1, spent = pairs.T
        ones = np.concatenate(([0], np.cumsum((keys >> np.uint64(bit)) & np.uint64(1)))).astype(np.int64)
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])  # where the branch of ones begins
        same = a0 == b0
        children = [
            np.stack((a0, am, b0, bm, spent), axis=1),
            np.stack((am, a1, bm, b1, spent), axis=1),
            np.stack((a0, am, bm, b1, spent + 1), axis=1),
            np.stack((am, a1, b0, bm, spent + 1), axis=1)[~same],
        ]
        below = np.concatenate(children)
        alone = (below[:, 0] == below[:, 2]) & (below[:, 1] - below[:, 0] < 2)
        keep = (below[:, 0] < below[:, 1]) & (below[:, 2] < below[:, 3]) & (below[:, 4] <= budget) & ~alone
        if keep.any():
            todo.append((bit - 1, below[keep]))


# -------------------------------------------------------------- distribution --


def _blocks(free: int, distance: int) -> list[int]:
    """Masks that split the bits of ``free`` (a mask) into ``distance + 1`` blocks."""
    bits = [b for b in range(BITS) if free >> b & 1]
    cuts = np.linspace(0, len(bits), distance + 2).round().astype(int)
    return [sum(1 << b for b in bits[i:j]) for i, j in zip(cuts, cuts[1:]) if j > i]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _whole_nodes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tables of whole nodes, TASK_ROWS rows or one node each, from rows sorted by node."""
    held, rows = [], 0
    for part in parts:
        held.append(part)
        rows += len(part)
        if rows < TASK_ROWS:
            continue
        table = pd.concat(held, ignore_index=True)
        last = table.iloc[-1]
        open_ = (table["mask"] == last["mask"]) & (table["value"] == last["value"])
        if not open_.all():
            yield table[~open_]
        held = [table[open_]]
        rows = len(held[0]) if not open_.all() else 0
    table = pd.concat(held, ignore_index=True) if held else None
    if table is not None and len(table):
        yield table


def near_links(prints: DataFrame, distance: int = DISTANCE, hot_node: int = HOT_NODE) -> DataFrame:
    """Links (a, b) that join all of ``prints.fp`` (distinct longs) within ``distance`` bits.

    Every pair within the distance is joined by a chain of links, and no link
    joins two that no chain of such pairs joins. Each fingerprint has at most
    one link for every node that it hangs under.
    """
    schema = "a long, b long"

    def join(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in _whole_nodes(parts):
            group = table.groupby(["mask", "value"], sort=False).ngroup().to_numpy()
            keys = table["fp"].to_numpy().view(np.uint64)
            order = np.lexsort((keys, group))
            group, keys = group[order], keys[order]
            root = walk(group, keys, distance)
            moved = np.flatnonzero(root != np.arange(len(root)))
            yield pd.DataFrame({"a": keys[moved].view(np.int64), "b": keys[root[moved]].view(np.int64)})

    # One level deals by blocks of the free bits; nodes that stay too large are dealt again.
    level = prints.select("fp", F.lit(0).cast("long").alias("mask"), F.lit(0).cast("long").alias("value"))
    fixed, links = [0], None
    while True:
        splits = [(f, b) for f in fixed for b in _blocks(~f & ((1 << BITS) - 1), distance)]
        last = min(bin(~(f | b) & ((1 << BITS) - 1)).count("1") for f, b in splits) <= LAST_BITS
        options = F.array(
            *[F.struct(F.lit(_signed(f)).alias("was"), F.lit(_signed(f | b)).alias("now")) for f, b in splits]
        )
        placed = (
            level.withColumn("to", F.explode(F.filter(options, lambda o: o["was"] == F.col("mask"))))
            .select("fp", F.col("to.now").alias("mask"), F.col("fp").bitwiseAND(F.col("to.now")).alias("value"))
        )
        # A node is found by its size; those too large go down another level.
        sizes = placed.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n"))
        hot = through_storage(sizes.filter((F.col("n") > hot_node) & F.lit(not last)).select("mask", "value"), "hot")
        some_hot = not hot.isEmpty()
        # Nodes above the bound are at most count / bound of them, far fewer than rows.
        cool = placed.join(hot, ["mask", "value"], "left_anti") if some_hot else placed
        parts = cool.repartition("mask", "value").sortWithinPartitions("mask", "value").mapInPandas(join, schema)
        links = parts if links is None else links.unionAll(parts)
        if not some_hot:
            return links
        level = through_storage(placed.join(hot, ["mask", "value"], "left_semi"), "level")
        fixed = [f | b for f, b in splits]


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, keep: tuple[str, ...] = (), root: str | None = None
) -> DataFrame:
    """doc_id, the columns of ``keep``, fingerprint (16 hex digits) and component_id for every row.

    With ``root`` a column of that name tells components apart by a
    fingerprint, also those that share an id (repeated ids of different texts).

    Fingerprints link at ``distance`` or fewer differing bits; component_id is
    the smallest doc_id that links reach, over chains. A null or empty text,
    or one of white space, has fingerprint zero and is linked like any other.
    A null doc_id is never the smallest: a component of none but null ids has
    a null component_id. Repeated rows are rows of their own; an empty table
    gives an empty result; columns that are not named are not read.
    """
    cols = ["doc_id", *[c for c in keep if c != "doc_id"]]
    name = fresh(docs.select(*cols), "fp")
    rows = through_storage(
        with_fingerprints(docs.select(*cols, F.col("text").alias(f"{name}_text")), name, shingle, f"{name}_text").drop(
            f"{name}_text"
        ),
        "fingerprints",
    )
    prints = through_storage(rows.groupBy(F.col(name).alias("fp")).agg(F.min("doc_id").alias("least")), "prints")
    roots = components(near_links(prints, distance))
    # fingerprints without a link are their own root
    rooted = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    rooted = through_storage(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    own = [F.col("root").alias(root)] if root else []
    members = rooted.join(least, "root").select(F.col("fp").alias(name), "component_id", *own)
    return rows.join(members, name).select(
        *cols, F.lpad(F.lower(F.hex(name)), 16, "0").alias("fingerprint"), "component_id", *([root] if root else [])
    )


def keep_one(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id.

    Of rows with that id (repeated ids) the one whose content hashes lowest
    stays, once; a component of none but null ids keeps one of them.
    """
    mark = fresh(docs, "row_hash")
    hashed = docs.withColumn(mark, F.xxhash64(*[F.col(c) for c in docs.columns]))
    root = fresh(hashed, "component_root")
    groups = near_duplicates(hashed, shingle, distance, keep=(mark,), root=root)
    # components by their root: an id that different texts share may name several
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(mark).alias("mark")))
    kept = groups.groupBy(root).agg(first.alias("first")).select(
        F.col("first.doc_id").alias("chosen_id"), F.col("first.mark").alias("chosen")
    )
    return (
        hashed.join(kept, F.col("doc_id").eqNullSafe(F.col("chosen_id")) & (F.col(mark) == F.col("chosen")), "left_semi")
        .dropDuplicates(["doc_id", mark])
        .select(*docs.columns)
    )
