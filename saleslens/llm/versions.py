"""Operator 8, document fingerprints by invertible Bloom lookup sketches.

A paragraph (a line, or a run of at most UNIT_WORDS words of it) has a 40-bit
digest with 24 check bits. A sketch deals the digests of a text into shards of
24 cells, each digest into one cell of each of three rows of eight; a cell
holds a count and the XOR of its digests. Sketches of two versions subtract
cell by cell, what they share cancels, and peeling the cells that hold one
digest recovers the differing ones. The shards of a pair that do not peel are
tried again, each as four.

Everything runs as DataFrame expressions in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleslens.llm.common import through_storage

UNIT_WORDS = 16
#: Digests for each shard of a fingerprint. A pair is first tried at the size of its larger one.
SHARD_LOAD = 6
CELLS, ROW = 24, 8
MAX_SHARD_BITS = 20
#: Rounds of peeling in a shard, and tries with more shards.
ROUNDS, TRIES = 8, 3
#: Order of a document without an id: after all others.
LAST = (1 << 63) - 1

_UNIT = rf"\S++(?:[^\S\n]++\S++){{0,{UNIT_WORDS - 1}}}+"
_LOW = (1 << 40) - 1


def _marked(digest: Column) -> Column:
    """The low 40 bits of a hash, with their check in the high 24."""
    low = digest.bitwiseAND(F.lit(_LOW))
    return low.bitwiseOR(F.shiftleft(F.xxhash64(low).bitwiseAND(F.lit((1 << 24) - 1)), 40))


def _is_marked(x: Column) -> Column:
    return _marked(x) == x


def digests(text: Column) -> Column:
    """The distinct paragraph digests of a text."""
    units = F.regexp_extract_all(text, F.lit(_UNIT), F.lit(0))
    return F.array_distinct(F.transform(units, lambda u: _marked(F.xxhash64(u))))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _bits_for(n: Column, load: int) -> Column:
    """Bits of the number of shards that hold ``n`` digests."""
    return F.least(
        F.lit(MAX_SHARD_BITS), F.ceil(F.log2(F.greatest(n.cast("double") / load, F.lit(1.0)))).cast("int")
    )


@dataclass(frozen=True)
class Size:
    """Columns that say how digests are dealt into shards: worked out once a row, not once a digest."""

    shift: Column  # bits that the first step uses
    outer: Column  # mask of the first step
    inner: Column  # mask of the second

    @staticmethod
    def add(df: DataFrame, bits: Column, name: str) -> tuple[DataFrame, Size]:
        """``df`` with the columns of 2**bits shards."""
        one = F.lit(1).cast("long")
        df = df.withColumn(f"{name}_bits", bits.cast("int"))
        df = df.withColumn(f"{name}_shift", F.shiftright(F.col(f"{name}_bits") + 1, 1))
        df = df.withColumn(f"{name}_outer", F.call_function("shiftleft", one, F.col(f"{name}_shift")) - 1)
        rest = F.col(f"{name}_bits") - F.col(f"{name}_shift")
        df = df.withColumn(f"{name}_inner", F.call_function("shiftleft", one, rest) - 1)
        return df, Size(F.col(f"{name}_shift"), F.col(f"{name}_outer"), F.col(f"{name}_inner"))


def _in_row(x: Column, row: int, at: Column) -> Column:
    """Whether digest ``x`` belongs to cell ``at`` of a row: three bits of it choose."""
    return F.shiftright(x, MAX_SHARD_BITS + 3 * row).bitwiseAND(F.lit(ROW - 1)) == at


def _cell(c: Column, x: Column) -> Column:
    return F.struct(c.alias("c"), x.alias("x"))


def _each_cell(body: Callable[[int, Column], Column]) -> Column:
    """``body(row, cell of the row)`` for the cells of a shard, row by row."""
    places = F.sequence(F.lit(0).cast("long"), F.lit(ROW - 1).cast("long"))

    def cells(row: int) -> Column:
        return F.transform(places, lambda at: body(row, at))

    return F.concat(*[cells(r) for r in range(CELLS // ROW)])


def _cells(held: Column) -> Column:
    """The CELLS cells of a shard that holds an array of digests."""
    empty = _cell(F.lit(0), F.lit(0).cast("long"))
    return _each_cell(
        lambda row, at: F.aggregate(
            F.filter(held, lambda k: _in_row(k, row, at)),
            empty,
            lambda a, k: _cell(a["c"] + 1, a["x"].bitwiseXOR(k)),
        )
    )


def _inner_shard(k: Column, size: Size) -> Column:
    return F.call_function("shiftright", k, size.shift).bitwiseAND(size.inner)


def dealt(keys: Column, size: Size) -> Column:
    """An array of digests as one array for each shard."""

    # in two steps, so that a long text is not read once for each shard
    def inner(held: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0).cast("long"), size.inner), lambda j: F.filter(held, lambda k: _inner_shard(k, size) == j)
        )

    return F.flatten(
        F.transform(
            F.sequence(F.lit(0).cast("long"), size.outer),
            lambda i: _let(F.filter(keys, lambda k: k.bitwiseAND(size.outer) == i), inner),
        )
    )


def _shard(k: Column, size: Size) -> Column:
    """The place in ``dealt`` of the shard of digest ``k``."""
    return (k.bitwiseAND(size.outer) * (size.inner + 1) + _inner_shard(k, size)).cast("int")


def sketch(keys: Column, size: Size) -> Column:
    """Shards of CELLS cells (c, x) of an array of digests."""
    return F.transform(dealt(keys, size), _cells)


def _subtract_shard(s: Column, t: Column) -> Column:
    return F.zip_with(s, t, lambda u, v: _cell(u["c"] - v["c"], u["x"].bitwiseXOR(v["x"])))


def subtract(a: Column, b: Column) -> Column:
    """The sketch of what differs: counts subtract, digests XOR."""
    return F.zip_with(a, b, _subtract_shard)


def _peel(cells: Column) -> Column:
    """(cells, found, live) of a shard: ``found`` are its digests (c is 1 or -1 for the side)."""

    def pure(now: Column) -> Column:
        return F.array_distinct(F.filter(now, lambda q: (F.abs(q["c"]) == 1) & _is_marked(q["x"])))

    def go(state: Column) -> Column:
        def taken(some: Column) -> Column:
            # what the found digests left in each cell, taken from it
            left = _each_cell(
                lambda row, at: F.aggregate(
                    F.filter(some, lambda p: _in_row(p["x"], row, at)),
                    _cell(F.lit(0), F.lit(0).cast("long")),
                    lambda a, p: _cell(a["c"] + p["c"], a["x"].bitwiseXOR(p["x"])),
                )
            )
            rest = F.zip_with(
                state["cells"], left, lambda q, v: _cell(q["c"] - v["c"], q["x"].bitwiseXOR(v["x"]))
            )
            return F.when(F.size(some) == 0, F.struct(state["cells"], state["found"], F.lit(False).alias("live"))).otherwise(
                F.struct(rest.alias("cells"), F.concat(state["found"], some).alias("found"), F.lit(True).alias("live"))
            )

        return F.when(state["live"], _let(pure(state["cells"]), taken)).otherwise(state)

    begin = F.struct(
        cells.alias("cells"), F.expr("cast(array() as array<struct<c:int,x:bigint>>)").alias("found"), F.lit(True).alias("live")
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, lambda s, _: go(s))


def _peeled_shard(cells: Column) -> Column:
    """The digests (c, x) of a shard; null if it does not peel."""
    return _let(
        _peel(cells), lambda s: F.when(F.forall(s["cells"], lambda q: (q["c"] == 0) & (q["x"] == 0)), s["found"])
    )


def peeled(difference: Column) -> Column:
    """The digests (c, x) of a sketch; null if it does not peel."""
    return F.flatten(F.transform(difference, _peeled_shard))


def unpeeled(keys: str, tried: str, size: Size) -> Column:
    """The digests of ``keys`` in shards that did not peel: those without a number in ``tried``."""
    there = F.filter(keys, lambda x: F.get(tried, _shard(x, size)).isNull())
    return F.when(F.exists(tried, lambda n: n.isNull()), there).otherwise(F.expr("cast(array() as array<bigint>)"))


def with_sketch(df: DataFrame, keys: str) -> DataFrame:
    """``df`` with ``<keys>_bits`` and ``<keys>_sketch``: the sketch of a digest column at its own size."""
    df, size = Size.add(df, _bits_for(F.size(keys), SHARD_LOAD), keys)
    return df.withColumn(f"{keys}_sketch", sketch(F.col(keys), size))


def with_likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """``df`` with ``name``: 1 - differing / all digests of the columns ``a`` and ``b``; 1 for two empty ones.

    ``a`` has a sketch (``with_sketch``), ``b`` may have one. They are
    subtracted at the size of the larger text's; the digests of the shards that
    do not peel are tried again with four times the shards, and what the last
    try leaves is compared itself. A shard that peels is not worked on again.
    """
    columns, both = df.columns, F.size(a) + F.size(b)
    bits = F.greatest(_bits_for(F.size(a), SHARD_LOAD), _bits_for(F.size(b), SHARD_LOAD))
    df = df.withColumn(f"{name}_first", bits)
    count, left = F.lit(0), (a, b)
    for k in range(TRIES):
        df, size = Size.add(df, F.least(F.col(f"{name}_first") + 2 * k, F.lit(MAX_SHARD_BITS)), f"{name}_size{k}")

        def held(keys: str, size=size) -> Column:
            made = sketch(F.col(keys), size)
            if f"{keys}_sketch" not in columns:
                return made
            same = F.col(f"{keys}_bits") == F.col(f"{name}_size0_bits")
            return F.when(same, F.col(f"{keys}_sketch")).otherwise(made)

        if k == 0:
            found = F.transform(subtract(held(a), held(b)), lambda s: F.array_size(_peeled_shard(s)))
        else:
            found = F.zip_with(
                dealt(F.col(left[0]), size),
                dealt(F.col(left[1]), size),
                lambda s, t: F.when(
                    F.size(s) + F.size(t) > 0, F.array_size(_peeled_shard(_subtract_shard(_cells(s), _cells(t))))
                ).otherwise(F.lit(0)),
            )
            some = F.size(left[0]) + F.size(left[1]) > 0
            found = F.when(some, found).otherwise(F.expr("cast(array() as array<int>)"))
        tried = f"{name}_try{k}"  # digests found in each shard; null where it does not peel
        df = df.withColumn(tried, found)
        count = count + F.aggregate(tried, F.lit(0), lambda n, m: n + F.coalesce(m, F.lit(0)))
        rest = f"{name}_a{k}", f"{name}_b{k}"
        for keys, to in zip(left, rest, strict=True):
            df = df.withColumn(to, unpeeled(keys, tried, size))
        left = rest
    count = count + F.size(F.array_except(*left)) + F.size(F.array_except(*left[::-1]))
    return df.select(*columns, F.when(both > 0, 1.0 - count / both).otherwise(F.lit(1.0)).alias(name))


def fingerprint(held: Column) -> Column:
    """A sketch as base64 of count (four bytes) and XOR (eight) of each cell."""
    text = F.transform(
        F.flatten(held),
        lambda q: F.concat(
            F.lpad(F.hex(q["c"].cast("long")), 8, "0"), F.lpad(F.hex(q["x"]), 16, "0")
        ),
    )
    return F.regexp_replace(F.base64(F.unhex(F.array_join(text, ""))), r"\s", "")


def _next_documents(docs: DataFrame) -> DataFrame:
    """o, h, no, nh, n: every distinct document (order and text hash), the one after it, and its code points.

    Ids are sorted in ranges and numbered inside them; only the first of each
    range, one row for each, is looked up across their borders.
    """
    keys = docs.select("o", "h", "n").distinct()
    ranges = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = through_storage(
        keys.repartitionByRange(ranges, "o", "h")
        .sortWithinPartitions("o", "h")
        .withColumn("place", F.monotonically_increasing_id()),
        "order",
    )
    first = {
        r.part: r.first
        for r in placed.groupBy(F.shiftrightunsigned("place", 33).alias("part"))
        .agg(F.min_by(F.struct("o", "h"), "place").alias("first"))
        .collect()  # one row for each range
    }
    parts = sorted(first)
    heads = docs.sparkSession.createDataFrame(
        [(p, first[q].o, first[q].h) for p, q in zip(parts, parts[1:] + parts[:1])], "part long, fo long, fh long"
    )
    after = placed.select((F.col("place") - 1).alias("place"), F.col("o").alias("no"), F.col("h").alias("nh"))
    return (
        placed.join(after, "place", "left")
        .withColumn("part", F.shiftrightunsigned("place", 33))
        .join(F.broadcast(heads), "part")  # one row for each range
        .select(
            "o", "h", "n",
            # the last of a range is followed by the first of the next
            F.coalesce("no", "fo").alias("no"), F.coalesce("nh", "fh").alias("nh"),
        )
    )


def fingerprint_versions(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text of a document has its last floor(n / 4) code points
    replaced by the first as many (or all) of the next document in ascending
    doc_id; the first follows the last. A null text counts as empty, an id
    that is null or no integer as larger than all others; documents with equal ids follow each other by
    text hash, and equal rows are one document, each with its own result row.
    Likeness is 1 minus the differing share of the distinct paragraphs of
    both, from subtracted and peeled sketches; two texts without words are
    alike. A single document follows itself. An empty table gives an empty
    result; columns other than doc_id and text are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        "doc_id", F.coalesce(F.col("doc_id").try_cast("long"), F.lit(LAST)).alias("o"), F.xxhash64(text).alias("h"), text.alias("t")
    )
    order = _next_documents(base.select("o", "h", F.length("t").alias("n")))
    links = through_storage(order, "links")
    rows = base.withColumn("keys", digests(F.col("t")))
    # One array, read as a whole by both joins: with the same columns they share one exchange of the texts.
    given = rows.select("o", "h", F.array(F.struct("doc_id", "t", "keys")).alias("doc"))
    # A document is the next of one other, so no key is met twice.
    start = (
        given.join(
            links.select(F.col("no").alias("o"), F.col("nh").alias("h"), F.col("o").alias("oo"), F.col("h").alias("oh"), "n"),
            ["o", "h"],
        )
        .select(
            F.col("oo").alias("o"), F.col("oh").alias("h"),
            F.transform(
                "doc",
                lambda d: F.struct(
                    F.substring(d["t"], F.lit(1), F.floor(F.col("n") / 4).cast("int")).alias("head"), d["keys"].alias("keys")
                ),
            )[0].alias("next"),
        )
    )
    if base.select("o", "h").groupBy("o", "h").count().filter("count > 1").isEmpty():
        pairs = given.join(start, ["o", "h"])
    else:
        pairs = given.join(start.dropDuplicates(["o", "h"]), ["o", "h"])
    pairs = pairs.withColumn("own", F.transform("doc", lambda d: d)[0]).select(
        "own.doc_id", "own.t", "own.keys", F.col("next.head").alias("head"), F.col("next.keys").alias("next_keys")
    )
    n = F.length("t")
    edited = pairs.withColumn(
        "edited", F.concat(F.substring(F.col("t"), F.lit(1), (n - F.floor(n / 4)).cast("int")), F.col("head"))
    ).withColumn("edited_keys", digests(F.col("edited")))
    compared = edited.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "keys", "edited_keys", "next_keys",
    )
    sketched = with_sketch(with_sketch(compared, "keys"), "edited_keys")
    near = with_likeness(with_likeness(sketched, "keys", "edited_keys", "near_edited"), "keys", "next_keys", "near_next")
    return near.select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprint(F.col("keys_sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_keys_sketch")).alias("edited_fingerprint"),
        "near_edited", "near_next",
    )
