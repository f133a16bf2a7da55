"""Operator 3, SentencePiece encoding and decoding with byte offsets.

The model file is read as it is (a protocol buffer). Normalisation walks the
text with the longest-prefix match of the compiled character map (a
double-array trie) and records for every normalised character the bytes it
came from; the pieces found in the normalised text are projected through that
record back to spans of the original bytes.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saleslens.llm.common import release_memory

SPACE = "▁"
# Piece types of the model format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Ways to cut a text before a space, around a line break and between letters and others; the first
#: that cuts no piece is used, else texts are segmented in one go. Each border depends on the two
#: characters beside it alone.
_LETTERS, _OTHERS = "[^\\W\\d_]", f"(?:[^\\w \\n{SPACE}]|[\\d_])"
BORDERS = (
    f"[ {SPACE}]+(?:{_LETTERS}+|{_OTHERS}*)|{_LETTERS}+|{_OTHERS}+|\\n",
    f"[ {SPACE}]+[^ \\n{SPACE}]*|[^ \\n{SPACE}]+|\\n",
    f"[ {SPACE}]+[^ {SPACE}]*|[^ {SPACE}]+",
)
#: Segments remembered in each of two generations by a Python worker, and the longest one remembered.
CACHE_SIZE, CACHE_CHARS = 250_000, 40
#: Multiplier of the pair table's hash; the rank of a pair that forms no piece.
MIX, NO_PAIR = 0x9E3779B97F4A7C15, 2**31 - 1


def _fields(buffer: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of one protocol buffer message; integers, floats and byte strings."""
    at, end = 0, len(buffer)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = buffer[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < end:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, buffer[at : at + size]
            at += size
        else:
            size = {1: 8, 5: 4}[kind]
            yield tag >> 3, struct.unpack("<d" if size == 8 else "<f", buffer[at : at + size])[0]
            at += size


class CharacterMap:
    """Longest-prefix replacement through a compiled map: trie units, then the replacement strings."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = list(struct.unpack_from(f"<{size // 4}I", blob, 4)) if size else []
        self.strings = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes of the longest mapped prefix of ``text[at:]`` and what they become."""
        units, found = self.units, None
        if not units:
            return None
        node = 0
        unit = units[0]
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(text)):
            byte = text[i]
            node ^= byte
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != byte:  # the label of the unit
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit & 0x100:  # a value hangs here
                value = units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.strings[value : self.strings.index(b"\0", value)])
        return found


class Normalizer:
    """Text to normalised characters, each with the first and last source byte."""

    def __init__(self, spec: bytes):
        fields = dict(_fields(spec))
        self.map = CharacterMap(fields.get(2, b""))
        self.dummy_prefix = bool(fields.get(3, 1))
        self.squeeze = bool(fields.get(4, 1))
        self.escape = bool(fields.get(5, 1))

    def __call__(self, text: str, prefix: bool | None = None) -> tuple[str, list[int], list[int]]:
        """Normalised text; first and end source byte of each of its characters."""
        prefix = self.dummy_prefix if prefix is None else prefix
        raw, out, first, end = text.encode(), [], [], []
        at = 0
        while at < len(raw):
            hit = self.map.longest(raw, at)
            if hit:
                size, what = hit[0], hit[1].decode()
            else:
                lead = raw[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                what = raw[at : at + size].decode()
            for ch in what:
                out.append(ch)
                first.append(at)
                end.append(at + size)
            at += size
        if self.squeeze:  # runs of spaces become one; none at the ends
            keep = [
                i for i, ch in enumerate(out) if ch != " " or (i and out[i - 1] != " " and any(c != " " for c in out[i:]))
            ]
            out, first, end = [out[i] for i in keep], [first[i] for i in keep], [end[i] for i in keep]
        mark = SPACE if self.escape else " "
        out = [mark if ch == " " else ch for ch in out]
        if prefix and raw and (out or not self.squeeze):
            start = first[0] if first else 0
            out, first, end = [mark, *out], [start, *first], [start, *end]
        return "".join(out), first, end


class PieceModel:
    """A byte-pair model: encode to ids with source spans, decode to text."""

    def __init__(self, blob: bytes):
        self.pieces, self.kinds, scores = [], [], []
        normalizer, trainer = b"", {}
        for field, value in _fields(blob):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                scores.append(piece.get(2, 0.0))
                self.kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = value
        if trainer.get(3, 1) != 2:
            raise ValueError("only byte-pair models are supported")
        if UNUSED in self.kinds or USER_DEFINED in self.kinds:
            raise ValueError("models with unused or user-defined pieces are not supported")
        self.normalizer = Normalizer(normalizer)
        self.cost = {p: -s for p, s, k in zip(self.pieces, scores, self.kinds, strict=True) if k == NORMAL}
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.unknown = self.kinds.index(UNKNOWN)
        self.end = trainer.get(42, 2)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        # Where no piece crosses a border of spaces, lines or letters, what stands
        # between two borders segments on its own.
        plain = not self.normalizer.map.units and not self.normalizer.squeeze and self.normalizer.escape
        self.split = None
        for borders in BORDERS if plain else ():
            split = re.compile(borders).findall
            if all(len(split(p)) == 1 for p in self.cost):
                self.split = split
                break
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.is_text = np.array([k != CONTROL for k in self.kinds])
        self.bytes_of = pa.array([self._bytes_of(i) for i in range(len(self.pieces))], pa.binary())
        if self.split:
            self._tables()

    def _bytes_of(self, i: int) -> bytes:
        """What an id adds to the text inside it."""
        if i in self.byte_of:
            return bytes([self.byte_of[i]])
        kind = self.kinds[i]
        return (" ⁇ " if kind == UNKNOWN else "" if kind == CONTROL else self.pieces[i].replace(SPACE, " ")).encode()

    def _tables(self) -> None:
        """Arrays for segmenting many short chunks at once: characters, pairs and source widths by id."""
        # Source bytes of a piece whose marks were spaces.
        self.width = np.zeros(len(self.pieces), dtype=np.int32)
        self.char_id = np.full(0x110000, -1, dtype=np.int32)
        pairs = {}
        ranks = {c: r for r, c in enumerate(sorted(set(self.cost.values())))}
        for piece, i in self.ids.items():
            self.width[i] = len(piece.encode()) - 2 * piece.count(SPACE)
            if len(piece) == 1:
                self.char_id[ord(piece)] = i
            for at in range(1, len(piece)):
                x, y = self.ids.get(piece[:at]), self.ids.get(piece[at:])
                if x is not None and y is not None:
                    pairs[x * len(self.pieces) + y] = (ranks[self.cost[piece]], i)
        self.char_id[ord(" ")] = self.char_id[ord(SPACE)]
        # An open-addressing table, at most an eighth full.
        bits = max(10, (8 * max(len(pairs), 1)).bit_length())
        self.slots = 64 - bits
        self.pair_key = np.full(1 << bits, -1, dtype=np.int64)
        self.pair_rank = np.full(1 << bits, NO_PAIR, dtype=np.int32)
        self.pair_id = np.zeros(1 << bits, dtype=np.int32)
        for key, (rank, i) in pairs.items():
            slot = (key * MIX & (1 << 64) - 1) >> self.slots
            while self.pair_key[slot] >= 0:
                slot = (slot + 1) & ((1 << bits) - 1)
            self.pair_key[slot], self.pair_rank[slot], self.pair_id[slot] = key, rank, i

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each pair; a pair that forms no piece gets an empty slot."""
        key = left.astype(np.int64) * len(self.pieces) + right
        slot = ((key.view(np.uint64) * np.uint64(MIX)) >> np.uint64(self.slots)).astype(np.int64)
        while True:
            there = self.pair_key[slot]
            wrong = (there != key) & (there >= 0)
            if not wrong.any():
                return slot
            slot[wrong] = (slot[wrong] + 1) & (len(self.pair_key) - 1)

    # -- segmentation ------------------------------------------------------

    def merge(self, text: str) -> list[str]:
        """The pieces of normalised ``text``: the best-scored pair first, the leftmost of equals."""
        return self._merge_short(text) if len(text) <= 64 else self._merge_long(text)

    def _merge_short(self, text: str) -> list[str]:
        cost, none = self.cost.get, float("inf")
        parts = list(text)
        pairs = [cost(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = cost(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = cost(parts[i] + parts[i + 1], none)
        return parts

    def _merge_long(self, text: str) -> list[str]:
        cost = self.cost.get
        parts = list(text)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(c, i, a + b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (c := cost(a + b)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i] if parts[i] else n
            if j >= n or parts[i] + parts[j] != joined:
                continue  # one side has merged since
            parts[i], parts[j] = joined, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (c := cost(both := parts[left] + parts[right])) is not None:
                    heapq.heappush(heap, (c, left, both))
        return [p for p in parts if p]

    def _numbers(self, piece: str) -> list[int]:
        number = self.ids.get(piece)
        if number is not None:
            return [number]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown]

    def _segment(self, text: str, prefix: bool) -> tuple[list[int], list[int], list[int]]:
        """ids, first and end source byte of each piece of ``text``."""
        norm, first, end = self.normalizer(text, prefix)
        ids, starts, ends, at = [], [], [], 0
        for piece in self.merge(norm):
            numbers = self._numbers(piece)
            a, b = first[at], end[at + len(piece) - 1]
            at += len(piece)
            ids += numbers
            # the bytes of a character that has no piece all point at that character
            starts += [a] * len(numbers)
            ends += [b] * len(numbers)
        return ids, starts, ends

    def _chunk(self, chunk: str) -> bytes:
        """(id, first, end) of each piece of a chunk inside a text, packed."""
        return np.array(self._segment(chunk, False), dtype=np.int32).T.tobytes()

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Makes all ``chunks`` known; gives back those too long to be remembered."""
        if len(self.young) >= CACHE_SIZE:  # what was not asked for since the last turn goes
            self.old, self.young = self.young, {}
        young, old, extra, by_size = self.young, self.old, {}, {}
        for chunk in chunks:
            if chunk in young:
                continue
            found = old.get(chunk)
            if found is not None:
                young[chunk] = found
            elif len(chunk) > CACHE_CHARS:
                extra[chunk] = self._chunk(chunk)
            else:
                by_size.setdefault(len(chunk), []).append(chunk)
        for some in by_size.values():
            self._segment_alike(some, young, spans=True)
        return extra

    def ids_of(self, chunks: list[str]) -> dict[str, bytes]:
        """Packed ids (int32) of each chunk inside a text; nothing is remembered."""
        out, by_size = {}, {}
        for chunk in chunks:
            if len(chunk) > CACHE_CHARS or not self.split:
                out[chunk] = np.array(self._segment(chunk, False)[0], dtype=np.int32).tobytes()
            else:
                by_size.setdefault(len(chunk), []).append(chunk)
        for some in by_size.values():
            self._segment_alike(some, out, spans=False)
        return out

    def _segment_alike(self, some: list[str], out: dict[str, bytes], spans: bool) -> None:
        """Segments chunks of one length into ``out``: packed ids, or (id, first, end) with ``spans``."""
        codes = np.frombuffer("".join(some).encode("utf-32-le"), dtype="<u4").reshape(len(some), -1)
        ids = self.char_id[codes]
        plain = (ids >= 0).all(axis=1) & (codes != ord(SPACE)).all(axis=1)
        for i in np.flatnonzero(~plain):
            table = np.array(self._segment(some[i], False), dtype=np.int32)
            out[some[i]] = (table.T if spans else table[0]).tobytes()
        self._merge_many(ids[plain], np.flatnonzero(plain), some, out, spans)

    def _merge_many(self, ids: np.ndarray, rows: np.ndarray, chunks: list[str], out: dict, spans: bool) -> None:
        """Merges equally long chunks together: a round merges the best pair of each that has one."""
        slot = self._pairs(ids[:, :-1], ids[:, 1:])
        rank, joined = self.pair_rank[slot], self.pair_id[slot]
        while len(ids):
            n, at = ids.shape[1], np.arange(len(ids))
            if n > 1:
                best = rank.argmin(axis=1)  # the leftmost of equals
                done = rank[at, best] == NO_PAIR
            else:
                best, done = at, np.ones(len(ids), dtype=bool)
            if done.any():
                table = ids[done]
                if spans:
                    end = np.cumsum(self.width[table], axis=1, dtype=np.int32)
                    table = np.stack((table, end - self.width[table], end), axis=2)
                packed, step = table.astype(np.int32).tobytes(), (12 if spans else 4) * n
                for k, i in enumerate(rows[done].tolist()):
                    out[chunks[i]] = packed[k * step : (k + 1) * step]
                if done.all():
                    return
                ids, rows, best, rank, joined = ids[~done], rows[~done], best[~done], rank[~done], joined[~done]
                at = np.arange(len(ids))
            ids[at, best] = joined[at, best]
            kept = np.ones(ids.shape, dtype=bool)
            kept[at, best + 1] = False
            ids = ids[kept].reshape(len(ids), n - 1)
            rank, joined = (x[kept[:, 1:]].reshape(len(ids), n - 2) for x in (rank, joined))
            # only the pairs beside the merged one are new
            for some, pair in ((best > 0, best - 1), (best < n - 2, best)):
                row, pair = at[some], pair[some]
                slot = self._pairs(ids[row, pair], ids[row, pair + 1])
                rank[row, pair], joined[row, pair] = self.pair_rank[slot], self.pair_id[slot]

    # -- interface ---------------------------------------------------------

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
        """ids, first and end source byte of each piece, and the decoded text; no end id."""
        return next(self.encode_many([text]))

    def encode_many(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, str]]:
        """``encode`` of each text; what they share is segmented once."""
        cut = [self.split(t) if self.split and t else [t] for t in texts]
        extra = self._learn({c for chunks in cut for c in chunks[1:]}) if self.split else {}
        for text, chunks in zip(texts, cut, strict=True):
            head = self._segment(chunks[0], self.normalizer.dummy_prefix) if text else ([], [], [])
            table = np.array(head, dtype=np.int32).T
            if len(chunks) > 1:
                get = self.young.get
                found = [get(c) or extra[c] for c in chunks[1:]]
                rest = np.frombuffer(b"".join(found), dtype=np.int32).reshape(-1, 3)
                count = np.array([len(x) for x in found]) // 12
                size = rest[np.cumsum(count) - 1, 2]  # a chunk ends where its last piece does
                at = len(chunks[0].encode()) + np.cumsum(size) - size
                rest = rest + np.repeat(at, count)[:, None] * np.array([0, 1, 1])
                table = np.concatenate((table, rest.astype(np.int32)))
            ids = table[:, 0]
            yield ids, table[:, 1], table[:, 2], self.decode_ids(ids)

    def surface(self, ids: list[int]) -> str:
        """The text of pieces inside a text: runs of byte pieces join, broken bytes become U+FFFD."""
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_utf8(run))
                run = bytearray()
            kind = self.kinds[i]
            out.append(" ⁇ " if kind == UNKNOWN else "" if kind == CONTROL else self.pieces[i].replace(SPACE, " "))
        if run:
            out.append(_utf8(run))
        return "".join(out)

    def decode_ids(self, ids: np.ndarray) -> str:
        """``decode`` by a table of each id's bytes, gathered in one go.

        Pieces are whole characters, so where all the bytes together are UTF-8
        each run of byte pieces is, too; else the runs are looked at one by one.
        """
        joined = self.bytes_of.take(pa.array(ids, pa.int32()))
        ends = np.frombuffer(joined.buffers()[1], dtype=np.int32)
        raw = joined.buffers()[2].to_pybytes()[: ends[len(ids)]] if len(ids) else b""
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            return self.decode(ids.tolist())
        kept = ids[self.is_text[ids]]
        return self._without_prefix(text, kept)

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; the space put before the text goes."""
        ids = [i for i in ids if self.kinds[i] != CONTROL]
        return self._without_prefix(self.surface(ids), ids)

    def _without_prefix(self, text: str, ids) -> str:
        ids = list(ids[:1])
        if ids and self.normalizer.dummy_prefix and self.pieces[ids[0]].startswith(SPACE):
            text = text[1:]
        if ids and self.normalizer.squeeze:
            text = text.lstrip(" ")
        return text


def _utf8(run: bytes) -> str:
    """Bytes as text; each byte that starts no character becomes U+FFFD."""
    out, at = [], 0
    while at < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(bytes(run[at : at + size]).decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            size = 1
        at += size
    return "".join(out)


_loaded: list[tuple[object, PieceModel]] = []


def _model(blob: bytes) -> PieceModel:
    """The model, read once in each Python worker (a broadcast value is one object there)."""
    if not (_loaded and _loaded[0][0] is blob):
        _loaded[:] = [(blob, PieceModel(blob))]
    return _loaded[0][1]


def read_model(path: str) -> bytes:
    """The model file, read on the driver; executors get its bytes by broadcast (a file of a few MB)."""
    with open(path, "rb") as f:
        return f.read()


def _int_lists(values: list[np.ndarray], sizes: list[int]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values).astype(np.int32)))


def encode_documents(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids, first, last (arrays of int) and decoded (string) for every row.

    ``ids`` are the library's ids of the whole text followed by the end id;
    ``first`` and ``last`` give the bytes [first, last) of the original text
    that each id stands for (empty for the end id and for the space put
    before the text); ``decoded`` is the text of the ids. A null text counts
    as empty: one id, the end. Rows are independent: repeated rows, a null key
    and an empty table need no care, and other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType(
        [
            docs.schema[key],
            *[T.StructField(n, T.ArrayType(T.IntegerType(), False)) for n in ("ids", "first", "last")],
            T.StructField("decoded", T.StringType()),
        ]
    )

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(shared.value)
        for part in parts:
            for at in range(0, part.num_rows, 500):
                some = part.slice(at, 500)
                ids, first, last, sizes, decoded = [], [], [], [], []
                texts = [t or "" for t in some.column(1).to_pylist()]
                for t, (i, a, b, back) in zip(texts, m.encode_many(texts), strict=True):
                    n = len(t.encode())
                    ids.append(np.append(i, np.int32(m.end)))
                    first.append(np.append(a, n).astype(np.int32))
                    last.append(np.append(b, n).astype(np.int32))
                    sizes.append(len(i) + 1)
                    decoded.append(back)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), *[_int_lists(v, sizes) for v in (ids, first, last)], pa.array(decoded, pa.string())],
                    names=[f.name for f in schema.fields],
                )
        m.young, m.old = {}, {}  # the worker outlives its task; what it remembers should not
        release_memory()

    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(encode, schema)


def encoding_digests(docs: DataFrame, model: bytes) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, span_bytes.

    ``span_bytes``: bytes of the text that the spans of its ids cover (a span
    that several byte ids share counts once), all of them for an identity map.
    """
    done = encode_documents(docs, model)
    spans = F.arrays_zip("first", "last")
    covered = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, p: F.struct(
            F.greatest(s["end"], p["last"]).alias("end"),
            (s["n"] + F.greatest(p["last"] - F.greatest(p["first"], s["end"]), F.lit(0))).alias("n"),
        ),
        lambda s: s["n"],
    )
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        covered.alias("span_bytes"),
    )
