"""CSV records whose quoted cells span lines, read by many tasks from one file.

A line alone does not tell whether it starts inside a quoted cell. What it
does to that state can be told, though: it leaves it as it is, turns it
around, or ends outside or inside whatever it was before. These four effects
compose, so each split of a file is summed up in one row (a prefix scan), the
driver runs over the rows of the splits, one each, and every split then knows
the state it starts in and cuts its lines into records by itself. Only the
records that cross a split's border, two for each split at most, are put
together by a shuffle.

The effect of a line and the passes over the lines of a split are worked out
on vectorised Arrow batches, since they follow the order of lines.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Effects of a line: the state stays, turns around, or is outside (inside) after it.
STAYS, TURNS, OUTSIDE, INSIDE = 0, 1, 2, 3

_SPLITS = pa.schema(
    [
        ("file", pa.int64()), ("start", pa.int64()), ("after_out", pa.bool_()), ("after_in", pa.bool_()),
        ("opens_in", pa.bool_()), ("crlf", pa.bool_()),
    ]
)
_RECORDS = pa.schema(
    [("record", pa.string()), ("file", pa.int64()), ("owner", pa.int64()), ("start", pa.int64()), ("header", pa.bool_())]
)


def effects_of(lines: pa.Array, sep: str = ",") -> np.ndarray:
    """What each line does to the state, as one of the four codes.

    A cell opens with a quote right after a separator or at the line's start;
    in it a doubled quote stands for one, and the first other quote closes it,
    after which the rest of the cell is plain text. Quotes elsewhere in a
    plain cell are text.

    Two regular expressions tell it, one for each state before the line; Arrow
    matches them in linear time, byte by byte, so any text will do.
    """
    if len(sep.encode()) != 1:
        raise ValueError("the separator must be a single byte")
    cut = "".join(f"\\x{x:02x}" for x in sep.encode())
    held = '(?:[^"]|"")*'  # inside a quoted cell
    rest = f'(?:[^"{cut}][^{cut}]*)?'  # a plain cell, or what follows the quote that closes one
    opened = f'(?:(?:{rest}|"{held}"{rest}){cut})*"{held}\\z'
    lines = lines.cast(pa.binary())
    effects = np.full(len(lines), STAYS, dtype=np.int8)
    quoted = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
    if len(quoted):
        some = lines.take(pa.array(quoted))
        after_out = pc.match_substring_regex(some, rf"\A{opened}").to_numpy(zero_copy_only=False)
        after_in = pc.match_substring_regex(some, rf'\A{held}(?:"{rest}{cut}{opened}|\z)').to_numpy(zero_copy_only=False)
        effects[quoted] = np.where(after_in, np.where(after_out, INSIDE, STAYS), np.where(after_out, TURNS, OUTSIDE))
    return effects


def line_effect(line: Column, sep: str = ",") -> Column:
    """``effects_of`` as a column."""

    @F.arrow_udf("byte")
    def effect(lines: pa.Array) -> pa.Array:
        return pa.array(effects_of(lines, sep))

    return effect(line)


def _states(effects: np.ndarray, inside: bool) -> tuple[np.ndarray, bool]:
    """The state before each line, and after the last, when the first starts ``inside`` or not."""
    turned = np.cumsum(effects == TURNS)
    fixed = effects >= OUTSIDE
    last = np.maximum.accumulate(np.where(fixed, np.arange(len(effects)), -1))
    base = np.where(last < 0, inside, effects[last] == INSIDE)
    since = turned - np.where(last < 0, 0, turned[last])
    after = base ^ (since % 2 == 1)
    return np.concatenate(([inside], after[:-1])), bool(after[-1])


def _runs(part: pa.RecordBatch) -> Iterator[tuple[int, int, int, int]]:
    """(file, start, from, to) of the rows of each split in a batch."""
    file, start = part.column("file").to_numpy(), part.column("start").to_numpy()
    cuts = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
    for a, b in zip([0, *cuts], [*cuts, len(file)]):
        if b > a:
            yield int(file[a]), int(start[a]), int(a), int(b)


def _sum_up(parts: Iterator[pa.RecordBatch], sep: str) -> Iterator[pa.RecordBatch]:
    """One row for each split: the state after it from either state, whether a record starts in it from inside, its first line's end."""
    done: list[tuple] = []
    for part in parts:
        lines = part.column("value")
        effects, crlf = effects_of(lines, sep), pc.ends_with(lines, "\r")
        for file, start, a, b in _runs(part):
            if not done or done[-1][:2] != (file, start):
                done.append((file, start, False, True, False, crlf[a].as_py()))
            _, _, out, into, opens, ends = done[-1]
            before, into = _states(effects[a:b], into)
            done[-1] = (file, start, _states(effects[a:b], out)[1], into, opens or not before.all(), ends)
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _SPLITS)], schema=_SPLITS)


class _Entries:
    """The state that each split starts in, the split where the record that is then open began, and the file's line ends."""

    def __init__(self, rows: list):
        self.by_file: dict[int, list[tuple[int, bool, int]]] = {}
        self.crlf = {r["file"] for r in rows if r["start"] == 0 and r["crlf"]}
        files = defaultdict(list)
        for r in rows:
            files[r["file"]].append((r["start"], r["after_out"], r["after_in"], r["opens_in"]))
        for file, splits in files.items():
            inside, owner, found = False, -1, []
            for start, after_out, after_in, opens_in in sorted(splits):
                found.append((start, inside, owner))
                if not inside or opens_in:
                    owner = start
                inside = after_in if inside else after_out
            self.by_file[file] = found

    def of(self, file: int, start: int) -> tuple[bool, int]:
        splits = self.by_file[file]
        at = bisect.bisect_left(splits, (start,))
        return splits[at][1:]


class _Cutter:
    """Cuts the lines of one split, batch by batch, into records and the pieces at its ends."""

    def __init__(self, file: int, start: int, inside: bool, owner: int):
        self.file, self.start, self.inside, self.owner = file, start, inside, owner
        self.head = inside  # the first lines belong to a record that began earlier
        self.header = start == 0  # the first record of a file is its header
        self.open: list[pa.Array] = []  # lines of the record that is open

    def _piece(self, lines: list[pa.Array], owner: int, header: bool) -> tuple:
        return ("\n".join(x for a in lines for x in a.to_pylist()), self.file, owner, self.start, header)

    def add(self, lines: pa.Array, effects: np.ndarray) -> Iterator[pa.RecordBatch]:
        before, self.inside = _states(effects, self.inside)
        first = np.flatnonzero(~before)
        if not len(first):
            self.open.append(lines)
            return
        if first[0] > 0:
            self.open.append(lines.slice(0, first[0]))
        yield from self._close()
        bounds = np.append(first, len(lines))
        self.open = [lines.slice(int(bounds[-2]))]  # the last record may go on in the next batch
        if len(bounds) > 2:
            whole = lines.slice(int(bounds[0]), int(bounds[-2] - bounds[0]))
            offsets = pa.array(bounds[:-1] - bounds[0], pa.int32())
            yield self._whole(pc.binary_join(pa.ListArray.from_arrays(offsets, whole), "\n"))

    def _whole(self, records: pa.Array) -> pa.RecordBatch:
        records = records.filter(pc.not_equal(records, ""))
        if self.header and len(records):
            records, self.header = records.slice(1), False
        nothing = pa.nulls(len(records), pa.int64())
        return pa.RecordBatch.from_arrays([records.cast(pa.string()), nothing, nothing, nothing, pa.nulls(len(records), pa.bool_())], schema=_RECORDS)

    def _close(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        """What is open, now that a record starts or the split ends."""
        if not self.open:
            return
        if self.head:
            rows = [self._piece(self.open, self.owner, False)]
        elif last and self.inside:
            rows = [self._piece(self.open, self.start, self.header)]
        else:
            text = "\n".join(x for a in self.open for x in a.to_pylist())
            self.open = []
            yield self._whole(pa.array([text], pa.string()))
            return
        self.open, self.head = [], False
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RECORDS)], schema=_RECORDS)

    def end(self) -> Iterator[pa.RecordBatch]:
        yield from self._close(last=True)


def csv_records(lines: DataFrame, sep: str = ",") -> DataFrame:
    """record for every CSV record of ``lines``, a table that ``lines_of`` made; each file's header is left out.

    A file whose first line ends in CR LF has LF for each of them, in cells
    too; in other files a CR is text. Empty lines between records are skipped.
    One job sums up the splits when this is called; one row for each split
    comes to the driver.
    """
    lines = lines.select("file", "start", "value")
    splits = lines.mapInArrow(
        lambda parts: _sum_up(parts, sep), "file long, start long, after_out boolean, after_in boolean, opens_in boolean, crlf boolean"
    )
    entries = lines.sparkSession.sparkContext.broadcast(_Entries(splits.collect()))

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = None
        for part in parts:
            values = part.column("value").cast(pa.string())
            effects = effects_of(values, sep)
            for file, start, a, b in _runs(part):
                if cutter is None or (cutter.file, cutter.start) != (file, start):
                    if cutter is not None:
                        yield from cutter.end()
                    cutter = _Cutter(file, start, *entries.value.of(file, start))
                some = values.slice(a, b - a)
                if file in entries.value.crlf:
                    some = pc.replace_substring_regex(some, "\r\\z", "")
                yield from cutter.add(some, effects[a:b])
        if cutter is not None:
            yield from cutter.end()

    def kept(crossing: bool) -> DataFrame:
        # the whole records and the pieces are two jobs; each leaves the other's batches in Python
        def some(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return (found for found in cut(parts) if (found.column("owner").null_count < len(found)) == crossing)

        return lines.mapInArrow(some, "record string, file long, owner long, start long, header boolean")

    crossing = (
        kept(crossing=True)
        .groupBy("file", "owner")
        .agg(
            F.array_sort(F.collect_list(F.struct("start", "record"))).alias("pieces"),
            F.bool_or(F.coalesce("header", F.lit(False))).alias("header"),
        )
        .filter(~F.col("header"))
        .select(F.array_join("pieces.record", "\n").alias("record"))
    )
    return kept(crossing=False).select("record").unionAll(crossing)


def lines_of(text: DataFrame) -> DataFrame:
    """file, start, value of the lines of ``text``, a text source read with ``lineSep`` LF.

    ``file`` is a hash of the file's path and ``start`` where the split that
    the line is read in begins. Lines of a split are in their order.
    """
    return text.select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )
