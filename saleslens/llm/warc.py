"""Operator 11, WARC archives: a deterministic sharded writer, and a reader.

Records are sorted by page in ranges between splitters that a hash of the rows
chooses, so that the same pages give the same files whatever the partitions.
One task writes a range: a gzip member for each record, a new file whenever
the compressed size reaches the limit. Files are written under temporary names
of their own and renamed when they are whole; a record counts when the
manifest, committed last, names its file. A task that is run again writes the
same bytes under the same names.

Of records with equal payloads the one of the largest page is the response and
the others revisit it. That is settled on digests alone, hot payloads split by
a salt and pre-aggregated; payloads travel once, as finished gzip members, and
only as far as the writer of their range.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslens.llm.common import fresh, release_memory, through_storage
from saleslens.session import shared_dir

#: Payloads of fewer bytes are stored with every record.
MIN_REVISIT_BYTES = 0
#: Payload bytes of a range, compressed bytes at which a file ends, and ranges at most: beyond them ranges grow.
SHARD_BYTES, ROLL_BYTES, MAX_SHARDS = 32_000_000, 4_000_000, 20_000
#: Rows sampled for each range to place the splitters.
SAMPLE_A_SHARD = 32
#: Parts of a group of equal payloads; equal rows that are written together.
SALTS, COPIES = 64, 10_000
#: Keys that a task remembers to send equal rows once.
SEEN_KEYS = 100_000
#: Every record bears this date: one taken from the clock would change the files.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_SPACE = uuid.UUID(int=0)
_MANIFEST = "manifest"
_READ_BYTES = 1 << 16


# ------------------------------------------------------------------- records --


def digest32(sha1: bytes) -> str:
    """A SHA-1 as WARC writes it: upper-case base32."""
    return base64.b32encode(sha1).decode()


def _line(text: str) -> str:
    """``text`` on one header line: line breaks and per cent signs escaped."""
    return re.sub(r"[\r\n%]", lambda m: f"%{ord(m[0]):02X}", text)


def _unline(text: str) -> str:
    return re.sub("%(0A|0D|25)", lambda m: chr(int(m[1], 16)), text)


@dataclass(frozen=True)
class Page:
    """What a record says of its page; ids as text, None for a null one."""

    page_id: str | None
    url: str | None
    payload_bytes: int
    sha1: bytes


def _page(row: dict) -> Page:
    return Page(row["page_id"], row["url"], row["payload_bytes"], row["sha1"])


def record_member(page: Page, copy: int, payload: bytes | None, refers_to: tuple[str | None] | None = None) -> bytes:
    """A gzip member with the record of ``page``: a response with its payload, or a revisit of ``refers_to``."""
    name = f"{page.page_id} {page.url} {page.sha1.hex()} {copy} {refers_to}"
    digest = "sha1:" + digest32(page.sha1)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {page.payload_bytes}\r\n\r\n"
    block = http.encode() + (payload or b"")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", digest),
        ("WARC-Block-Digest", "sha1:" + digest32(hashlib.sha1(block).digest())),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    for field, value in (("WARC-Target-URI", page.url), ("X-Page-ID", page.page_id)):
        if value is not None:
            fields.append((field, _line(value)))
    if refers_to is not None:
        fields.append(("WARC-Profile", PROFILE))
        if refers_to[0] is not None:
            fields.append(("X-Refers-To-Page-ID", _line(refers_to[0])))
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", compresslevel=6, mtime=0)


def parse_record(raw: bytes) -> dict:
    """The fields of one record, with its block; raises ValueError if it is damaged or a digest is wrong."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not found or not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k: v for k, _, v in (line.partition(": ") for line in lines)}
    size = int(fields["Content-Length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    if fields.get("WARC-Block-Digest") != "sha1:" + digest32(hashlib.sha1(block).digest()):
        raise ValueError("the block's digest is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    response = fields["WARC-Type"] == "response"
    if response and fields["WARC-Payload-Digest"] != "sha1:" + digest32(hashlib.sha1(payload).digest()):
        raise ValueError("the payload's digest is wrong")
    if response and length != len(payload):
        raise ValueError("the payload's length is wrong")
    text = lambda k: _unline(fields[k]) if k in fields else None
    return {
        "page_id": text("X-Page-ID"),
        "url": text("WARC-Target-URI"),
        "payload_bytes": length,
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": fields["WARC-Type"],
        "refers_to": text("X-Refers-To-Page-ID"),
        "record_id": fields["WARC-Record-ID"],
        "payload": payload if response else None,
    }


def members(stream) -> Iterator[bytes]:
    """The unpacked gzip members of a file, one at a time."""
    part, out, data = zlib.decompressobj(31), [], b""
    while True:
        data = data or stream.read(_READ_BYTES)
        if not data:
            if out:
                raise ValueError("the file ends inside a record")
            return
        out.append(part.decompress(data))
        data = part.unused_data
        if part.eof:
            yield b"".join(out)
            part, out = zlib.decompressobj(31), []


# ------------------------------------------------------------------- folders --


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of ``folder``: a local path or the URI of a store that pyarrow knows."""
    if "://" in folder or folder.startswith("file:"):
        scheme, _, rest = folder.partition(":")
        if scheme == "file":
            return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
        return pafs.FileSystem.from_uri(folder)
    return pafs.LocalFileSystem(), folder


class _Roller:
    """Files of one range: members are appended, and a file ends at the size limit."""

    def __init__(self, folder: str, shard: int, roll: int):
        self.store, self.folder = _store(folder)
        self.shard, self.roll, self.number = shard, roll, 0
        self.out = None

    def write(self, member: bytes) -> Iterator[dict]:
        if self.out is None:
            self.name = f"part-{self.shard:05d}-{self.number:05d}.warc.gz"
            self.temporary = posixpath.join(self.folder, "_temporary", f"{self.name}.{uuid.uuid4().hex}")
            self.out = self.store.open_output_stream(self.temporary, compression=None)
            self.size, self.records, self.digest = 0, 0, hashlib.sha256()
        self.out.write(member)
        self.digest.update(member)
        self.size += len(member)
        self.records += 1
        if self.size >= self.roll:
            yield from self.close()

    def close(self) -> Iterator[dict]:
        """The manifest row of the file that was open, now under its own name."""
        if self.out is None:
            return
        self.out.close()
        self.store.move(self.temporary, posixpath.join(self.folder, self.name))
        yield {
            "file": self.name, "shard": self.shard, "records": self.records, "bytes": self.size,
            "sha256": self.digest.hexdigest(),
        }
        self.out, self.number = None, self.number + 1


# --------------------------------------------------------------------- writer --


def _identity(pages: DataFrame, id_column: str) -> DataFrame:
    """o (the id as given), page_id (as text), url, payload and what tells payloads apart."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select(
        F.col(id_column).alias("o"), F.col(id_column).cast("string").alias("page_id"), "url", payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.unhex(F.sha1(payload)).alias("sha1"), F.unhex(F.sha2(payload, 256)).alias("sha256"),
    )


def _plan(rows: DataFrame, min_revisit: int) -> DataFrame:
    """o, page_id, url, payload_bytes, sha1, sha256, copies, refers (bool), refers_to, first for the distinct ``rows``.

    ``first``: its first copy holds the payload. Groups of equal payloads are
    pre-aggregated by salt, so no task meets a hot one whole.
    """
    keys = ["o", "page_id", "url", "payload_bytes", "sha1", "sha256"]
    distinct = through_storage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")), "warc-keys")
    salted = distinct.withColumn("salt", F.pmod(F.xxhash64("o", "url"), F.lit(SALTS)))
    # the largest id, and of its rows that of the smallest url; null ids and urls come last
    order = F.struct(F.col("o").isNotNull(), "o", F.col("page_id"))
    some = salted.groupBy("sha256", "salt").agg(F.max(order).alias("top"))
    top = some.groupBy("sha256").agg(F.max("top").alias("top")).withColumnRenamed("sha256", "same")
    tops = some.select("sha256", "salt").join(top, F.col("sha256") == F.col("same")).drop("same")
    # one row a key from here on; a page's own urls decide among equals
    joined = salted.join(tops, ["sha256", "salt"]).withColumn("is_top", F.col("o").eqNullSafe(F.col("top.o")))
    lead = (
        joined.filter("is_top").groupBy("sha256").agg(F.min(F.struct(F.col("url").isNull(), "url")).alias("lead"))
        .select(F.col("sha256").alias("same"), F.col("lead.url").alias("lead_url"), F.lit(True).alias("is_first"))
    )
    placed = joined.filter("is_top").join(
        lead, (F.col("sha256") == F.col("same")) & F.col("url").eqNullSafe(F.col("lead_url")), "left"
    )
    columns = [*keys, "copies", "refers_to", "first"]
    whole = F.col("payload_bytes") < min_revisit
    leading = placed.select(
        *keys, "copies", F.col("top.page_id").alias("refers_to"), F.coalesce("is_first", F.lit(False)).alias("first")
    )
    others = joined.filter("not is_top").select(
        *keys, "copies", F.col("top.page_id").alias("refers_to"), F.lit(False).alias("first")
    )
    return leading.unionAll(others).select(*columns).withColumn("whole", whole)


class _Ranges:
    """Ranges of (id, payload, url, part of the copies), between splitters."""

    def __init__(self, splitters: list[tuple]):
        self.splitters = splitters

    @staticmethod
    def key(o, sha256: bytes, url: str | None, chunk: int) -> tuple:
        return (o is not None, o if o is not None else 0, bytes(sha256), url is not None, url or "", chunk)

    def of(self, row: tuple) -> int:
        return bisect.bisect_right(self.splitters, self.key(*row))


def write_archive(
    pages: DataFrame,
    folder: str,
    id_column: str = "page_id",
    min_revisit: int = MIN_REVISIT_BYTES,
    shard_bytes: int = SHARD_BYTES,
    roll_bytes: int = ROLL_BYTES,
) -> DataFrame:
    """Writes ``pages`` (id, url, html) to WARC files in ``folder``, which must be new; the manifest.

    The manifest (file, shard, records, bytes, sha256) is stored in the folder
    too, after all files. A null html is an empty payload, a null url is left
    out, and so is a null id, which sorts before all others. Payloads of
    ``min_revisit`` bytes or more are stored once: with the largest id that has
    them (ties: the smallest url), the other records, copies of that row
    included, revisit it. Repeated rows are records of their own. An empty
    table gives an empty archive; columns of other names are not read.
    """
    spark = pages.sparkSession
    store, path = _store(folder)
    if store.get_file_info(posixpath.join(path, _MANIFEST)).type != pafs.FileType.NotFound:
        raise FileExistsError(folder)
    store.create_dir(posixpath.join(path, "_temporary"), recursive=True)
    rows = _identity(pages, id_column)
    plan = through_storage(_plan(rows.drop("payload"), min_revisit), "warc-plan")
    # copies of a row beyond the first COPIES are placed on their own
    records = plan.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES).cast("int"))))
    volume = plan.agg(F.sum("payload_bytes").alias("b"), F.sum("copies").alias("n")).first()
    shards = max(1, min(MAX_SHARDS, -(-(volume["b"] or 0) // shard_bytes)))
    ranges = spark.sparkContext.broadcast(_Ranges(_splitters(records, shards)))

    id_type = pages.schema[id_column].dataType.simpleString()
    types = [
        ("o", pages.schema[id_column].dataType.simpleString()), ("sha256", "binary"), ("url", "string"), ("chunk", "int"),
        ("page_id", "string"), ("payload_bytes", "long"), ("sha1", "binary"), ("copies", "long"), ("refers_to", "string"),
        ("first", "boolean"), ("whole", "boolean"), ("member", "binary"),
    ]
    schema = ", ".join(f"{n} {t}" for n, t in types)
    listed = pa.schema(
        [("file", pa.string()), ("shard", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]
    )

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The response of every row, packed; equal rows of a task once."""
        seen: set = set()
        for part in parts:
            for at in range(0, len(part), 500):
                some = part.slice(at, 500)
                chosen, packed = [], []
                for i, row in enumerate(some.to_pylist()):
                    key = (row["page_id"], row["url"], row["sha256"])
                    if key not in seen:
                        chosen.append(i)
                        packed.append(record_member(_page(row), 0, row["payload"]))
                    if len(seen) >= SEEN_KEYS:
                        seen.clear()
                    seen.add(key)
                some = some.select(["o", "sha256", "url"]).take(pa.array(chosen, pa.int64()))
                chunk, member = pa.array([0] * len(chosen), pa.int32()), pa.array(packed, pa.binary())
                yield pa.RecordBatch.from_arrays([*some.columns, chunk, member], [*some.schema.names, "chunk", "member"])
        release_memory()

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keys = zip(*(part.column(c).to_pylist() for c in ("o", "sha256", "url", "chunk")))
            shard = pa.array([ranges.value.of(k) for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([*part.columns, shard], [*part.schema.names, "shard"])

    packed = rows.mapInArrow(pack, f"o {types[0][1]}, sha256 binary, url string, chunk int, member binary")
    names = [n for n, _ in types]
    every = packed.unionByName(records.select(*names[:-1]), allowMissingColumns=True).select(*names)
    # a row's member comes before its record: it has no count of copies
    placed = (
        every.mapInArrow(place, schema + ", shard int")
        .repartitionById(shards, "shard")
        .sortWithinPartitions("shard", "o", "sha256", "url", "chunk", F.col("copies").asc_nulls_first())
    )

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, held, member, done = None, None, None, []
        for part in parts:
            for at in range(0, len(part), 500):
                for row in part.slice(at, 500).to_pylist():
                    if files is None or files.shard != row["shard"]:
                        if files is not None:
                            done += files.close()
                        files = _Roller(folder, row["shard"], roll_bytes)
                    key = (row["o"], row["url"], row["sha256"])
                    if row["member"] is not None:
                        held, member = key, row["member"]
                        continue
                    start = row["chunk"] * COPIES
                    for copy in range(start, min(start + COPIES, row["copies"])):
                        if not row["whole"] and not (row["first"] and copy == 0):
                            done += files.write(record_member(_page(row), copy, None, (row["refers_to"],)))
                        elif held != key:
                            raise RuntimeError("a response came without its payload")
                        elif copy == 0:
                            done += files.write(member)
                        else:
                            payload = parse_record(gzip.decompress(member))["payload"]
                            done += files.write(record_member(_page(row), copy, payload))
        if files is not None:
            done += files.close()
        if done:
            yield pa.RecordBatch.from_pylist(done, listed)
        release_memory()

    manifest = placed.mapInArrow(write, "file string, shard int, records long, bytes long, sha256 string")
    manifest.write.mode("overwrite").parquet(posixpath.join(folder, "_temporary", _MANIFEST))
    # the commit: until now no reader sees a file
    store.move(posixpath.join(path, "_temporary", _MANIFEST), posixpath.join(path, _MANIFEST))
    store.delete_dir(posixpath.join(path, "_temporary"))  # what attempts that were lost left behind
    return spark.read.parquet(posixpath.join(folder, _MANIFEST))


def _splitters(records: DataFrame, shards: int) -> list[tuple]:
    """``shards - 1`` keys at most, from a sample that a hash of the rows draws: SAMPLE_A_SHARD for each range."""
    if shards == 1:
        return []
    name = fresh(records, "drawn")
    drawn = F.shiftrightunsigned(F.xxhash64("o", "sha256", "url", "chunk"), 1)
    top = (1 << 63) - 1
    bound = min(top, top * SAMPLE_A_SHARD * shards // max(1, records.count()))
    sample = records.withColumn(name, drawn).filter(F.col(name) <= F.lit(bound))
    keys = sorted(_Ranges.key(*r) for r in sample.select("o", "sha256", "url", "chunk").collect())  # bounded by MAX_SHARDS
    return [keys[len(keys) * i // shards] for i in range(1, shards)] if keys else []


# --------------------------------------------------------------------- reader --

_FIELDS = (
    "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, "
    "record_id string, payload binary"
)


def read_archive(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, record_id, payload for every record in ``folder``.

    Files are those of the manifest, read as streams, one record in memory at
    a time; sizes, file digests, block and payload digests are checked and a
    wrong one stops the job. Ids come back as text; a revisit has no payload,
    and none has without ``payloads``.
    """
    manifest = spark.read.parquet(posixpath.join(folder, _MANIFEST))

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                yield from _records(folder, row, payloads)
        release_memory()

    files = max(1, manifest.count())
    return manifest.repartition(min(files, MAX_SHARDS), "file").mapInArrow(read, _FIELDS)


class _Checked:
    """A file's bytes, digested as they are read."""

    def __init__(self, stream):
        self.stream, self.digest, self.size = stream, hashlib.sha256(), 0

    def read(self, n: int) -> bytes:
        data = self.stream.read(n)
        self.digest.update(data)
        self.size += len(data)
        return data


def _records(folder: str, row: dict, payloads: bool) -> Iterator[pa.RecordBatch]:
    store, path = _store(folder)
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, types[t]) for n, t in (f.split(" ") for f in _FIELDS.split(", "))])
    with store.open_input_stream(posixpath.join(path, row["file"]), compression=None) as stream:
        checked, held, size, records = _Checked(stream), [], 0, 0
        for raw in members(checked):
            found = parse_record(raw)
            if not payloads:
                found["payload"] = None
            held.append(found)
            records += 1
            size += 500 + len(found["payload"] or b"")
            if size > 4_000_000:
                yield pa.RecordBatch.from_pylist(held, schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)
    if (checked.digest.hexdigest(), checked.size, records) != (row["sha256"], row["bytes"], row["records"]):
        raise ValueError(f"{row['file']} is not the file that the manifest names")


def archive_pages(pages: DataFrame, min_revisit: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as read back from its archive.

    The archive is written to a new folder in the shared one. See
    ``write_archive`` for nulls, ties and repeated rows.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/llm-warc-{uuid.uuid4().hex}"
    write_archive(pages, folder, min_revisit=min_revisit)
    id_type = pages.schema["page_id"].dataType

    def back(c: str) -> Column:
        return F.col(c).cast(id_type).alias(c)

    return read_archive(spark, folder, payloads=False).select(
        back("page_id"), "payload_bytes", "payload_digest", "record_type", back("refers_to")
    )
