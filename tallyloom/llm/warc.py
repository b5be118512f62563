"""WARC files as a PySpark data source, and the archive job around it.

Reading. `partitions` plans whole files into partitions of about TARGET bytes. `pushFilters` takes
the equality, membership and prefix predicates on header columns that every record can answer from
its headers. A partition's reader parses a record's headers first; if they fail a predicate, or
the payload isn't wanted (option payload=false), the payload is stepped over without decoding:
each record is a gzip member of its own that names its compressed length in an extra field. Members
of other writers, without that field, are decompressed to find their end, but not decoded.

Writing. A task writes its records to a file under a new name and hands the name to the driver; the
commit lists the files of the tasks that Spark counted in a `_files-*` list, which readers go by.
Leftovers of failed tasks are in no list. A folder without lists is read as plain *.warc[.gz] files.

The job. Of the records with equal payloads of at least `least` bytes the one with the smallest
page_id is a response, the others are revisits that refer to it. Groups are counted with partial
sums; in the join back rows of very common payloads are spread over the tasks.

Nulls, repeats and other cases: a null html is an empty payload. A null url is written as an empty
target. Of rows that repeat the page_id of a response, the first in the order of their urls is the
response and the others refer to it. A null page_id comes last in its group. An empty table gives
no records. Other columns are ignored. Control characters of a url are percent-encoded in its
header. A damaged record (no end of its headers, no usable Content-Length, cut off) is an error
that names the file and the place; with option damaged=skip its gzip member is passed over, and in
a plain file all until the next line that begins a record. A header that should be a number and
isn't is null.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    StringStartsWith,
    WriterCommitMessage,
)

from .shared import heavy_keys, shared_dir, spread_join, stored

TARGET = 64 << 20
BATCH = 16 << 20
MEMBER = struct.Struct("<4sIBBH2sHII")  # a gzip header with an extra field "sl": compressed and plain length
#: Column of the source: header of a record.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "page_id": "X-Page-ID", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "payload_bytes": "X-Payload-Length"}
SCHEMA = "record_type string, record_id string, target_uri string, page_id long, payload_digest string, refers_to string, payload_bytes long, payload binary"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def packed(record: bytes, level: int = 5) -> bytes:
    """A gzip member that names its lengths."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush()
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    return MEMBER.pack(b"\x1f\x8b\x08\x04", 0, 0, 255, 12, b"sl", 8, MEMBER.size + len(body) + 8, len(record) & 0xFFFFFFFF) + body + tail


def record(headers: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parsed(head: bytes) -> dict[str, str]:
    """Header lines of a record by lower-case name."""
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


class Damaged(ValueError):
    """A record that can't be read."""


def _length(h: dict[str, str], at: int) -> int:
    if not h.get("content-length", "").isdecimal():
        raise Damaged(f"no Content-Length in the record at {at}")
    return int(h["content-length"])


class Records:
    """Goes through a file's records: each gives its headers, and its block if it is asked for.

    skip: damaged records are passed over and counted in `skipped`.
    """

    def __init__(self, source, zipped: bool, skip: bool = False):
        self.source, self.zipped, self.skip, self.decoded, self.skipped = source, zipped, skip, 0, 0

    def __iter__(self) -> Iterator[tuple[dict[str, str], callable]]:
        return self._members() if self.zipped else self._plain()

    def _passed_over(self, e: Damaged) -> None:
        if not self.skip:
            raise e
        self.skipped += 1

    def _plain(self):
        at = 0
        while head := self._head_at(at):
            try:
                if b"\r\n\r\n" not in head or not head.startswith(b"WARC/"):
                    raise Damaged(f"no headers at {at}")
                head = head[: head.index(b"\r\n\r\n")]
                h = parsed(head)
                begin, n = at + len(head) + 4, _length(h, at)
            except Damaged as e:
                self._passed_over(e)
                at = self._next_begin(at + 1)
                continue

            def block(begin=begin, n=n) -> bytes:
                self.decoded += 1
                self.source.seek(begin)
                return self.source.read(n)

            yield h, block
            at = begin + n + 4

    def _head_at(self, at: int) -> bytes:
        """The bytes from there to the end of the headers at least, or all that are left."""
        self.source.seek(at)
        got = b""
        while b"\r\n\r\n" not in got:
            more = self.source.read(4096)
            if not more:
                break
            got += more
        return got

    def _next_begin(self, at: int) -> int:
        """Where the next line begins that begins a record, or the file's end."""
        mark, got = b"\r\nWARC/", b""
        self.source.seek(at)
        while more := self.source.read(1 << 16):
            got = got[-len(mark) :] + more
            at += len(more)
            if mark in got:
                return at - len(got) + got.index(mark) + 2
        return at

    def _members(self):
        at = 0
        while True:
            self.source.seek(at)
            first = self.source.read(4096)
            if len(first) < 18:
                return
            named = first[:4] == b"\x1f\x8b\x08\x04" and first[12:14] == b"sl"
            state = {"z": zlib.decompressobj(31), "plain": b"", "raw": first}

            def grow(most: int, state=state) -> bool:
                """Decompresses some more; False at the member's end."""
                z = state["z"]
                more = state["raw"] or z.unconsumed_tail or self.source.read(1 << 16)
                state["raw"] = b""
                if z.eof or not more:
                    return False
                try:
                    state["plain"] += z.decompress(more, most)
                except zlib.error as e:
                    raise Damaged(str(e)) from e
                return True

            def finish(state=state, grow=grow) -> None:
                while not state["z"].eof:
                    if not grow(1 << 16):
                        raise Damaged("a gzip member is cut off")

            try:
                while b"\r\n\r\n" not in state["plain"] and grow(4096):
                    pass
                if b"\r\n\r\n" not in state["plain"]:
                    raise Damaged(f"no headers in the member at {at}")
                cut = state["plain"].index(b"\r\n\r\n")
                h = parsed(state["plain"][:cut])
                n = _length(h, at)

                def block(cut=cut, n=n, state=state, finish=finish) -> bytes:
                    self.decoded += 1
                    finish()
                    return state["plain"][cut + 4 : cut + 4 + n]

                yield h, block
            except Damaged as e:
                self._passed_over(e)
            if named:
                at += struct.unpack_from("<I", first, 16)[0]
                continue
            try:
                finish()
            except Damaged as e:  # where the next member begins isn't known
                self._passed_over(e)
                return
            at = self.source.tell() - len(state["z"].unused_data)


@dataclass
class Files(InputPartition):
    names: list[str]


def _matches(h: dict[str, str | int | None], filters: list) -> bool:
    for f in filters:
        have = h[f.attribute[0]]
        if isinstance(f, EqualTo):
            ok = have is not None and have == f.value
        elif isinstance(f, In):
            ok = have is not None and have in f.value
        else:
            ok = have is not None and have.startswith(f.value)
        if not ok:
            return False
    return True


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.target = int(options.get("target", TARGET))
        self.skip = options.get("damaged", "fail").lower() == "skip"
        self.filters: list = []

    def pushFilters(self, filters: list):
        for f in filters:
            if isinstance(f, EqualTo | In | StringStartsWith) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        where, base = fs.FileSystem.from_uri(self.path)
        there = [i for i in where.get_file_info(fs.FileSelector(base)) if i.is_file]
        lists = [i for i in there if i.base_name.startswith("_files-")]
        if lists:
            sized = sorted((f"{base}/{n}", s) for i in lists for n, s in json.loads(where.open_input_stream(i.path).read()))
        else:
            sized = sorted((i.path, i.size) for i in there if i.base_name.endswith((".warc", ".warc.gz")))
        out, room = [], 0
        for name, n in sized:
            if not out or room < n:
                out.append(Files([]))
                room = self.target
            out[-1].names.append(name)
            room -= n
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        where, _ = fs.FileSystem.from_uri(self.path)
        rows, held = [], 0
        for name in partition.names:
            with where.open_input_file(name) as source:
                try:
                    for h, block in Records(source, name.endswith(".gz"), self.skip):
                        got = {c: h.get(k.lower()) for c, k in HEADERS.items()}
                        for c in ("page_id", "payload_bytes"):
                            got[c] = int(got[c]) if re.fullmatch(r"-?[0-9]{1,18}", got[c] or "") else None
                        if not _matches(got, self.filters):
                            continue
                        got["payload"] = None
                        if self.payload and got["record_type"] == "response":
                            try:
                                _, _, got["payload"] = block().partition(b"\r\n\r\n")
                            except Damaged:
                                if not self.skip:
                                    raise
                                continue
                        held += len(got["payload"] or b"") + 200
                        rows.append(got)
                        if held >= BATCH:
                            yield self.batch(rows)
                            rows, held = [], 0
                except Damaged as e:
                    raise Damaged(f"{name}: {e}") from e
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[dict]) -> pa.RecordBatch:
        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
        names = [*HEADERS, "payload"]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in names], names)


@dataclass
class Wrote(WriterCommitMessage):
    file: str | None
    size: int


class WarcWriter(DataSourceArrowWriter):
    """Writes rows of record_type, page_id, target_uri, payload_digest, payload_bytes, refers_to, html."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Wrote:
        where, base = fs.FileSystem.from_uri(self.path)
        name, out, size = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for b in batches:
            for row in b.to_pylist():
                if out is None:
                    where.create_dir(base)
                    out = where.open_output_stream(f"{base}/{name}", compression=None)
                data = packed(self.one(row))
                out.write(data)
                size += len(data)
        if out is None:
            return Wrote(None, 0)
        out.close()
        return Wrote(name, size)

    @staticmethod
    def one(row: dict) -> bytes:
        h = {"WARC-Type": row["record_type"], "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": "2000-01-01T00:00:00Z", "WARC-Target-URI": re.sub(r"[\x00-\x1f\x7f]", lambda x: f"%{ord(x[0]):02X}", row["target_uri"] or ""), "WARC-Payload-Digest": f"sha1:{row['payload_digest']}", "X-Payload-Length": str(row["payload_bytes"])}
        if row["page_id"] is not None:
            h["X-Page-ID"] = str(row["page_id"])
        head = HTTP.format(row["payload_bytes"]).encode()
        if row["record_type"] == "revisit":
            h |= {"WARC-Refers-To": f"<urn:page:{row['refers_to']}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
            return record(h | {"Content-Type": "application/http; msgtype=response"}, head)
        return record(h | {"Content-Type": "application/http; msgtype=response"}, head + (row["html"] or "").encode())

    def commit(self, messages: list[Wrote | None]) -> None:
        where, base = fs.FileSystem.from_uri(self.path)
        where.create_dir(base)
        with where.open_output_stream(f"{base}/_files-{uuid.uuid4().hex}") as out:
            out.write(json.dumps([[m.file, m.size] for m in messages if m and m.file]).encode())

    def abort(self, messages: list[Wrote | None]) -> None:
        where, base = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m and m.file:
                where.delete_file(f"{base}/{m.file}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def planned(pages: DataFrame, least: int = 0, html: str = "html", id_col: str = "page_id", url: str = "url") -> DataFrame:
    """The records to write: a response or a revisit for each row of pages. Rows of very common payloads are spread over the tasks."""
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).alias("target_uri"), body.alias("html"), F.sha1(body).alias("_sha1"), F.octet_length(body).cast("long").alias("payload_bytes"))
    # a null page_id is the last; of repeated page_ids the first by url stays
    rank = F.struct(F.col("page_id").isNull().alias("a"), F.col("page_id").alias("b"), F.coalesce("target_uri", F.lit("")).alias("c"))
    counted = stored(rows.withColumn("rank", rank).groupBy("_sha1").agg(F.min("rank").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1"), pages.sparkSession)
    heavy = heavy_keys(counted, "_sha1", "_n", pages.count())
    joined = spread_join(rows, counted.drop("_n"), "_sha1", heavy)
    own = F.col("_first").isNull() | (F.col("payload_bytes") < least) | (rank == F.col("_first"))
    return joined.select(
        F.when(own, "response").otherwise("revisit").alias("record_type"),
        "page_id",
        "target_uri",
        F.col("_sha1").alias("payload_digest"),
        "payload_bytes",
        F.when(~own, F.col("_first")["b"]).alias("refers_to"),
        F.when(own, F.col("html")).alias("html"),
    )


def base32_of_hex(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows with payload_digest, 40 hex digits, as upper-case base32."""
    for b in batches:
        k = b.schema.get_field_index("payload_digest")
        digests = [base64.b32encode(bytes.fromhex(x)).decode() for x in b.column(k).to_pylist()]
        yield b.set_column(k, "payload_digest", pa.array(digests, pa.string()))


def archived(spark: SparkSession, pages: DataFrame, path: str, least: int = 0) -> None:
    """Writes the pages to WARC files below path."""
    spark.dataSource.register(WarcSource)
    plan = planned(pages, least)
    plan.mapInArrow(base32_of_hex, plan.schema).write.format("warc").mode("append").save(path)


def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_id, length and SHA-1 of payloads as they were read; revisits, without a payload, have those of their headers."""
    for b in batches:
        n, digest = b.column("payload_bytes").to_pylist(), b.column("payload_digest").to_pylist()
        for i, p in enumerate(b.column("payload").to_pylist()):
            if p is not None:
                n[i], digest[i] = len(p), "sha1:" + base64.b32encode(hashlib.sha1(p).digest()).decode()
        yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(n, pa.int64()), pa.array([x.removeprefix("sha1:") for x in digest], pa.string()), b.column("record_type"), b.column("refers_to")], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def round_trip(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes the pages and reads the archives back in one scan of both types of records: payloads of
    the responses are decoded and digested anew, revisits are read by their headers alone."""
    path = shared_dir(spark)
    archived(spark, pages, path, least)
    with pushed_filters(spark):
        both = spark.read.format("warc").option("path", path).load().where(F.col("record_type").isin("response", "revisit"))
        read = stored(both.mapInArrow(digested, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to string"), spark)
    return read.withColumn("refers_to", F.regexp_extract("refers_to", r"^<urn:page:(-?\d+)>$", 1).try_cast("long"))


@contextmanager
def pushed_filters(spark: SparkSession):
    """Inside, Spark hands predicates to sources written in Python; after it the session is as before."""
    name = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)
