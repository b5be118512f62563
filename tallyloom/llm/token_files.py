"""Token ids in files of independent zstandard frames.

A file is
  - data frames: the ids of whole documents, one after another, about FRAME bytes a frame; a longer
    document has a frame of its own;
  - an index in a skippable frame: for each document its doc_id, a null mark and its number of ids;
  - a seek table in the last skippable frame, in the public seekable format: for each data frame
    its compressed size, its size, and the low 32 bits of the XXH64 of its content.
A reader takes the footer, the tables and then only the frames of the documents asked for.

Documents are dealt into ranges of doc_id and, within one, of a hash of the text, so file after file they are in ascending order. A task
writes its file under a new name and returns a row about it; the manifest holds the rows of the
tasks that Spark counted, so a retried task's leftovers are never read. The manifest has a row for
each file, and one sum over it gives where each file starts in the whole sequence of ids.

Null and empty texts have the end id only. Null doc_ids come first; rows that repeat a doc_id stay
separate, in the order of a hash of their texts. An empty table gives an empty manifest and no documents.
Other columns are ignored. A text is encoded whole, whatever its length.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .columns import slices
from .shared import shared_dir, stored
from .tokens import encoder

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX_MAGIC = 0x184D2A50
FRAME = 1 << 20
TEXTS_AT_ONCE = 1024
MANIFEST = "part long, file string, documents long, ids long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


class FrameWriter:
    """Writes documents to an open binary file; close() adds the tables."""

    def __init__(self, out, dtype: np.dtype, frame: int = FRAME, level: int = 3):
        self.out, self.dtype, self.frame = out, dtype, frame
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.seek: list[tuple[int, int, int]] = []
        self.doc_ids: list[int | None] = []
        self.sizes: list[int] = []
        self.held: list[bytes] = []
        self.n_held = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.n_held and self.n_held + len(ids) > self.frame:
            self.flush()
        self.held.append(ids)
        self.n_held += len(ids)
        self.doc_ids.append(doc_id)
        self.sizes.append(len(ids) // self.dtype.itemsize)

    def flush(self) -> None:
        data = b"".join(self.held)
        packed = self.zstd.compress(data)
        self.out.write(packed)
        self.seek.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.held, self.n_held = [], 0

    def close(self) -> None:
        if self.held:
            self.flush()
        null = np.array([x is None for x in self.doc_ids], "u1")
        index = np.array([x or 0 for x in self.doc_ids], "<i8").tobytes() + null.tobytes() + np.array(self.sizes, "<u8").tobytes()
        packed = struct.pack("<BQ", self.dtype.itemsize, len(self.sizes)) + zlib.compress(index, 1)
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(packed)) + packed)
        table = b"".join(struct.pack("<III", *x) for x in self.seek)
        footer = struct.pack("<IBI", len(self.seek), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + len(footer)) + table + footer)


class FrameReader:
    """Reads documents from an open, seekable binary file."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        end = source.tell()
        source.seek(end - 9)
        n, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table at the end of the file")
        source.seek(end - 9 - 12 * n)
        self.seek = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.seek[:, 0])]).astype(np.int64)
        source.seek(int(self.at[-1]))
        magic, size = struct.unpack("<II", source.read(8))
        packed = source.read(size)
        itemsize, docs = struct.unpack_from("<BQ", packed)
        index = zlib.decompress(packed[9:])
        self.dtype = np.dtype(f"<u{itemsize}")
        self.doc_ids = np.frombuffer(index, "<i8", docs)
        self.null = np.frombuffer(index, "u1", docs, 8 * docs).astype(bool)
        self.sizes = np.frombuffer(index, "<u8", docs, 9 * docs).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.frame_starts = np.concatenate([[0], np.cumsum(self.seek[:, 1])]).astype(np.int64) // itemsize
        self.decoded = 0  # frames that have been decompressed
        self._last: tuple[int, np.ndarray] | None = None

    def frame(self, k: int) -> np.ndarray:
        if self._last is None or self._last[0] != k:
            self.source.seek(int(self.at[k]))
            data = zstandard.ZstdDecompressor().decompress(self.source.read(int(self.seek[k, 0])), max_output_size=int(self.seek[k, 1]))
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.seek[k, 2]:
                raise ValueError(f"frame {k} doesn't match its checksum")
            self.decoded += 1
            self._last = k, np.frombuffer(data, self.dtype)
        return self._last[1]

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document of the file."""
        if not self.sizes[i]:
            return np.empty(0, self.dtype)
        k = int(np.searchsorted(self.frame_starts, self.starts[i], "right")) - 1
        at = int(self.starts[i] - self.frame_starts[k])
        return self.frame(k)[at : at + int(self.sizes[i])]

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The ids of each document with this doc_id; the ids in the file ascend after its nulls."""
        n = int(self.null.sum())
        lo, hi = (n + int(np.searchsorted(self.doc_ids[n:], doc_id, side)) for side in ("left", "right"))
        return [self.document(i) for i in range(lo, hi)]


def written(spark: SparkSession, docs: DataFrame, path: str, vocabulary: str, end_id: int, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Writes the documents to files below path; returns the manifest: part, file, documents, ids, start."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, False)
        end = np.array([end_id], enc.dtype).tobytes()
        where, base = fs.FileSystem.from_uri(path)
        where.create_dir(base)
        file, out, n_ids = f"{uuid4().hex}.tokens", None, 0
        for b in batches:
            for cut in slices(b, "text", TEXTS_AT_ONCE):
                ids, sizes = enc.batch(cut.column(1))
                n_ids += len(ids) + len(sizes)
                for doc_id, one in zip(cut.column(0).to_pylist(), np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
                    if out is None:
                        out = FrameWriter(where.open_output_stream(f"{base}/{file}"), enc.dtype)
                    out.add(doc_id, one.tobytes() + end)
        if out is not None:
            out.close()
            out.out.close()
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "file": [f"{path}/{file}"], "documents": pa.array([len(out.sizes)], pa.int64()), "ids": pa.array([n_ids], pa.int64())})

    # after the doc_id, so that rows with one id or none are many files too
    order = ["doc_id", "spread", "row"]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("spread"), F.monotonically_increasing_id().alias("row"))
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("spread", "row")
    manifest = stored(ranges.mapInArrow(write, MANIFEST), spark)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long"))


def read(manifest: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of the documents, or of those wanted, from the files; a task for each file."""

    def docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True):
                where, name = fs.FileSystem.from_uri(file)
                with where.open_input_file(name) as source:
                    r = FrameReader(source)
                    which = np.arange(len(r.sizes)) if wanted is None else np.flatnonzero(np.isin(r.doc_ids, wanted) & ~r.null)
                    crc = [zlib.crc32(r.document(int(i)).astype("<u4").tobytes()) for i in which]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(r.doc_ids[which], pa.int64(), mask=r.null[which]), "start": pa.array(start + r.starts[which], pa.int64()), "n_tokens": pa.array(r.sizes[which], pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    files = manifest.select("part", "file", "start")
    return files.repartitionByRange(max(1, files.count()), "part").mapInArrow(docs, READ)


def round_trip(spark: SparkSession, docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 1) -> DataFrame:
    """Writes all documents and reads them back."""
    return read(written(spark, docs, shared_dir(spark), vocabulary, end_id))
