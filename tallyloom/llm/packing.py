"""Lexical retrieval packing: sequences whose documents resemble each other.

1. Every document is encoded once, with its end id, and cut. Runs of `length` ids are sequences of
   their own; what is left of a document, its tail, goes on. Both are kept in the shared folder.
2. How many tails have each token id is counted over all tails; there are as many counts as the
   vocabulary has ids, which bounds what is sent to the tasks.
3. Tails are dealt into ranges by the two ids that weigh most in them, so that tails about the same
   things meet; a common id has as many ranges as it needs, as the document's hash comes after it.
   A task goes through its range in shards of SHARD tails. For each shard it builds an inverted
   index of BM25 weights. The first unused tail is the seed of a window; the index returns the
   unused tails by their score for the seed's ids, and they fill the window one after another.
   The one that doesn't fit is cut, and its rest is the next seed. An open window goes on into
   the next shard, so only a task's last window has padding.

Null and empty texts have the end id only. Rows that repeat a doc_id are packed each; null doc_ids
are allowed. An empty table gives no pieces. Other columns are ignored. The memory of a task is
bounded by the longest text and by SHARD tails.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import releasing, slices
from .shared import stored
from .tokens import encoder, ragged

SHARD = 1024
TEXTS_AT_ONCE, TAILS_AT_ONCE = 1024, 256
K1, B = 1.2, 0.75
PIECE = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _rows(rows: list[tuple], kinds: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def cut(docs: DataFrame, vocabulary: str, end_id: int, length: int, text: str, id_col: str) -> DataFrame:
    """The full pieces (with their sequence_id) and the tails (with their ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, True)
        end = np.array([end_id], enc.dtype)
        sequence = TaskContext.get().partitionId() << 40
        for b in batches:
            for part in slices(b, "text", TEXTS_AT_ONCE):
                ids, sizes = enc.batch(part.column(1))
                out = []
                for doc_id, one in zip(part.column(0).to_pylist(), np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
                    one = np.concatenate([one, end])
                    for start in range(0, len(one), length):
                        piece = one[start : start + length]
                        if full := len(piece) == length:
                            sequence += 1
                        out.append((doc_id, start, len(piece), crc32(piece) if full else None, len(one), 2 * sequence if full else None, 0, None if full else piece.tobytes()))
                yield _rows(out, [*PIECE, ("ids", pa.binary())])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(releasing(run), PIECES + ", ids binary")


def document_frequencies(tails: DataFrame, dtype: str) -> DataFrame:
    """id and n, the tails that have it; counted in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << 16 if dtype == "<u2" else 1 << 18, np.int64)
        for b in batches:
            for ids in b.column(0).to_pylist():
                u = np.unique(np.frombuffer(ids, dtype))
                if len(u) and u[-1] >= len(n):
                    n = np.concatenate([n, np.zeros(int(u[-1]) + 1 - len(n), np.int64)])
                n[u] += 1
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"id": pa.array(there, pa.int64()), "n": pa.array(n[there], pa.int64())})

    return tails.select("ids").mapInArrow(releasing(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


class Weights:
    """BM25 over the whole corpus of tails."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, tails: int, mean: float):
        self.idf = np.full(int(ids.max(initial=0)) + 1, np.log(1 + (tails + 0.5) / 0.5), np.float32)
        self.idf[ids] = np.log(1 + (tails - n + 0.5) / (n + 0.5))
        self.mean = mean

    def of(self, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Its distinct ids and their weights."""
        u, tf = np.unique(tail, return_counts=True)
        return u.astype(np.int64), self.idf[u] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(tail) / self.mean))

    def of_all(self, tails: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What of() gives for each tail, one after another, and where in it each tail begins, with the end."""
        sizes = np.fromiter(map(len, tails), np.int64, len(tails))
        bits = len(self.idf).bit_length()
        key, tf = np.unique(np.repeat(np.arange(len(tails)) << bits, sizes) | np.concatenate(tails), return_counts=True)
        owner, u = key >> bits, key & (1 << bits) - 1
        return u, self.idf[u] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[owner] / self.mean)), np.searchsorted(owner, np.arange(len(tails) + 1))

    def heaviest(self, tails: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The heaviest and the second heaviest id of each tail, the smaller first among equals; of a single id, this twice."""
        u, w, at = self.of_all(tails)
        out = []
        for _ in range(2):
            top = np.flatnonzero(w == np.repeat(np.maximum.reduceat(w, at[:-1]), np.diff(at)))
            top = top[np.searchsorted(top, at[:-1])]
            out.append(u[top])
            w[top] = -1
        return out[0], out[1]


class Shard:
    """An inverted index of some tails."""

    def __init__(self, tails: list[np.ndarray], weights: Weights):
        ids, weight, at = weights.of_all(tails)
        self.terms = np.split(ids, at[1:-1])
        order = np.argsort(ids.astype(tails[0].dtype), kind="stable")
        ids = ids[order]
        self.begin = np.flatnonzero(np.diff(ids, prepend=-1))
        self.ids, self.count = ids[self.begin], np.diff(self.begin, append=len(ids))
        self.tail = np.repeat(np.arange(len(tails)), np.diff(at))[order]
        self.weight = weight[order]
        self.unused = np.ones(len(tails), bool)

    def neighbours(self, query: np.ndarray) -> Iterator[int]:
        """Unused tails by falling score for these distinct ids, the earlier first among equals."""
        at = np.minimum(np.searchsorted(self.ids, query), len(self.ids) - 1)
        at = at[self.ids[at] == query]
        where = ragged(self.begin[at], self.count[at])
        score = np.bincount(self.tail[where], self.weight[where], len(self.unused))
        score[~self.unused] = -1
        while (best := int(np.argmax(score))) >= 0 and score[best] >= 0:
            yield best
            score[best] = -1


def pack_range(rows: Iterator[tuple], weights: Weights, length: int, sequence: int) -> Iterator[list[tuple]]:
    """rows: (doc_id, start, doc_tokens, ids) of tails. Yields lists of pieces."""
    room, query, out = 0, None, []

    def put(doc_id, start, doc_tokens, ids):
        nonlocal room, sequence
        if not room:
            sequence, room = sequence + 1, length
        out.append((doc_id, start, len(ids), crc32(ids), doc_tokens, 2 * sequence + 1, length - room))
        room -= len(ids)

    def shard(held: list[tuple]):
        nonlocal query
        index, rest = Shard([t[3] for t in held], weights), None
        seed = 0
        while True:
            if not room:  # a new window: the rest of the last cut, or the first unused tail
                if rest is not None:
                    k, part = rest
                    rest = None
                    put(held[k][0], held[k][1] + len(held[k][3]) - len(part), held[k][2], part)
                    query = index.terms[k]
                else:
                    while seed < len(held) and not index.unused[seed]:
                        seed += 1
                    if seed == len(held):
                        return
                    index.unused[seed] = False
                    put(*held[seed])
                    query = index.terms[seed]
            for k in index.neighbours(query):
                doc_id, start, doc_tokens, ids = held[k]
                index.unused[k] = False
                now = ids[:room]
                put(doc_id, start, doc_tokens, now)
                if len(now) < len(ids):
                    rest = k, ids[len(now) :]
                if not room:
                    break
            else:
                return

    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == SHARD:
            shard(held)
            yield out
            held, out = [], []
    if held:
        shard(held)
    yield out


def packed(spark: SparkSession, docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, length: int = 1024, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    dtype = encoder(vocabulary, True).dtype.str
    pieces = stored(cut(docs, vocabulary, end_id, length, text, id_col), spark)
    full, tails = pieces.where("ids is null").drop("ids"), pieces.where("ids is not null").select("doc_id", "start", "doc_tokens", "length", "ids")
    n = document_frequencies(tails, dtype).toPandas()  # as many rows as the vocabulary at most
    sizes = tails.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
    weights = spark.sparkContext.broadcast(Weights(n["id"].to_numpy(np.int64), n["n"].to_numpy(np.float64), sizes["n"], sizes["mean"] or 1.0))

    def heaviest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "ids", TAILS_AT_ONCE):
                keys = weights.value.heaviest([np.frombuffer(ids, dtype) for ids in part.column("ids").to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(k, pa.int64()) for k in keys)], [*part.schema.names, "key1", "key2"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                ids = (np.frombuffer(x, dtype) for x in b.column("ids").to_pylist())
                yield from zip(b.column("doc_id").to_pylist(), b.column("start").to_pylist(), b.column("doc_tokens").to_pylist(), ids, strict=True)

        for out in pack_range(rows(), weights.value, length, TaskContext.get().partitionId() << 40):
            yield _rows(out, PIECE)

    keyed = tails.mapInArrow(releasing(heaviest), "doc_id long, start long, doc_tokens long, length long, ids binary, key1 long, key2 long")
    keyed = keyed.withColumn("spread", F.xxhash64("doc_id", "ids"))
    order = ["key1", "key2", "spread"]
    ranges = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    return full.unionByName(ranges.drop(*order, "length").mapInArrow(releasing(pack), PIECES))
