"""A Brown class-based bigram model over the whole corpus.

1. Tasks gather documents into blocks of about BLOCK bytes. A block has its distinct words once (by
   64-bit hash, in order) and each document as positions in that list. What goes between tasks
   later are a block's words, cut by ranges of hashes into buckets, as arrays; never its tokens
   by row. Buckets grow in number with the words, so a task's share is bounded.
2. A bucket's task counts its words over all training documents and answers each block with the
   counts of the block's words. No vocabulary is broadcast or collected.
3. Every word gets a unit: each of the `top` most frequent words is a unit, the others share a unit
   with the words whose counts lie between the same powers of two; words seen once, unknown words
   and the text's end have units of their own.
4. Pairs of neighbouring units are counted over all training documents. Their number is bounded by
   the square of the units, so is what one task gets for the exchange clustering: each of the top
   words moves to the class that most raises the classes' mutual information, again and again
   until a sweep raises it by less than STILL of itself or `sweeps` are over. Then every other word seen `enough` times goes to
   the class that most raises it, by the classes before and after the word, which are counted over
   all training documents; a bucket's task does so for its words, all at once, in rounds until at
   most SETTLED of them move, the mutual information grows by less than GAIN of itself, or ROUNDS
   are over. Top words and classes grow with the types. Only rarer words stay in the units by
   counts, which are classes as they are.
5. log P(text) = sum of log P(class | class before) + log P(word | class). Transitions are
   smoothed towards the classes' shares. Words seen once and unknown words are one class, split as
   Good and Turing's estimate splits it; the unknown word is one word, as in the base score.

Words: A-Z lower-cased, white space parts them; a text ends with an end token, which comes before
its first word too. A null or empty text is its end token. Rows with a repeated doc_id are scored
each; a null doc_id is a training row. An empty table gives no rows; without training rows every
word is unknown. Other columns are ignored. A text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import lowered, parted
from .shared import removed, shared_dir, spread, stored

BLOCK = 16 << 20
BUCKET_WORDS, BUCKETS = 1 << 20, 32  # words of all blocks in a bucket, and the least number of buckets
TOP, CLASSES, SWEEPS = 2048, 64, 30  # the least of the first two; a bound that ends what does not settle
ENOUGH, ROUNDS, SETTLED, GAIN, STILL = 10, 3, 0.02, 0.01, 0.002
BANDS = 62
PRIOR = 2.0
AT_ONCE = 1 << 21  # numbers in an array of classes by neighbours
END_HASH = np.uint64(xxhash.xxh64_intdigest(b""))  # no word is empty
PARTS = 32  # ranges of unit pairs that are summed apart
BLOCKS = "block long, doc_ids array<long>, held array<boolean>, sizes array<int>, tokens binary, order binary, hashes binary, trained binary, n_words long"
READY = "block long, doc_ids array<long>, held array<boolean>, sizes array<int>, n_known array<long>, base array<double>, log_counts array<double>, tokens binary, unit binary, movable binary, words binary, end int"
ANSWERS = "block long, bucket int, data binary, words binary, tokens long, types long, once long, twice long"
NEAR = "bucket int, block long, words binary, was binary, size binary, keys binary, n binary"
CLASSED = "block long, bucket int, data binary, n long, moved long"
PAIRS = "part int, codes binary, n binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def packed(x: np.ndarray) -> bytes:
    """An array as compressed bytes, its numbers' first bytes first."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, dtype: str) -> np.ndarray:
    planes, width = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), np.dtype(dtype).itemsize
    return np.ascontiguousarray(planes.reshape(width, len(planes) // width).T).ravel().view(dtype)


def held_out(id_col: str, rest: int = 1, of: int = 5) -> Column:
    """Whether crc32 of the id as text leaves this rest; a null id never does."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % of == rest, F.lit(False))


def tokenized(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct tokens, ascending; the tokens as positions among them; the tokens of each text."""
    names, words, sizes = parted(lowered(texts))
    hashes = np.array([xxhash.xxh64_intdigest(x) for x in names.to_pylist()] + [0], np.uint64)
    hashes[-1] = END_HASH
    tokens = np.insert(words, np.cumsum(sizes), len(names))
    there = np.flatnonzero(np.bincount(tokens, minlength=len(hashes)))  # not the empty string
    there = there[np.argsort(hashes[there])]
    place = np.zeros(len(hashes), np.int64)
    place[there] = np.arange(len(there))
    return hashes[there], place[tokens], sizes + 1


def blocks(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """Blocks of documents in the order in which a task reads them."""

    def emit(part: list[pa.RecordBatch], block: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(part)
        hashes, tokens, sizes = tokenized(t.column("text").combine_chunks() if t.num_rows else pa.array([], pa.string()))
        held = t.column("held").to_pylist()
        trained = np.bincount(tokens[np.repeat(~np.array(held, bool), sizes)], minlength=len(hashes))
        order = np.argsort(-np.bincount(tokens, minlength=len(hashes)), kind="stable")  # small numbers for frequent words
        rank = np.empty(len(order), "<u4")
        rank[order] = np.arange(len(order))
        return pa.RecordBatch.from_pydict({
            "block": [block], "doc_ids": pa.array([t.column("doc_id").to_pylist()], pa.list_(pa.int64())), "held": [held],
            "sizes": pa.array([sizes], pa.list_(pa.int32())), "tokens": [packed(rank[tokens])], "order": [packed(order.astype("<u4"))],
            "hashes": [hashes.tobytes()], "trained": [packed(trained.astype("<u4"))], "n_words": [len(hashes)],
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, part, size = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            lengths = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False)
            lo = 0
            for hi in range(1, b.num_rows + 1):
                size += int(lengths[hi - 1])
                if size >= BLOCK or hi == b.num_rows:
                    part.append(b.slice(lo, hi - lo))
                    lo = hi
                if size >= BLOCK:
                    yield emit(part, block)
                    block, part, size = block + 1, [], 0
        if part:
            yield emit(part, block)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held"), F.col(text).alias("text"))
    return rows.mapInArrow(run, BLOCKS)


def bucket_ends(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's stretch of ascending hashes ends; a bucket is a range of the hashes' space."""
    edges = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)
    return np.append(np.searchsorted(hashes, edges), len(hashes))


def cut(ends: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """(bucket, its stretch of each array) of the buckets that have any."""
    for bucket, (lo, hi) in enumerate(zip(np.append(0, ends[:-1]), ends, strict=True)):
        if hi > lo:
            yield bucket, *(x[lo:hi] for x in arrays)


def joined(column: pa.ChunkedArray, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The packed arrays of a column, one after another, and where they end."""
    arrays = [unpacked(x, dtype) for x in column.to_pylist()]
    return np.concatenate([np.empty(0, dtype), *arrays]), np.cumsum([len(x) for x in arrays], dtype=np.int64)


def counted(of: DataFrame, buckets: int) -> DataFrame:
    """For each block and bucket the counts of the block's words over all training documents (data); for each
    bucket, with a null block, its words (words), their counts (data), tokens, types, once and twice."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, h, n in zip(*(b.column(c).to_pylist() for c in ("block", "hashes", "trained")), strict=True):
                h, n = np.frombuffer(h, "<u8"), unpacked(n, "<u4")
                rows = [(k, packed(x), packed(y)) for k, x, y in cut(bucket_ends(h, buckets), h, n)]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([r[0] for r in rows], pa.int32()), "block": [block] * len(rows), "hashes": [r[1] for r in rows], "trained": [r[2] for r in rows]})

    def count(t: pa.Table) -> pa.Table:
        words, ends = joined(t.column("hashes"), "<u8")
        word, at = np.unique(words, return_inverse=True)
        n = np.bincount(at, joined(t.column("trained"), "<u4")[0], len(word)).astype(np.int64)
        each, bucket, is_end = ends[:-1], t.column("bucket")[0].as_py(), word == END_HASH
        known, rows, zero = n > 0, t.num_rows, [0] * t.num_rows
        return pa.table({
            "block": pa.array([*t.column("block").to_pylist(), None], pa.int64()), "bucket": pa.array([bucket] * (rows + 1), pa.int32()),
            "data": [*(packed(x) for x in np.split(n[at], each)), packed(n[known])], "words": [*[None] * rows, packed(word[known])],
            "tokens": [*zero, int(n.sum())], "types": [*zero, int(known.sum())], "once": [*zero, int(((n == 1) & ~is_end).sum())], "twice": [*zero, int(((n == 2) & ~is_end).sum())],
        })

    return of.select("block", "hashes", "trained").mapInArrow(parts, "bucket int, block long, hashes binary, trained binary").groupBy("bucket").applyInArrow(count, ANSWERS)


def most_frequent(dictionaries: DataFrame, top: int) -> DataFrame:
    """word and c of the `top` most frequent words, the most frequent first; each bucket gives as many at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for word, n in zip(b.column("words").to_pylist(), b.column("data").to_pylist(), strict=True):
                word, n = unpacked(word, "<u8"), unpacked(n, "<i8")
                best = np.lexsort((word, -n))[: top + 1]
                best = best[word[best] != END_HASH]
                yield pa.RecordBatch.from_pydict({"word": word[best].view(np.int64), "c": n[best]})

    return dictionaries.select("words", "data").mapInArrow(run, "word long, c long").orderBy(F.desc("c"), "word").limit(top)


@dataclass(frozen=True)
class Counts:
    """What is known of all training tokens; words: hashes of the top words, the most frequent first."""

    tokens: int
    types: int
    once: int
    twice: int
    words: np.ndarray

    @property
    def class_unit(self) -> int:
        """The unit of the first class; words beyond the top ones have their class's unit."""
        return len(self.words) + BANDS + 2

    @property
    def once_unit(self) -> int:
        return len(self.words)

    @property
    def end_unit(self) -> int:
        return len(self.words) + BANDS

    @property
    def unknown_unit(self) -> int:
        return len(self.words) + BANDS + 1

    def units(self, word: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The unit of each word, from its hash and its training count."""
        out = np.where(n > 0, self.once_unit + np.log2(np.maximum(n, 1)).astype(np.int64), self.unknown_unit)
        if len(self.words):
            order = np.argsort(self.words)
            at = order[np.minimum(np.searchsorted(self.words, word, sorter=order), len(order) - 1)]
            out = np.where(self.words[at] == word, at, out)
        out[word == END_HASH] = self.end_unit
        return out


def with_units(of: DataFrame, answers: DataFrame, counts: Counts, enough: int) -> DataFrame:
    """The blocks with their words' units, the hashes of the words that get a class in rounds, and the sums of
    each document that need its words' counts."""

    def run(got: pa.Table, block: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        n, _ = joined(got.sort_by("bucket").column("data"), "<i8")
        hashes, order, tokens = np.frombuffer(row["hashes"], "<u8"), unpacked(row["order"], "<u4"), unpacked(row["tokens"], "<u4")
        unit, sizes = counts.units(hashes, n), np.array(row["sizes"], np.int64)
        rank = np.empty(len(order), "<u4")
        rank[order] = np.arange(len(order))
        movable = np.flatnonzero((n >= enough) & (unit >= len(counts.words)) & (hashes != END_HASH))
        begins = np.cumsum(sizes) - sizes
        each = lambda v: np.add.reduceat(v[order][tokens], begins)  # noqa: E731  every document has an end token
        lists = {"n_known": (each((n > 0).astype(np.int64)), pa.int64()), "base": (each(np.log10(n + 0.5)), pa.float64()), "log_counts": (each(np.log10(np.maximum(n, 1))), pa.float64())}
        return pa.table({
            **{c: block.column(c) for c in ("block", "doc_ids", "held", "sizes")}, **{c: pa.array([x], pa.list_(kind)) for c, (x, kind) in lists.items()},
            "tokens": block.column("tokens"), "unit": [packed(unit[order].astype("<u2"))], "movable": [packed(rank[movable])], "words": [hashes[movable].tobytes()],
            "end": pa.array([int(rank[np.searchsorted(hashes, END_HASH)])], pa.int32()),
        })

    return answers.select("block", "bucket", "data").groupBy("block").cogroup(of.drop("trained", "n_words").groupBy("block")).applyInArrow(run, READY)


class Block:
    """A block's arrays; classes: what assigned() has for it, or none."""

    def __init__(self, row: dict, counts: Counts, classes: pa.Table | None = None):
        self.block, self.end = row["block"], row["end"]
        self.tokens, self.sizes = unpacked(row["tokens"], "<u4"), np.array(row["sizes"], np.int64)
        self.train = np.repeat(~np.array(row["held"], bool), self.sizes)
        self.unit, self.movable, self.words = unpacked(row["unit"], "<u2").astype(np.int64), unpacked(row["movable"], "<u4"), np.frombuffer(row["words"], "<u8")
        if classes is not None and classes.num_rows:
            self.unit[self.movable] = counts.class_unit + joined(classes.sort_by("bucket").column("data"), "<i2")[0]

    def before(self) -> np.ndarray:
        """The token before each token; a text's last one is the end, too."""
        return np.append(np.array([self.end], self.tokens.dtype), self.tokens[:-1])

    def pairs(self) -> np.ndarray:
        """Each pair of neighbouring units of the training documents as a number."""
        return self.unit[self.before()[self.train]] << 16 | self.unit[self.tokens[self.train]]


def neighbours(b: Block, every: np.ndarray, total: int, buckets: int) -> list[tuple]:
    """A row of NEAR for each bucket, with the block's movable words there: their classes (was) and how often (n) class
    key follows, class key - total comes before, or, for key 2 * total, the word follows itself; size: the keys of each word."""
    kind, width = every[b.unit], 2 * total + 1
    place = np.full(len(b.unit), -1)
    place[b.movable] = np.arange(len(b.movable))
    x, y = b.before()[b.train], b.tokens[b.train]
    px, py, kx, ky = place[x], place[y], kind[x], kind[y]
    same = x == y
    right, left, own = (px >= 0) & ~same, (py >= 0) & ~same, (px >= 0) & same
    codes, n = np.unique(np.concatenate([px[right] * width + ky[right], py[left] * width + total + kx[left], px[own] * width + 2 * total]), return_counts=True)
    size = np.bincount(codes // width, minlength=len(b.movable))
    end = np.append(0, np.cumsum(size))
    keys, n = (codes % width).astype("<u2"), n.astype("<u4")
    was, size = kind[b.movable].astype("<i2"), size.astype("<u4")
    rows = []
    for bucket, at in cut(bucket_ends(b.words, buckets), np.arange(len(b.words))):
        lo, hi = at[0], at[-1] + 1
        rows.append((bucket, b.block, packed(b.words[lo:hi]), packed(was[lo:hi]), packed(size[lo:hi]), packed(keys[end[lo] : end[hi]]), packed(n[end[lo] : end[hi]])))
    return rows


def near_rows(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 7
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "block", "words", "was", "size", "keys", "n"])


def assigned(near: DataFrame, pairs: np.ndarray, classes: int) -> DataFrame:
    """For each block and bucket the new classes of the block's movable words (data); for each bucket, with a
    null block, how many words it has and how many of them move."""
    width = 2 * len(pairs) + 1

    def run(t: pa.Table) -> pa.Table:
        words, ends = joined(t.column("words"), "<u8")
        word, first, at = np.unique(words, return_index=True, return_inverse=True)
        was = joined(t.column("was"), "<i2")[0][first].astype(np.int64)
        code = np.repeat(at, joined(t.column("size"), "<u4")[0]) * width + joined(t.column("keys"), "<u2")[0]
        code, entry = np.unique(code, return_inverse=True)
        new = best_classes(pairs, classes, was, code // width, code % width, np.bincount(entry, joined(t.column("n"), "<u4")[0], len(code)))
        rows = t.num_rows
        return pa.table({
            "block": pa.array([*t.column("block").to_pylist(), None], pa.int64()), "bucket": pa.array([t.column("bucket")[0].as_py()] * (rows + 1), pa.int32()),
            "data": [*(packed(x) for x in np.split(new[at].astype("<i2"), ends[:-1])), None], "n": [*[0] * rows, len(word)], "moved": [*[0] * rows, int((new != was).sum())],
        })

    return near.groupBy("bucket").applyInArrow(run, CLASSED)


def in_parts(codes: np.ndarray, n: np.ndarray) -> list[tuple]:
    """Ascending codes of pairs and their counts in PARTS stretches, by a hash of the first unit."""
    part = (codes >> 16) * 7919 % PARTS
    return [(int(k), packed(codes[part == k]), packed(n[part == k])) for k in np.unique(part)]


def part_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], ["part", "codes", "n"])


def unit_pairs(ready: DataFrame, counts: Counts) -> DataFrame:
    """part, codes, n: how often unit code & 0xffff comes after unit code >> 16 in a task's training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                seen.append(np.unique(Block(row, counts).pairs(), return_counts=True))
                if sum(len(k) for k, _ in seen) > 1 << 22:
                    seen = [summed(seen)]
        if seen:
            yield part_rows(in_parts(*summed(seen)))

    return ready.select("block", "held", "sizes", "tokens", "unit", "movable", "words", "end").mapInArrow(run, PAIRS)


def summed(counted: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, ascending, and their counts in all."""
    keys, at = np.unique(np.concatenate([k for k, _ in counted]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in counted])).astype(np.int64)


def by_block(ready: DataFrame, classes: DataFrame):
    """Each block with the classes of its movable words."""
    return classes.where("block is not null").select("block", "bucket", "data").groupBy("block").cogroup(ready.groupBy("block"))


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def put(pairs: np.ndarray, cls: int, right: np.ndarray, left: np.ndarray, own: float) -> None:
    """Adds a word's neighbours to those of a class."""
    pairs[cls] += right
    pairs[:, cls] += left
    pairs[cls, cls] += own


def gains(pairs: np.ndarray, right: np.ndarray, left: np.ndarray, own: float, classes: int, logs: np.ndarray | None = None) -> np.ndarray:
    """What each class adds to the mutual information if a word joins it that pairs lacks; logs: _f(pairs)."""
    logs = _f(pairs) if logs is None else logs
    r, c = np.flatnonzero(right), np.flatnonzero(left)
    gain = (_f(pairs[:classes, r] + right[r]) - logs[:classes, r]).sum(1) + (_f(pairs[c, :classes] + left[c][:, None]) - logs[c, :classes]).sum(0)
    d, of_d = np.diagonal(pairs)[:classes], np.diagonal(logs)[:classes]
    gain += _f(d + right[:classes] + left[:classes] + own) + of_d - _f(d + right[:classes]) - _f(d + left[:classes])
    out, into = pairs[:classes].sum(1), pairs[:, :classes].sum(0)
    return gain - (_f(out + right.sum() + own) - _f(out) + _f(into + left.sum() + own) - _f(into))


def best_classes(pairs: np.ndarray, classes: int, was: np.ndarray, word: np.ndarray, key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The class of each word that most raises the mutual information when it alone moves; was: their classes.
    word, key, n: the words' neighbours as in neighbours(), by ascending word and key. As gains(), for many words at once."""
    total, logs, new = len(pairs), _f(pairs), was.copy()
    out, into, diagonal = pairs[:classes].sum(1), pairs[:, :classes].sum(0), np.diagonal(pairs)[:classes]
    begin = np.searchsorted(word, np.arange(len(was) + 1))
    lo = 0
    while lo < len(was):
        hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + AT_ONCE // classes, "right")) - 1)
        hi = min(hi, lo + max(1, AT_ONCE // (2 * total)))
        w, k, m, old = word[begin[lo] : begin[hi]] - lo, key[begin[lo] : begin[hi]], n[begin[lo] : begin[hi]], was[lo:hi]
        side = np.zeros((hi - lo, 2 * total + 1))
        side[w, k] = m
        right, left, own = side[:, :total], side[:, total:-1], side[:, -1]
        inside = np.flatnonzero(old < classes)
        gain = np.zeros((hi - lo, classes))
        for here, first, other, table, of in ((k < total, 0, left, pairs, logs), ((k >= total) & (k < 2 * total), total, right, pairs.T, logs.T)):
            i, c, x = w[here], k[here] - first, m[here]
            if not len(i):
                continue
            # the word's own counts are taken out of its class first
            a, f = table[:classes, c], of[:classes, c]
            own_row = np.flatnonzero(old[i] < classes)
            own_column = np.flatnonzero(old[i] == c)
            both = own_column[old[i[own_column]] < classes]
            a[old[i[own_row]], own_row] -= x[own_row]
            a[:, own_column] -= other[i[own_column], :classes].T
            a[old[i[both]], both] -= own[i[both]]
            f[old[i[own_row]], own_row] = _f(a[old[i[own_row]], own_row])
            f[:, own_column] = _f(a[:, own_column])
            starts = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
            gain[i[starts]] += np.add.reduceat(_f(a + x) - f, starts, axis=1).T
        d = np.repeat(diagonal[None], hi - lo, 0)
        r, l = right[:, :classes], left[:, :classes]
        d[inside, old[inside]] -= (r + l)[inside, old[inside]] + own[inside]
        gain += _f(d + r + l + own[:, None]) + _f(d) - _f(d + r) - _f(d + l)
        for margin, all_ in ((out - l, right.sum(1) + own), (into - r, left.sum(1) + own)):
            margin[inside, old[inside]] -= all_[inside]
            gain -= _f(margin + all_[:, None]) - _f(margin)
        best = gain.argmax(1)
        stay = inside[gain[inside, best[inside]] <= gain[inside, old[inside]] + 1e-9]
        best[stay] = old[stay]
        new[lo:hi] = best
        lo = hi
    return new


def information(pairs: np.ndarray) -> float:
    """The mutual information of neighbouring classes, times the number of pairs."""
    return float(_f(pairs).sum() - _f(pairs.sum(1)).sum() - _f(pairs.sum(0)).sum() + _f(pairs.sum()))


def exchange(a: np.ndarray, b: np.ndarray, n: np.ndarray, words: int, units: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each unit by exchange clustering. The first `words` units, the most frequent
    first, move among `classes` classes; each other unit is a class of its own."""
    classes = max(1, min(classes, words))
    of = np.concatenate([np.arange(words) % classes, classes + np.arange(units - words)])
    total = int(of.max()) + 1
    pairs = np.zeros((total, total))
    np.add.at(pairs, (of[a], of[b]), n)
    logs = _f(pairs)

    def moved_by(cls: int, right: np.ndarray, left: np.ndarray, own: float) -> None:
        put(pairs, cls, right, left, own)
        logs[cls], logs[:, cls] = _f(pairs[cls]), _f(pairs[:, cls])

    after, before = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    a_at, b_at = np.searchsorted(a[after], np.arange(words + 1)), np.searchsorted(b[before], np.arange(words + 1))
    before_it = information(pairs)
    for _ in range(sweeps):
        for w in range(words):
            i, j = after[a_at[w] : a_at[w + 1]], before[b_at[w] : b_at[w + 1]]
            own = float(n[i][b[i] == w].sum())
            right = np.bincount(of[b[i]], n[i] * (b[i] != w), total)
            left = np.bincount(of[a[j]], n[j] * (a[j] != w), total)
            was = of[w]
            moved_by(was, -right, -left, -own)
            gain = gains(pairs, right, left, own, classes, logs)
            best = int(np.argmax(gain))
            if gain[best] <= gain[was] + 1e-9:
                best = was
            of[w] = best
            moved_by(best, right, left, own)
        if (now := information(pairs)) - before_it < STILL * abs(now):
            break
        before_it = now
    return of


class Model:
    """Transitions between classes and emissions of words, in log10."""

    def __init__(self, of: np.ndarray, pairs: np.ndarray, transition: np.ndarray, emission: np.ndarray, end_unit: int):
        self.of, self.pairs, self.transition, self.emission, self.end_unit = of, pairs, transition, emission, end_unit

    @classmethod
    def fitted(cls, counts: Counts, a: np.ndarray, b: np.ndarray, n: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS, known: np.ndarray | None = None) -> Model:
        """From the counts n of the pairs of units a, b; known: the units' classes where they have been found."""
        words, units = len(counts.words), counts.unknown_unit
        of = exchange(a, b, n, words, units, classes, sweeps) if known is None else known[:units]
        # unknown words are in the class of words seen once
        every = np.concatenate([of, [of[counts.once_unit]], np.arange(max(1, min(classes, words)))])
        total = int(of.max()) + 1
        pairs = np.zeros((total, total))
        np.add.at(pairs, (every[a], every[b]), n)
        size = pairs.sum(0)
        there = np.unique(every[np.unique(np.concatenate([b, [counts.once_unit, counts.end_unit]]))])
        share = np.zeros(total)
        share[there] = (size[there] + 0.5) / (size.sum() + 0.5 * len(there))
        with np.errstate(divide="ignore"):
            transition = np.log10((pairs + PRIOR * share) / (pairs.sum(1, keepdims=True) + PRIOR))
            emission = -np.log10(size)[every]
        novel = (counts.once + 0.5) / (counts.once + 2 * counts.twice + 1)
        emission[counts.unknown_unit] = np.log10(novel)
        emission[counts.once_unit] = np.log10((1 - novel) / max(counts.once, 1))
        if not size.sum():
            emission[counts.end_unit] = 0.0
        return cls(every, pairs, transition, emission, counts.end_unit)


def model_of(pairs: DataFrame, counts: Counts, classes: int, sweeps: int, known: np.ndarray | None = None) -> Model:
    """Parts of the pairs are summed apart; then one task fits the model, with as many numbers as pairs of units at most."""

    def total(t: pa.Table) -> pa.Table:
        both = zip(t.column("codes").to_pylist(), t.column("n").to_pylist(), strict=True)
        codes, n = summed([(unpacked(c, "<i8"), unpacked(n, "<i8")) for c, n in both])
        return pa.table({"codes": [packed(codes)], "n": [packed(n)]})

    def fit(t: pa.Table) -> pa.Table:
        codes, n = joined(t.column("codes"), "<i8")[0], joined(t.column("n"), "<i8")[0]
        order = np.argsort(codes)
        m = Model.fitted(counts, codes[order] >> 16, codes[order] & 0xFFFF, n[order].astype(float), classes, sweeps, known)
        return pa.table({"pairs": [m.pairs.tobytes()], "of": [m.of.astype("<i8").tobytes()], "transition": [m.transition.tobytes()], "emission": [m.emission.tobytes()]})

    sums = pairs.groupBy("part").applyInArrow(total, "codes binary, n binary")
    got = sums.groupBy(F.lit(1).alias("all")).applyInArrow(fit, "pairs binary, of binary, transition binary, emission binary").first()
    if got is None:
        none = np.empty(0, np.int64)
        return Model.fitted(counts, none, none, np.empty(0), classes, sweeps)
    of, transition = np.frombuffer(got["of"], "<i8"), np.frombuffer(got["transition"])
    total_ = round(len(transition) ** 0.5)
    return Model(of, np.frombuffer(got["pairs"]).reshape(total_, -1), transition.reshape(total_, -1), np.frombuffer(got["emission"]), counts.end_unit)


def scores(b: Block, row: dict, model: Model, counts: Counts) -> pa.Table:
    """The rows of SCORES for a block."""
    kind = model.of[b.unit]
    each = np.add.reduceat(model.transition[kind[b.before()], kind[b.tokens]] + model.emission[b.unit][b.tokens], np.cumsum(b.sizes) - b.sizes)
    return pa.table({
        "doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": row["held"], "n_tokens": b.sizes, "n_known": row["n_known"], "train_tokens": np.full(len(b.sizes), counts.tokens),
        "base_score": np.array(row["base"]) - b.sizes * np.log10(counts.tokens + 0.5 * (counts.types + 1)), "score": each + np.array(row["log_counts"]),
    })


def scored(spark: SparkSession, docs: DataFrame, top: int | None = None, classes: int | None = None, sweeps: int = SWEEPS, enough: int = ENOUGH, text: str = "text", id_col: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document. Where
    they aren't given, classes are the cube root of the types and top words 32 for each, CLASSES and TOP at least."""
    first, second = shared_dir(spark), shared_dir(spark)
    gathered = stored(blocks(docs, text, id_col), spark, first, "uncompressed")
    buckets = spread(gathered.agg(F.sum("n_words")).first()[0] or 0, BUCKET_WORDS, BUCKETS)
    answers = stored(counted(gathered, buckets), spark, second, "uncompressed")
    dictionaries = answers.where("block is null")
    sums = dictionaries.agg(*(F.sum(c).alias(c) for c in ("tokens", "types", "once", "twice"))).first()
    sums = [sums[c] or 0 for c in ("tokens", "types", "once", "twice")]
    classes = classes or max(CLASSES, round(sums[1] ** (1 / 3)))
    top = top or max(TOP, 32 * classes)
    best = most_frequent(dictionaries, top).collect()  # `top` rows
    counts = Counts(*sums, np.array([r["word"] for r in best], np.int64).view(np.uint64))
    ready = stored(with_units(gathered, answers.where("block is not null"), counts, enough), spark, None, "uncompressed")
    removed(spark, first)
    removed(spark, second)
    model = model_of(unit_pairs(ready, counts), counts, classes, sweeps)
    core, found = model.of, None
    groups, total = max(1, min(classes, len(counts.words))), len(model.pairs)
    tokens = ready.select("block", "held", "sizes", "tokens", "unit", "movable", "words", "end")

    def near_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from near_rows(neighbours(Block(row, counts), core, total, buckets)).to_batches()

    def near_classed(got: pa.Table, block: pa.Table) -> pa.Table:
        """A block's pairs of classes, under the buckets below 0, and its words' neighbours."""
        b = Block(block.to_pylist()[0], counts, got)
        pairs = [(-1 - part, None, codes, None, None, None, n) for part, codes, n in in_parts(*np.unique(b.pairs(), return_counts=True))]
        return near_rows(pairs + neighbours(b, core, total, buckets))

    near, path = tokens.mapInArrow(near_alone, NEAR), None
    for k in range(rounds if len(counts.words) else 0):
        found = stored(assigned(near, model.pairs, groups), spark)
        moved = found.agg(F.sum("n").alias("n"), F.sum("moved").alias("moved")).first()
        if path:
            removed(spark, path)
        if not moved["n"]:
            found = None
            break
        path = shared_dir(spark)
        after = stored(by_block(tokens, found).applyInArrow(near_classed, NEAR), spark, path, "uncompressed")
        near, known = after.where("bucket >= 0"), information(model.pairs)
        model = model_of(after.where("bucket < 0").select((-1 - F.col("bucket")).alias("part"), F.col("words").alias("codes"), "n"), counts, classes, sweeps, core)
        if k + 1 == rounds or moved["moved"] <= SETTLED * moved["n"] or information(model.pairs) - known < GAIN * known:
            removed(spark, path)
            break
    sent = spark.sparkContext.broadcast(model)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from scores(Block(row, counts), row, sent.value, counts).to_batches()

    def classed(got: pa.Table, block: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        return scores(Block(row, counts, got), row, sent.value, counts)

    return ready.mapInArrow(alone, SCORES) if found is None else by_block(ready, found).applyInArrow(classed, SCORES)
