"""Near-duplicate documents by SimHash fingerprints and a generalised pigeonhole join.

A document's shingles are its runs of `width` words, repeats included, joined by single spaces (with
fewer words the whole sequence is one). A bit of the 64-bit fingerprint is 1 if it is set in over
half the shingles' XXH64 values (seed 42, unsigned). Fingerprints link at `threshold` or fewer
differing bits.

1. Documents with equal fingerprints are one node, whatever their number.
2. Bits are grouped into parts of about equal size, those that go together most in one part: greedily,
   by the correlations over all nodes. More parts make more candidates, fewer parts more probes;
   `parts_for` takes the number that costs least were the bits independent.
3. Each node shares the threshold out over its parts: t_i, from -1 (the part isn't looked at) on, with
   the sum of t_i + 1 equal to threshold + 1. Of two fingerprints within the threshold one part at
   least then differs in t_i bits or fewer. A dynamic programme takes the allocation with the fewest
   probes and expected candidates, from how often values of the parts occur (CELLS hashed counts
   for each part over all nodes, less what other values are expected to add to a cell).
4. A node probes, in each part, the values within t_i bits. What it meets is verified on the whole
   fingerprints in the join.
5. Where every allocation costs as much as BALL, as in a large group of near-copies, a node meets
   the others of this kind half-way: two fingerprints within an even threshold have a place in common
   that is within half the threshold of both. So each emits its surroundings (65 places for a
   threshold of two). No place has more than 65 nodes, and all of these are linked with no check. A value with
   an estimate of BALL or more is never probed and not indexed, so no key of the join gathers a group.

So each node costs a bounded number of rows, no pairs of a group are given, and no link is lost.

Nulls and other cases: a null text, an empty one and one without words have the fingerprint zero,
which is linked like any other. Rows that repeat a doc_id are separate rows with fingerprints of
their own. A null doc_id is never a component_id unless its component has no other; its rows are
links like any other. An empty table gives no rows. Other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import lowered, releasing, slices
from .components import components
from .shared import heavy_keys, removed, shared_dir, spread_join, stored

SEED, BITS = 42, 64
TEXTS_AT_ONCE, NODES_AT_ONCE = 4096, 8192
CELLS = 1 << 18
PROBE = 8  # what a row of the shuffle costs, in candidates
BALL = PROBE * (BITS + 1)
_BYTES = np.uint64(0x0101010101010101)
_INF = np.float64(1e18)


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 of each shingle of a text in lower case."""
    words = text.split()
    whole = b" ".join(words)
    if len(words) < width:
        return [xxhash.xxh64_intdigest(whole, SEED)] if words else []
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.append(0, ends[:-1] + 1)
    last = len(words) - width + 1
    return [xxhash.xxh64_intdigest(whole[a:b], SEED) for a, b in zip(begins[:last].tolist(), ends[width - 1 :].tolist(), strict=True)]


def majorities(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The fingerprint of each text; the hashes of all texts come one after another.

    Eight bits are counted at once, one in each byte of a sum of at most 255 hashes.
    """
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    begins, runs = (np.cumsum(sizes) - sizes)[full], -(-sizes[full] // 255)
    of = np.repeat(np.arange(len(full)), runs)
    first = np.cumsum(runs) - runs
    starts = begins[of] + 255 * (np.arange(len(of)) - first[of])
    got = np.zeros(len(full), np.uint64)
    for j in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(j)) & _BYTES, starts).astype("<u8")
        counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        ones = (2 * counts > sizes[full, None]).astype(np.uint64)
        got |= (ones << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(j))).sum(1, dtype=np.uint64)
    out[full] = got
    return out


def fingerprints(texts: pa.Array, width: int) -> np.ndarray:
    low = lowered(texts)
    hashes = [shingle_hashes(x.as_buffer().to_pybytes(), width) for x in low]
    sizes = np.array([len(h) for h in hashes], np.int64)
    return majorities(np.array([x for h in hashes for x in h], np.uint64), sizes)


def fingerprinted(docs: DataFrame, width: int, text: str, id_col: str) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cut in slices(b, "text", TEXTS_AT_ONCE):
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.array(fingerprints(cut.column(1), width).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(releasing(run), "doc_id long, fp long")


# -- parts


def agreements(nodes: DataFrame) -> np.ndarray:
    """How many nodes have both bits i and j set, over all nodes; 2080 sums come back."""
    low, high = np.triu_indices(BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for b in batches:
            fp = b.column(0).to_numpy().astype("<i8")
            for lo in range(0, len(fp), 1 << 16):
                x = np.unpackbits(fp[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += x.T @ x
        if total.any():
            yield pa.RecordBatch.from_pydict({"pair": np.arange(len(low), dtype=np.int32), "n": total[low, high].astype(np.int64)})

    out = np.zeros((BITS, BITS))
    for r in nodes.select("fp").mapInArrow(releasing(run), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[low[r["pair"]], high[r["pair"]]] = out[high[r["pair"]], low[r["pair"]]] = r["n"]
    return out


def grouped(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """The bits in parts of about equal size. A part begins with the bit that goes together most with
    the bits left and takes the one that goes together most with those it has, until it is full."""
    ones = np.diag(both)
    spread = np.sqrt(ones * (n - ones))
    alike = np.abs(n * both - np.outer(ones, ones)) / np.maximum(np.outer(spread, spread), 1e-9)
    left, out = list(range(BITS)), []
    for k in range(parts):
        size = -(-len(left) // (parts - k))
        near = alike[np.ix_(left, left)].sum(1)
        part = [left.pop(int(near.argmax()))]
        while len(part) < size:
            part.append(left.pop(int(alike[np.ix_(left, part)].sum(1).argmax())))
        out.append(sorted(part))
    return out


def allocated(costs: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the cheapest allocation and its cost. costs: rows, parts, threshold + 2; the last
    is what a part costs with t = -1, 0, ..., threshold. An allocation has the sum of t + 1 equal to
    threshold + 1."""
    n, parts, _ = costs.shape
    best, taken = np.full((n, threshold + 2), _INF), []
    best[:, 0] = 0
    for k in range(parts):
        new, how = np.full_like(best, _INF), np.zeros(best.shape, np.int64)
        for whole in range(threshold + 2):
            for own in range(whole + 1):
                c = best[:, whole - own] + costs[:, k, own]
                less = c < new[:, whole]
                new[less, whole], how[less, whole] = c[less], own
        best = new
        taken.append(how)
    whole, t = np.full(n, threshold + 1), np.zeros((n, parts), np.int64)
    for k in reversed(range(parts)):
        t[:, k] = taken[k][np.arange(n), whole] - 1
        whole = whole - t[:, k] - 1
    return t, best[:, threshold + 1]


def masks(bits: int, t: int) -> np.ndarray:
    """The values of so many bits with t ones or fewer."""
    return np.array([sum(1 << b for b in c) for k in range(t + 1) for c in combinations(range(bits), k)], np.int64)


def affordable(bits: int, t: int) -> bool:
    """Whether the probes alone cost less than BALL."""
    n, c = 0, 1
    for k in range(t + 1):
        n += c
        c = c * (bits - k) // (k + 1)
    return n * PROBE < BALL


def parts_for(n: int, threshold: int) -> int:
    """The number of parts that costs least for n nodes with independent bits."""

    def cost(parts: int) -> float:
        sizes = [(BITS + k) // parts for k in range(parts)]
        probes = [[0.0] + [len(masks(b, t)) * (PROBE + n / 2.0**b) if affordable(b, t) else _INF for t in range(threshold + 1)] for b in sizes]
        return allocated(np.array([probes]), threshold)[1][0] + parts * PROBE

    return min(range(2, threshold + 3), key=cost)


class Parts:
    """Which bits make a part, and how often its values are expected to occur."""

    def __init__(self, bits: list[list[int]], n: int, cells: np.ndarray | None = None):
        self.bits, self.n, self.cells = bits, n, cells

    def value(self, fp: np.ndarray, part: int) -> np.ndarray:
        out = np.zeros(len(fp), np.int64)
        for k, bit in enumerate(self.bits[part]):
            out |= ((fp >> bit) & 1) << k
        return out

    def cell(self, value: np.ndarray, part: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (value.astype(np.uint64) + np.uint64(part + 1)) * np.uint64(0x9E3779B97F4A7C15)
            return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % CELLS

    def expected(self, value: np.ndarray, part: int) -> np.ndarray:
        """Nodes with that value: its cell's without the share of others, but no fewer than by chance."""
        count = self.cells[part][self.cell(value, part)]
        return np.maximum(count - (self.n - count) / (CELLS - 1), self.n / 2.0 ** len(self.bits[part]))

    def plan(self, fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """t of each fingerprint and part, and whether it costs as much as BALL."""
        costs = np.full((len(fp), len(self.bits), threshold + 2), _INF)
        costs[:, :, 0] = 0
        for p, bits in enumerate(self.bits):
            value = self.value(fp, p)
            for t in range(threshold + 1):
                if affordable(len(bits), t):
                    m = masks(len(bits), t)
                    costs[:, p, t + 1] = len(m) * PROBE
                    for mask in m:
                        costs[:, p, t + 1] += self.expected(value ^ mask, p)
        t, cost = allocated(costs, threshold)
        return t, cost >= BALL


def counted(nodes: DataFrame, parts: Parts) -> np.ndarray:
    """CELLS counts for each part, over all nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(parts.bits), CELLS), np.int64)
        for b in batches:
            fp = b.column(0).to_numpy()
            for p in range(len(parts.bits)):
                total[p] += np.bincount(parts.cell(parts.value(fp, p), p), minlength=CELLS)
        p, cell = np.nonzero(total)
        for lo in range(0, len(p), 1 << 16):
            at = slice(lo, lo + (1 << 16))
            yield pa.RecordBatch.from_pydict({"part": p[at].astype(np.int32), "cell": cell[at].astype(np.int32), "n": total[p[at], cell[at]]})

    out = np.zeros((len(parts.bits), CELLS), np.int64)
    t = nodes.select("fp").mapInArrow(releasing(run), "part int, cell int, n long").groupBy("part", "cell").agg(F.sum("n").alias("n")).toArrow()  # CELLS rows a part at most
    out[t.column("part").to_numpy(), t.column("cell").to_numpy()] = t.column("n").to_numpy()
    return out


# -- join


def _cut(b: pa.RecordBatch) -> Iterator[np.ndarray]:
    fp = b.column(0).to_numpy()
    for lo in range(0, len(fp), NODES_AT_ONCE):
        yield fp[lo : lo + NODES_AT_ONCE]


def index_rows(nodes: DataFrame, parts: Parts) -> DataFrame:
    """part, value and of: each node under its value of each part, but for values that no node probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for fp in _cut(b):
                for p in range(len(parts.bits)):
                    value = parts.value(fp, p)
                    some = parts.expected(value, p) < BALL
                    yield pa.RecordBatch.from_pydict({"part": np.full(some.sum(), p, np.int32), "value": value[some], "of": fp[some]})

    return nodes.select("fp").mapInArrow(releasing(run), "part int, value long, of long")


def probe_rows(nodes: DataFrame, parts: Parts, threshold: int) -> DataFrame:
    """part, value and fp: the values that a node probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for fp in _cut(b):
                plan, dense = parts.plan(fp, threshold)
                for p, bits in enumerate(parts.bits):
                    for t in range(threshold + 1):
                        who = fp[(plan[:, p] == t) & ~dense]
                        if len(who):
                            m = masks(len(bits), t)
                            yield pa.RecordBatch.from_pydict({"part": np.full(len(who) * len(m), p, np.int32), "value": (parts.value(who, p)[:, None] ^ m).ravel(), "fp": np.repeat(who, len(m))})

    return nodes.select("fp").mapInArrow(releasing(run), "part int, value long, fp long")


def half_way(nodes: DataFrame, parts: Parts, threshold: int) -> DataFrame:
    """a, b: links of the nodes whose every allocation costs BALL; those that share a place are linked with the smallest of it."""
    around = [m - (1 << BITS) if m >> (BITS - 1) else m for m in (sum(1 << b for b in c) for k in range(threshold // 2 + 1) for c in combinations(range(BITS), k))]
    flips = np.array(around, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for fp in _cut(b):
                who = fp[parts.plan(fp, threshold)[1]]
                for lo in range(0, len(who), max(1, (1 << 19) // len(flips))):
                    own = who[lo : lo + max(1, (1 << 19) // len(flips))]
                    yield pa.RecordBatch.from_pydict({"place": (own[:, None] ^ flips).ravel(), "fp": np.repeat(own, len(flips))})

    places = nodes.select("fp").mapInArrow(releasing(run), "place long, fp long").groupBy("place").agg(F.collect_set("fp").alias("near")).where(F.size("near") > 1)
    return places.select(F.array_min("near").alias("a"), F.explode("near").alias("b")).where("a <> b")


def linked(spark: SparkSession, docs: DataFrame, width: int = 3, threshold: int = 2, parts: int | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that it reaches, of each row.

    parts changes what the work costs, never the links. The threshold is an even number.
    """
    if threshold % 2:
        raise ValueError("an odd threshold has no half-way place")
    rows = stored(fingerprinted(docs, width, text, id_col), spark)
    path = shared_dir(spark)
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), spark, path)
    n, n_rows = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    known = Parts(grouped(agreements(nodes), n, parts or parts_for(n, threshold)), n)
    known.cells = counted(nodes, known)
    # the rows of a node are many, so Spark's estimate from the nodes' file is too low for a broadcast
    met = index_rows(nodes, known).join(probe_rows(nodes, known, threshold).hint("merge"), ["part", "value"])
    apart = F.bit_count(F.col("of").bitwiseXOR(F.col("fp")))
    found = met.where((apart <= threshold) & (F.col("of") != F.col("fp"))).select(F.least("of", "fp").alias("a"), F.greatest("of", "fp").alias("b"))
    groups = components(spark, stored(found.union(half_way(nodes, known, threshold)), spark))
    of = nodes.select("fp", "least").join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = stored(of.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("k")), spark)
    large = heavy_keys(smallest, "component", "k", n)
    by_fp = spread_join(of.select("fp", "component"), smallest.select("component", "component_id"), "component", large).select("fp", "component_id")
    heavy = heavy_keys(nodes, "fp", "n", n_rows)
    by_fp = stored(by_fp, spark)
    removed(spark, path)
    out = spread_join(rows, by_fp, "fp", heavy)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
