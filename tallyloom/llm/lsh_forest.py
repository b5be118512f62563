"""Near-duplicate documents by an LSH forest of MinHash signatures.

1. A document's set are its distinct shingles of `width` words (64-bit hashes). Documents with equal
   sets (by a 128-bit digest) are one node from here on, whatever their number; the node is their
   smallest doc_id.
2. A node has TREES labels of DEPTH minimum hashes. Each tree is a sorted order of the labels: a
   range shuffle and a sort. In it a node's neighbours are those with the longest common prefixes.
   Nodes whose labels agree in the first ROOT hashes are in one region. A region of more than
   `neighbours` + 1 nodes is dense, and its neighbours agree to a greater depth.
3. Among the neighbours in sorted order, a node's likeliest candidate with a smaller id is
   confirmed on the full sets, then the likeliest candidate between any two components. So a group
   of thousands costs one confirmation each. Candidates are pairs that sizes and a sketch of 128
   bits, later FINE_BITS bits, don't rule out.
4. The rest is exact: every pair of different components that shares a region is compared, in the
   first tree that it shares. Regions with one component only have no such pair. A thin region is
   compared in one task. In a dense one the nodes outside its largest component are cut into
   blocks, and each meets blocks of the whole region in a unit of its own; there the full sets
   confirm at once, and a unit returns a link for two components at most, not their pairs.

A pair of similarity s shares a region in one of the trees with probability 1 - (1 - s ** ROOT) ** TREES:
0.9998 at 0.75.

Words: A-Z lower-cased, white space parts them. Fewer words than `width` are one shingle; null
texts and texts without words have an empty set, are linked with nothing and are kept. Rows that
repeat a doc_id are one document to the links; of several such rows each gets its own n_shingles. A
row with a null doc_id has the component of its copies with ids; without such copies its
component_id is null and it is kept. An empty table gives no rows. Other columns are ignored or,
in `kept_documents`, pass through. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import lowered, parted, releasing, slices
from .components import components
from .shared import heavy_keys, removed, shared_dir, spread, spread_join, stored, unused

TREES, DEPTH, ROOT = 16, 8, 3
NEIGHBOURS = 64
BITS = TREES * DEPTH
FINE_BITS = 2048
BLOCK = 512
TEXTS_AT_ONCE = 512
ORDER_ROWS = 1 << 20  # of a task's part of the sorted orders
_FACTORS = np.random.default_rng(20).integers(1 << 62, 1 << 63, BITS + FINE_BITS, dtype=np.uint64) | np.uint64(1)
_PRIME = np.uint64(0x9E3779B97F4A7C15)
SIGNED = "doc_id long, text_id long, n_shingles long, digest binary, labels binary, sketch binary"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    names, code, n = parted(lowered(texts))
    w = np.array([xxhash.xxh64_intdigest(x) for x in names.to_pylist()], np.uint64)[code]
    ends = np.cumsum(n)
    with np.errstate(over="ignore"):
        long = np.zeros(max(len(w) - width + 1, 0), np.uint64)
        for k in range(width):
            long = long * _PRIME + w[k : k + len(long)]
        long = mixed(long)
    out = []
    for end, size in zip(ends, n, strict=True):
        if size >= width:
            out.append(np.unique(long[end - size : end - width + 1]))
        elif size:
            out.append(np.array([xxhash.xxh64_intdigest(w[end - size : end].tobytes(), 7)], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def least_hashes(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """For each factor a hash of the shingle that comes first under it."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(shingles), 512):
            np.minimum(least, (shingles[lo : lo + 512, None] * factors).min(0), out=least)
        return mixed(least + np.arange(len(factors), dtype=np.uint64))


def bits_of(least: np.ndarray) -> bytes:
    return np.packbits(((least >> np.uint64(20)) & np.uint64(1)).astype(np.uint8)).tobytes()


def signature(shingles: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """The digest of a set, its labels (TREES times DEPTH numbers of 16 bits) and its sketch."""
    least = least_hashes(shingles, _FACTORS[:BITS])
    return xxhash.xxh128_digest(shingles.tobytes()), (least & np.uint64(0xFFFF)).astype(">u2").tobytes(), bits_of(least)


def signed(docs: DataFrame, width: int, text: str, id_col: str) -> DataFrame:
    """A row for each document; digest, labels and sketch are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cut in slices(b, "text", TEXTS_AT_ONCE):
                sets = shingle_sets(cut.column(2), width)
                found = [signature(s) if len(s) else (None, None, None) for s in sets]
                yield pa.RecordBatch.from_arrays([cut.column(0), cut.column(1), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([f[k] for f in found], pa.binary()) for k in range(3))], ["doc_id", "text_id", "n_shingles", "digest", "labels", "sketch"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_id"), F.col(text).alias("text"))
    return rows.mapInArrow(releasing(run), SIGNED)


def forest(nodes: DataFrame, *more: str) -> DataFrame:
    """tree, label, node, n_shingles, sketch and the columns `more`: a row for each node and tree."""
    trees = F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.substring("labels", t * (2 * DEPTH) + 1, F.lit(2 * DEPTH)).alias("label"))))
    return nodes.select("node", "n_shingles", "sketch", *more, trees.alias("t")).select("t.tree", "t.label", "node", "n_shingles", "sketch", *more)


def in_order(rows: DataFrame, n: int) -> DataFrame:
    """The n nodes' rows in the order of each tree, in ranges of about ORDER_ROWS rows where the session's partitions would be larger."""
    order = ["tree", "label", "node"]
    parts = spread(n * TREES, ORDER_ROWS)
    more = [parts] if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    return rows.repartitionByRange(*more, *order).sortWithinPartitions(*order)


class Stretch:
    """Neighbouring labels of a sorted order."""

    def __init__(self, t: pa.Table, similarity: float, neighbours: int):
        self.similarity, self.neighbours = similarity, neighbours
        self.node = t.column("node").to_numpy()
        self.size = t.column("n_shingles").to_numpy()
        self.bits = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(len(self.node), -1)
        label = np.frombuffer(b"".join(t.column("label").to_pylist()), ">u2").reshape(-1, DEPTH)
        self.tree = t.column("tree").to_numpy()
        new = np.ones(len(self.tree), bool)
        new[1:] = (self.tree[1:] != self.tree[:-1]) | (label[1:, :ROOT] != label[:-1, :ROOT]).any(1)
        self.region = np.cumsum(new) - 1
        self.component = t.column("component").to_numpy() if "component" in t.column_names else None
        if self.component is not None:
            self.roots = np.frombuffer(b"".join(t.column("roots").to_pylist()), ">u2").reshape(-1, TREES, ROOT)
        # a bit agrees with probability (1 + s) / 2; over four standard deviations below that
        p = (1 + similarity) / 2
        self.n_bits = 64 * self.bits.shape[1]
        self.least = int(self.n_bits * p - 4.3 * np.sqrt(self.n_bits * p * (1 - p)))

    def unsettled(self) -> np.ndarray:
        """Nodes of dense regions, and of regions that may go on in the partition before or after."""
        dense = np.bincount(self.region)[self.region] > self.neighbours + 1
        return dense | (self.region == 0) | (self.region == self.region[-1])

    def near(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those of the positions that are candidates and how many bits of their sketches agree. Where
        components are known, candidates lie in two and have no earlier tree with a common region."""
        small, large = np.minimum(self.size[i], self.size[j]), np.maximum(self.size[i], self.size[j])
        ok = (small >= self.similarity * large) & (self.node[i] != self.node[j])
        if self.component is not None:
            ok &= self.component[i] != self.component[j]
        i, j = i[ok], j[ok]
        agree = self.n_bits - np.bitwise_count(self.bits[i] ^ self.bits[j]).sum(1, dtype=np.int64)
        ok = agree >= self.least
        i, j, agree = i[ok], j[ok], agree[ok]
        if self.component is not None and len(i):
            ok = (self.roots[i] == self.roots[j]).all(2).argmax(1) == self.tree[i]
            i, j, agree = i[ok], j[ok], agree[ok]
        return i, j, agree

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Positions of candidates and how many bits of their sketches agree."""
        for k in range(1, min(self.neighbours, len(self.region) - 1) + 1):
            i = np.flatnonzero(self.region[k:] == self.region[:-k])
            if not len(i):
                return
            yield self.near(i, i + k)


def likeliest(ordered: DataFrame, similarity: float, neighbours: int) -> DataFrame:
    """node, partner: for each node that has or can have candidates the likeliest one with a smaller id, or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = [b for b in batches if b.num_rows]
        if not part:
            return
        s = Stretch(pa.Table.from_batches(part), similarity, neighbours)
        best, partner, seen = np.full(len(s.node), -1), np.zeros(len(s.node), np.int64), s.unsettled()
        for i, j, agree in s.pairs():
            seen[i] = seen[j] = True
            for x, y in ((i, j), (j, i)):
                up = (s.node[y] < s.node[x]) & (agree > best[x])
                best[x[up]], partner[x[up]] = agree[up], s.node[y[up]]
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"node": s.node[at], "partner": pa.array(partner[at], mask=best[at] < 0), "agree": best[at]})

    found = ordered.mapInArrow(releasing(run), "node long, partner long, agree long")
    return found.groupBy("node").agg(F.max(F.when(F.col("partner").isNotNull(), F.struct("agree", "partner")))["partner"].alias("partner"))


def likeliest_across(ordered: DataFrame, similarity: float, neighbours: int) -> DataFrame:
    """a, b: of the neighbours in two components the likeliest pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = [b for b in batches if b.num_rows]
        if not part:
            return
        s = Stretch(pa.Table.from_batches(part), similarity, neighbours)
        found = [np.stack(x) for x in s.pairs() if len(x[0])]
        if not found:
            return
        i, j, agree = np.concatenate(found, 1)
        low, high = np.minimum(s.component[i], s.component[j]), np.maximum(s.component[i], s.component[j])
        at = np.lexsort((-agree, high, low))
        first = np.ones(len(at), bool)
        first[1:] = (low[at[1:]] != low[at[:-1]]) | (high[at[1:]] != high[at[:-1]])
        at = at[first]
        yield pa.RecordBatch.from_pydict({"low": low[at], "high": high[at], "agree": agree[at], "a": s.node[i[at]], "b": s.node[j[at]]})

    found = ordered.mapInArrow(releasing(run), "low long, high long, agree long, a long, b long")
    return found.groupBy("low", "high").agg(F.max(F.struct("agree", "a", "b")).alias("m")).select("m.a", "m.b")


def mixed_regions(part: DataFrame, neighbours: int) -> DataFrame:
    """Rows of the regions that have several components: with `n` the region's nodes, `m` those outside its
    largest component, `other` whether the row's node is one of these, and `dense`."""
    part = part.withColumn("root", F.substring("label", 1, 2 * ROOT))
    each = part.groupBy("tree", "root", "component").agg(F.count(F.lit(1)).alias("k"))
    regions = each.groupBy("tree", "root").agg(F.sum("k").alias("n"), F.max(F.struct("k", "component")).alias("main")).where("n > main.k")
    rows = part.join(regions, ["tree", "root"])
    return rows.withColumns({"m": F.expr("n - main.k"), "other": F.expr("component <> main.component"), "dense": F.col("n") > neighbours + 1}).drop("main")


def thin_across(rows: DataFrame, similarity: float, neighbours: int) -> DataFrame:
    """a, b: all candidates of the thin regions in different components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = [b for b in batches if b.num_rows]
        if not part:
            return
        s = Stretch(pa.Table.from_batches(part), similarity, neighbours)
        for i, j, _ in s.pairs():
            yield pa.RecordBatch.from_pydict({"a": s.node[i], "b": s.node[j]})

    cols = rows.where("not dense").select("tree", "root", "label", "node", "n_shingles", "sketch", "roots", "component")
    return cols.repartition("tree", "root").sortWithinPartitions("tree", "root").drop("root").mapInArrow(releasing(run), "a long, b long")


def dense_links(rows: DataFrame, sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """a, b: confirmed links of the dense regions in different components; of two components one for each unit."""
    percent = round(100 * similarity)

    def run(t: pa.Table) -> pa.Table:
        s = Stretch(t, similarity, 0)
        side, other = t.column("side").to_numpy(), t.column("other").to_numpy(zero_copy_only=False)
        left, right = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
        found = []
        for j in right:
            i = left[~other[left] | (s.node[left] < s.node[j])]  # two others meet twice
            found.append(np.stack(s.near(i, np.full(len(i), j))))
        i, j, agree = np.concatenate(found, 1) if found else np.empty((3, 0), np.int64)
        shingles, done, a, b = t.column("shingles"), set(), [], []
        for k in np.argsort(-agree, kind="stable"):
            both = tuple(sorted((int(s.component[i[k]]), int(s.component[j[k]]))))
            if both in done:
                continue
            x, y = (np.frombuffer(shingles[int(p)].as_py(), np.uint64) for p in (i[k], j[k]))
            common = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * common >= percent * (len(x) + len(y) - common):
                done.add(both)
                a.append(s.node[i[k]])
                b.append(s.node[j[k]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    cut = lambda n: F.ceil(F.col(n) / block).cast("int")
    own = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), cut(n)).cast("int")
    unit = lambda x, y, side: F.struct(x.alias("x"), y.alias("y"), F.lit(side).alias("side"))
    lefts = F.transform(F.sequence(F.lit(0), cut("m") - 1), lambda y: unit(own("n", 1), y, 1))
    rights = F.transform(F.sequence(F.lit(0), cut("n") - 1), lambda x: unit(x, own("m", 2), 2))
    dense = rows.where("dense").join(sets.select("node", "shingles"), "node")
    units = dense.withColumn("u", F.explode(F.when(F.col("other"), F.concat(lefts, rights)).otherwise(lefts)))
    cols = units.select("tree", "root", "u.x", "u.y", "u.side", "other", "label", "node", "n_shingles", "sketch", "roots", "component", "shingles")
    return cols.groupBy("tree", "root", "x", "y").applyInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs a, b whose full sets are similar enough; sets: node, shingles."""
    percent = round(100 * similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("of_a").to_pylist(), b.column("of_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sided = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"of_{c}"))
    return pairs.join(sided("a"), "a").join(sided("b"), "b").mapInArrow(releasing(run), "a long, b long").distinct()


def full_sets(docs: DataFrame, nodes: DataFrame, width: int, text: str, id_col: str) -> DataFrame:
    """node, its shingles and a sketch of FINE_BITS bits, for the nodes given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cut in slices(b, "text", TEXTS_AT_ONCE):
                sets = shingle_sets(cut.column("text"), width)
                fine = [bits_of(least_hashes(s, _FACTORS[BITS:])) for s in sets]
                yield pa.RecordBatch.from_arrays([cut.column("node"), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(fine, pa.binary())], ["node", "shingles", "sketch"])

    rows = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text).alias("text"))
    return rows.join(nodes.select("node"), "node", "left_semi").mapInArrow(releasing(run), "node long, shingles binary, sketch binary")


def linked(spark: SparkSession, docs: DataFrame, width: int = 5, similarity: float = 0.75, text: str = "text", id_col: str = "doc_id", neighbours: int = NEIGHBOURS, block: int = BLOCK) -> DataFrame:
    """doc_id, text_id (64-bit hash of the text), n_shingles, component_id and kept of each document.

    neighbours and block change what the work costs, never the links.
    """
    rows = stored(signed(docs, width, text, id_col), spark)
    alike = rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n_rows"), F.first("n_shingles").alias("n_shingles"), F.first("labels").alias("labels"), F.first("sketch").alias("sketch"))
    nodes = stored(alike, spark)
    n = nodes.count()
    chosen = stored(likeliest(in_order(forest(nodes.where("node is not null")), n), similarity, neighbours), spark)
    paths = [shared_dir(spark), shared_dir(spark)]
    sets = stored(full_sets(docs, chosen, width, text, id_col), spark, paths[0], compression="uncompressed")
    links = stored(confirmed(chosen.where("partner is not null").select(F.col("partner").alias("a"), F.col("node").alias("b")), sets, similarity), spark)
    groups = components(spark, links)
    roots = F.concat(*[F.substring("labels", t * 2 * DEPTH + 1, 2 * ROOT) for t in range(TREES)])
    fine = stored(nodes.drop("sketch").withColumn("roots", roots).join(sets.select("node", "sketch"), "node"), spark, paths[1])
    in_groups = lambda: fine.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = stored(confirmed(likeliest_across(in_order(forest(in_groups(), "roots", "component"), n), similarity, neighbours), sets, similarity), spark)
    links = links.union(first)
    groups = components(spark, links)
    left = mixed_regions(forest(in_groups(), "roots", "component"), neighbours)
    more = stored(confirmed(thin_across(left, similarity, neighbours), sets, similarity).union(dense_links(left, sets, similarity, block)), spark)
    for path in paths:
        removed(spark, path)
    if more.limit(1).count():
        groups = components(spark, links.union(more))
    of = nodes.select("digest", "node").join(groups, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    heavy = heavy_keys(nodes, "digest", "n_rows", nodes.agg(F.sum("n_rows")).first()[0] or 0)
    out = spread_join(rows.select("doc_id", "text_id", "n_shingles", "digest"), of, "digest", heavy, nulls=True)
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "text_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def kept_documents(spark: SparkSession, docs: DataFrame, width: int = 5, similarity: float = 0.75, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs, as they are, that stay: of each component the rows of one document."""
    of, digest = unused(docs, "_id"), unused(docs, "_text_id")
    stay = linked(spark, docs, width, similarity, text, id_col).where("kept").select(F.col("doc_id").alias(of), F.col("text_id").alias(digest))
    return docs.join(stay, F.col(id_col).cast("long").eqNullSafe(F.col(of)) & (F.xxhash64(text) == F.col(digest)), "left_semi")
