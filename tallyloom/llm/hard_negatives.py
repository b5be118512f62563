"""Hard negatives from embeddings, exactly, over k-means inverted lists.

A row's components are floor(256 * x); its score for an anchor is the integer inner product. An
anchor's positives are the first `positives` other rows of its label, by score, then vec_id. For
each of them the negatives are the first `negatives` rows of other labels whose score is at least
`percent` % of the positive's score and not above it.

1. Centroids are fitted by k-means on a bounded sample (SAMPLE rows for each, the smallest hashes, of
   at most CENTROIDS centroids). Every row goes to the list of its nearest centroid; a list's radius is the
   largest distance in it, over all rows.
2. By Cauchy and Schwarz a row of a list scores at least q.c - |q| r and at most q.c + |q| r for the
   anchor q. Lists outside the window of scores that is asked for are never visited.
3. Anchors visit lists by descending upper bound: the first VISITS[0] lists, then the next ones, then
   all that are left. After each round a list is visited only if its bound isn't strictly below
   the anchor's k-th score so far, so that ties are settled by vec_id. Bounds are widened by more than rounding can do.
4. A visit is a unit of one block of a list (ROWS rows) and one part of the anchors that come to it
   (ANCHORS anchors): a matrix product in one task. So neither a list that holds a third of all rows, such
   as that of one vector, nor the anchors' number makes a task larger. A unit gives k rows for each
   anchor at most, and only those that reach its k-th score so far.

Nulls and other cases: rows with a null label, a null vector or a null or non-finite component take no
part. Vectors of other lengths are compared as if filled up with zeros. Rows that repeat a vec_id are
rows of their own, and so are anchors; a null vec_id is no anchor and comes last among equal scores.
An anchor without positives, and a positive without negatives, gives no rows. An empty table gives
no rows. Other columns are ignored. Scores must stay below 2 ** 53, or the run ends with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .columns import releasing
from .shared import stored

CENTROIDS, SAMPLE, SWEEPS = 1024, 32, 8
ROWS, ANCHORS = 4096, 1024
AT_ONCE = 256  # anchors of a unit whose scores are in memory together
VISITS = (4, 32)
POSITIVES, NEGATIVES, PERCENT = 5, 5, 80
UNIT = "row long, label long, v binary"
FOUND = "anchor long, w int, score long, vec_id long, row long"
MISSING = np.iinfo(np.int64).max


def matrix(v: pa.Array, dims: int) -> np.ndarray:
    """Vectors, each the bytes of its components, as rows; shorter ones are filled up with zeros."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    out = np.zeros((len(v), dims))
    for k, x in enumerate(v):
        own = np.frombuffer(x.as_buffer(), "<f8")
        out[k, : len(own)] = own
    return out


def components_of(rows: DataFrame, anchor: Column, id_col: str, vector: str, label: str) -> DataFrame:
    """row, vec_id, label, is_anchor, v (integers as doubles, in bytes), dims and norm (squared) of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("v").cast(pa.list_(pa.float64()))
            size = np.diff(lists.offsets.to_numpy())
            raw, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(size)  # a null is no number here
            good = np.array([bool(np.isfinite(raw[e - s : e]).all()) for s, e in zip(size, ends, strict=True)], bool)
            with np.errstate(over="ignore", invalid="ignore"):
                flat = np.floor(256 * raw)
            v = [flat[e - s : e].astype("<f8").tobytes() for s, e in zip(size, ends, strict=True)]
            norm = np.array([float(np.square(flat[e - s : e]).sum()) for s, e in zip(size, ends, strict=True)])
            out = pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("is_anchor"), pa.array(v, pa.binary()), pa.array(size.astype(np.int32)), pa.array(norm)], ["vec_id", "label", "is_anchor", "v", "dims", "norm"])
            yield out.filter(pa.array(good))

    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"), F.col(vector).alias("v"))
    found = own.where("label is not null and v is not null").mapInArrow(releasing(run), "vec_id long, label long, is_anchor boolean, v binary, dims int, norm double")
    return found.withColumn("row", F.monotonically_increasing_id())


def fitted(rows: DataFrame, n: int, dims: int) -> np.ndarray:
    """Centroids: k-means on SAMPLE rows for each of them, the smallest hashes; about the square root of n of them."""
    k = int(min(CENTROIDS, max(1, round(n**0.5))))
    part = 4.0 * k * SAMPLE / n  # as many again and more, by a hash, so that few rows are sorted
    some = rows.where(F.pmod(F.xxhash64("v", "row"), F.lit(1_000_000)) < int(1_000_000 * part) + 1) if part < 1 else rows
    x = matrix(some.orderBy(F.xxhash64("v", F.lit(1)), "row").limit(k * SAMPLE).select("v").toArrow().column("v"), dims)
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(SWEEPS):
        of = nearest(x, c)[0]
        size = np.bincount(of, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and the distance to it."""
    far = (c * c).sum(1) - 2 * (x @ c.T)
    of = far.argmin(1)
    return of, np.sqrt(((x - c[of]) ** 2).sum(1))


def listed(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """rows with list, the nearest centroid, and far, the distance to it."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                cut = b.slice(lo, ROWS)
                of, far = nearest(matrix(cut.column("v"), dims), centroids)
                yield pa.RecordBatch.from_arrays([*(cut.column(c) for c in ("row", "vec_id", "label", "is_anchor", "v")), pa.array(of.astype(np.int32)), pa.array(far)], ["row", "vec_id", "label", "is_anchor", "v", "list", "far"])

    return rows.select("row", "vec_id", "label", "is_anchor", "v").mapInArrow(releasing(run), "row long, vec_id long, label long, is_anchor boolean, v binary, list int, far double")


class Lists:
    """Each list's centroid, radius and blocks, CENTROIDS rows at most; all tasks get them."""

    def __init__(self, centroids: np.ndarray, dims: int, sizes: list):
        self.centroids, self.dims = centroids, dims
        self.radius, self.blocks = np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
        for r in sizes:
            self.radius[r["list"]], self.blocks[r["list"]] = r["radius"], -(-r["n"] // ROWS)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest score that a row of each list can have, for each anchor; empty lists have none."""
        middle, size = q @ self.centroids.T, np.sqrt((q * q).sum(1))[:, None]
        wide = size * self.radius * (1 + 1e-9) + 1e-9 * (np.abs(middle) + size * np.sqrt((self.centroids**2).sum(1))) + 1e-6
        none = self.blocks == 0
        return np.where(none, np.inf, middle - wide), np.where(none, -np.inf, middle + wide)


def indexed(spark: SparkSession, rows: DataFrame, n: int, dims: int) -> tuple[DataFrame, Lists]:
    """The stored rows with their lists, and what is known of the lists."""
    centroids = fitted(rows, n, dims)
    own = stored(listed(rows, centroids), spark)
    return own, Lists(centroids, dims, own.groupBy("list").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).collect())


def visits(asked: DataFrame, lists: Lists, done: int, more: int | None) -> DataFrame:
    """list, block, part and an anchor that visits it: of each anchor's lists, by descending bound, those
    from the done-th on, `more` of them or all. asked: row, label, v, windows (lo, hi, kth)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                cut = b.slice(at, AT_ONCE)
                least, most = lists.bounds(matrix(cut.column("v"), lists.dims))
                anchor, list_ = [], []
                for i, windows in enumerate(cut.column("windows").to_pylist()):
                    # of a window's scores the largest that a list can have
                    best = np.full(len(lists.radius), -np.inf)
                    wanted = np.zeros(len(lists.radius), bool)
                    for w in windows:
                        lo, hi = -np.inf if w["lo"] is None else w["lo"], np.inf if w["hi"] is None else w["hi"]
                        bound = np.minimum(most[i], hi)
                        inside = (most[i] >= lo) & (least[i] <= hi) & (lists.blocks > 0)
                        best = np.where(inside, np.maximum(best, bound), best)
                        wanted |= inside & (bound >= (-np.inf if w["kth"] is None else w["kth"]))
                    # the order doesn't depend on the k-th scores, so that a round goes on where the last one ended
                    order = np.argsort(-best, kind="stable")[done : None if more is None else done + more]
                    order = order[wanted[order]]
                    anchor.append(np.full(len(order), i))
                    list_.append(order)
                anchor, list_ = np.concatenate(anchor), np.concatenate(list_)
                blocks = lists.blocks[list_]
                anchor, of = np.repeat(anchor, blocks), np.repeat(list_, blocks)
                block = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                for lo in range(0, len(of), ROWS):
                    own = slice(lo, lo + ROWS)
                    rows = cut.take(pa.array(anchor[own]))
                    yield pa.RecordBatch.from_arrays([pa.array(of[own].astype(np.int32)), pa.array(block[own].astype(np.int32)), *(rows.column(c) for c in ("row", "label", "v", "windows"))], ["list", "block", "row", "label", "v", "windows"])

    schema = "list int, block int, row long, label long, v binary, windows array<struct<lo: long, hi: long, kth: long>>"
    return asked.select("row", "label", "v", "windows").mapInArrow(releasing(run), schema)


def searched(spark: SparkSession, asked: DataFrame, own: DataFrame, lists: Lists, done: int, more: int | None, k: int, same: bool) -> DataFrame:
    """FOUND: candidates of one round for each anchor and window (w), k of each unit at most."""

    def run(_: tuple, rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = [[] for _ in range(5)]
        if rows.num_rows and anchors.num_rows:
            x, label, number = matrix(rows.column("v"), lists.dims), rows.column("label").to_numpy(), rows.column("row").to_numpy()
            vec_id = rows.column("vec_id").combine_chunks().fill_null(MISSING).to_numpy()
            for lo in range(0, anchors.num_rows, AT_ONCE):
                cut = anchors.slice(lo, AT_ONCE)
                scores = (matrix(cut.column("v"), lists.dims) @ x.T).astype(np.int64)
                for score, row, of, windows in zip(scores, cut.column("row").to_pylist(), cut.column("label").to_pylist(), cut.column("windows").to_pylist(), strict=True):
                    ok = ((label == of) == same) & (number != row)
                    for w, limits in enumerate(windows):
                        inside = ok & (score >= max(x for x in (limits["lo"], limits["kth"], -MISSING) if x is not None))
                        if limits["hi"] is not None:
                            inside &= score <= limits["hi"]
                        at = np.flatnonzero(inside)
                        if len(at) > k:  # with all that tie with the k-th
                            at = at[score[at] >= -np.partition(-score[at], k - 1)[k - 1]]
                        at = at[np.lexsort((number[at], vec_id[at], -score[at]))][:k]
                        for c, v in zip(out, (np.full(len(at), row), np.full(len(at), w), score[at], vec_id[at], number[at]), strict=True):
                            c.append(v)
        a, w, score, ids, number = (np.concatenate(c) if c else np.empty(0, np.int64) for c in out)
        return pa.table({"anchor": pa.array(a), "w": pa.array(w.astype(np.int32)), "score": pa.array(score), "vec_id": pa.array(ids, mask=ids == MISSING), "row": pa.array(number)})

    to = stored(visits(asked, lists, done, more), spark)
    # the parts of a list's anchors, so that a unit has about ANCHORS of them; the same for all its blocks
    parts = to.where("block = 0").groupBy("list").agg(F.ceil(F.count(F.lit(1)) / ANCHORS).cast("int").alias("parts"))  # CENTROIDS rows at most
    parts = F.broadcast(parts)
    left = own.join(parts, "list").withColumn("block", F.pmod(F.xxhash64("row"), F.get(F.lit(np.maximum(lists.blocks, 1).tolist()), F.col("list"))).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = to.join(parts, "list").withColumn("part", F.pmod(F.xxhash64("row", F.lit(1)), F.col("parts")).cast("int"))
    unit = ["list", "block", "part"]
    return left.select(*unit, "row", "vec_id", "label", "v").groupBy(*unit).cogroup(right.select(*unit, "row", "label", "v", "windows").groupBy(*unit)).applyInArrow(run, FOUND)


def first(found: DataFrame, k: int) -> DataFrame:
    """The k first of each anchor and window, with their rank n from 1."""
    order = Window.partitionBy("anchor", "w").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)


def best(spark: SparkSession, asked: DataFrame, own: DataFrame, lists: Lists, k: int, same: bool) -> DataFrame:
    """FOUND and n: for each anchor and window the k first rows of the same label, or of others, inside the window.
    asked: row, label, v, limits (lo, hi)."""
    empty = F.transform("limits", lambda w: F.struct(w["lo"].alias("lo"), w["hi"].alias("hi"), F.lit(None).cast("long").alias("kth")))
    so_far, rows, done = None, asked.withColumn("windows", empty), 0
    for more in (*VISITS, None):
        new = searched(spark, rows, own, lists, done, more, k, same)
        so_far = stored(first(new if so_far is None else so_far.drop("n").unionByName(new), k), spark)
        done += more or 0
        if done >= len(lists.radius):
            break
        kth = so_far.where(F.col("n") == k).groupBy(F.col("anchor").alias("row")).agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("kth"))  # a row for each window at most
        with_kth = F.transform("limits", lambda w, i: F.struct(w["lo"].alias("lo"), w["hi"].alias("hi"), F.try_element_at(F.col("kth"), i).alias("kth")))
        rows = asked.join(kth, "row", "left").withColumn("windows", with_kth).drop("kth")
    return so_far


def mined(spark: SparkSession, rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, percent: int = PERCENT, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score. anchor: which rows are anchors."""
    own = stored(components_of(rows, anchor, id_col, vector, label), spark)
    n, dims, norm = own.agg(F.count(F.lit(1)), F.max("dims"), F.max("norm")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n or not dims:
        return spark.createDataFrame([], schema)
    if not norm < 2**53:  # by Cauchy and Schwarz no score is larger
        raise ValueError("scores may be beyond 2 ** 53")
    own, lists = indexed(spark, own, n, dims)
    anchors = own.where("is_anchor").select("row", "vec_id", "label", "v")
    whole = F.array(F.struct(F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi")))
    near = best(spark, anchors.withColumn("limits", whole), own, lists, positives, True)
    # in the order of their ranks, so that a window's number is the positive's
    each = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("n", F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id")))).alias("p"))
    # hundredths rounded up; div cuts towards zero
    lo = F.expr(f"transform(p, x -> struct(case when x.positive_score > 0 then ({percent} * x.positive_score + 99) div 100 else ({percent} * x.positive_score) div 100 end as lo, x.positive_score as hi))")
    asked = stored(anchors.withColumnsRenamed({"vec_id": "anchor_id"}).join(each.withColumnRenamed("anchor", "row"), "row").withColumn("limits", lo), spark)
    far = best(spark, asked.select("row", "label", "v", "limits"), own, lists, negatives, False)
    named = far.join(asked.select(F.col("row").alias("anchor"), "anchor_id", "p"), "anchor").withColumn("positive", F.get("p", F.col("w")))
    return named.select("anchor_id", F.col("positive.positive_id").alias("positive_id"), F.col("n").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("positive.positive_score").alias("positive_score"), F.col("score").alias("negative_score"))
