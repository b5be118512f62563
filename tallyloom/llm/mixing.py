"""Mixing sources to target weights.

The words of each source, document after document, are packed into blocks of a fixed length.
The mix is a list of slots in output shards. For each shard the counts of the sources are drawn
from a multinomial whose chances are what each source still has to give, so that every source
ends at its own number of slots. The k-th slot of a source takes the block that a keyed
pseudorandom permutation of the block indexes gives for k; after all blocks have been taken once
the next pass has another permutation. Slots and blocks meet in a join by index.

What goes through the driver, and to the tasks that draw, is a row for each source; a shard's counts are drawn in
a task. Rows that are the same in all columns used are counted first. Positions in a source's stream
come from sums over buckets of hashes of the rows, so one source may hold any share of the rows, and so
may rows without a doc_id or of one text.

Weights 1, 2, 3, 1, ... go to the sources in code-point order, a null source last. Targets share
the words of all sources by weight; a target stops at `most` times its source's words and the rest
is shared again. Null and empty texts have size 0 and are never taken. Rows that repeat a doc_id
are separate documents. With an empty table or no words nothing is taken. Other columns pass
through `mixed`; `taken` ignores them. The same input and seed give the same mix.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import let, spread, stored, words

BLOCK = 128
MOST = 3
SHARDS = 4096
SLOTS = 4096
BUCKET_ROWS = 4096
RUN = 65_536


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """sources: source, source_size. Adds source_no, weight and target; a row for each source.

    The level at which the targets' sum is right is found from the sources in the order in which
    they would reach their limit.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("source_no", F.row_number().over(order) - 1).withColumn("weight", F.col("source_no") % 3 + 1)
    full = F.col("source_size") * most
    filled = Window.orderBy(full / F.col("weight"), "source_no")
    before, every = filled.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum(full).over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= full, F.struct(full / F.col("weight"), "source_no", "level"))).over(every)["level"])
    return s.withColumn("target", F.least(full.cast("double"), F.col("weight") * F.coalesce("level", F.lit(0.0)))).drop("level")


def keys(docs: DataFrame, names: list[str]) -> list[Column]:
    """Two 64-bit hashes of these columns; rows that agree in both take each other's place."""
    plain = [F.col(f"`{f.name}`").cast("string") if re.search("map<|variant", f.dataType.simpleString()) else F.col(f"`{f.name}`") for f in docs.schema.fields if f.name in names]
    return [F.xxhash64(*plain), F.xxhash64(F.lit(1), *plain)]


def sized(docs: DataFrame, text: str, source: str, id_col: str, names: list[str]) -> DataFrame:
    """k1, k2 (keys() of the columns `names`), doc_id, source, size and n, the number of rows that have this key."""
    k1, k2 = keys(docs, names)
    size = F.size(words(F.col(text))).cast("long")
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(id_col).alias("doc_id"), F.col(source).alias("source"), size.alias("size"))
    return rows.groupBy("k1", "k2").agg(*[F.first(c).alias(c) for c in ("doc_id", "source", "size")], F.count(F.lit(1)).alias("n"))


def placed(rows: DataFrame) -> DataFrame:
    """What sized() gave and was stored, with a row for each row of the documents again (`unit` from 0 within a key), and source_size,
    source_no, target and start, the number of words before the document in its source's stream."""
    words_of = F.col("size") * F.col("n")
    known = targets(rows.groupBy("source").agg(F.sum(words_of).alias("source_size")))
    n = spread(rows.count(), BUCKET_ROWS)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("k1", "k2"), F.lit(n)))
    sums = rows.groupBy("source", "bucket").agg(F.sum(words_of).alias("s"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("_start"))
    starts = starts.join(known, F.col("_source").eqNullSafe(F.col("source"))).drop("source")
    inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "k1", "k2").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_before", F.sum(words_of).over(inside) - words_of)
    both = rows.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    each = both.withColumn("unit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return each.select("k1", "k2", "unit", "doc_id", "source", "size", "source_size", "source_no", "target", (F.col("_start") + F.col("_before") + F.col("unit") * F.col("size")).alias("start"))


def shared_out(slots: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """n of the slots, by a multinomial whose chances are what each source has; what a source could not give is drawn again."""
    now = np.zeros_like(slots)
    while (short := n - int(now.sum())) > 0:
        rest = slots - now
        now += np.minimum(rng.multinomial(short, rest / rest.sum()), rest)
    return now


def draw(slots: np.ndarray, shard: int, seed: int, per_shard: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each source the first slot and the number of slots of a shard, which follow from the seed alone.

    The shards are halved again and again, and at each step the slots of a half are drawn from what its
    shards have together. So a shard is drawn without the others, and the shards' counts end at slots[i] for source i.
    """
    total = int(slots.sum())
    lo, hi = 0, -(-total // per_shard)
    first, own = np.zeros(len(slots), np.int64), slots.astype(np.int64).copy()
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = shared_out(own, (mid - lo) * per_shard, np.random.default_rng((seed, lo, hi)))
        if shard < mid:
            own, hi = left, mid
        else:
            first, own, lo = first + left, own - left, mid
    return first, own


def drawn(slots: np.ndarray, seed: int, per_shard: int) -> Iterator[tuple[int, int, int, int]]:
    """(shard, source, first slot, slots) of all shards."""
    for shard in range(-(-int(slots.sum()) // per_shard)):
        first, own = draw(slots, shard, seed, per_shard)
        yield from ((shard, int(i), int(first[i]), int(own[i])) for i in np.flatnonzero(own))


def _mixed64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The image of each index below its size under the permutation of that key.

    A Feistel network over the next power of four; images beyond the size go through it again.
    """
    x, size, key = index.astype(np.uint64), size.astype(np.uint64), key.astype(np.uint64)
    half = np.maximum(np.ceil(np.log2(np.maximum(size, 2).astype(float)) / 2), 1).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    todo = np.ones(len(x), bool)
    with np.errstate(over="ignore"):
        while todo.any():
            h, m, k = half[todo], low[todo], key[todo]
            left, right = x[todo] >> h, x[todo] & m
            for r in range(4):
                left, right = right, left ^ (_mixed64(right + k + np.uint64(r + 1) * np.uint64(0x9E3779B97F4A7C15)) & m)
            x[todo] = (left << h) | right
            todo = x >= size
    return x.astype(np.int64)


@F.pandas_udf(T.LongType())
def _block_of(slot: pd.Series, blocks: pd.Series, source_no: pd.Series, seed: pd.Series) -> pd.Series:
    k, n = slot.to_numpy(np.int64), blocks.to_numpy(np.int64)
    with np.errstate(over="ignore"):
        key = _mixed64(seed.to_numpy(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + source_no.to_numpy(np.int64).astype(np.uint64) * np.uint64(1 << 32) + (k // n).astype(np.uint64))
    return pd.Series(permuted(k % n, n, key))


def slots(spark: SparkSession, known: DataFrame, seed: int, block: int = BLOCK) -> DataFrame:
    """shard, source_no, slot, block: the mix. known has source_no, source_size and target of each source."""
    rows = known.where("source_size > 0").select("source_no", "source_size", "target").orderBy("source_no").collect()  # a row for each source
    empty = "shard long, source_no int, first long, n long, blocks long"
    if not rows:
        return spark.createDataFrame([], empty).select("shard", "source_no", F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("block"))
    size = np.array([r["source_size"] for r in rows], np.int64)
    blocks = -(-size // block)
    want = np.minimum(np.rint(np.array([r["target"] for r in rows]) / (size / blocks)).astype(np.int64), MOST * blocks)
    per_shard = max(SLOTS, -(-int(want.sum()) // SHARDS))
    number = np.array([r["source_no"] for r in rows], np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in b.column(0).to_pylist():
                first_slot, own = draw(want, shard, seed, per_shard)
                at = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard)), pa.array(number[at]), pa.array(first_slot[at]), pa.array(own[at]), pa.array(blocks[at])], ["shard", "source_no", "first", "n", "blocks"])

    plan = spark.range(-(-int(want.sum()) // per_shard)).mapInArrow(run, empty)
    runs = plan.select("shard", "source_no", "first", "n", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))).alias("lo"))
    each = runs.select("shard", "source_no", "blocks", F.explode(F.sequence(F.col("first") + F.col("lo"), F.col("first") + F.least(F.col("lo") + RUN, F.col("n")) - 1)).alias("slot"))
    return each.select("shard", "source_no", "slot", _block_of("slot", "blocks", "source_no", F.lit(seed)).alias("block"))


def _pieces(rows: DataFrame, times: DataFrame, block: int) -> DataFrame:
    """Rows of placed(), one for each block that a document has words in, with lo, hi (words of the
    document) and n (how often the mix takes them)."""
    last = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)))
    p = rows.withColumn("block", F.explode_outer(last))
    p = p.withColumns({"lo": F.greatest(F.lit(0), F.col("block") * block - F.col("start")), "hi": F.least(F.col("size"), (F.col("block") + 1) * block - F.col("start"))})
    # Spark takes the blocks of all shards for as few rows as there are shards, and would broadcast them
    return p.join(times.hint("merge"), ["source_no", "block"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def _times(spark: SparkSession, rows: DataFrame, seed: int, block: int) -> DataFrame:
    known = rows.groupBy("source_no").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    return slots(spark, known, seed, block).groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("n"))


def taken(spark: SparkSession, docs: DataFrame, seed: int = 1, block: int = BLOCK, text: str = "text", source: str = "source", id_col: str = "doc_id") -> DataFrame:
    """doc_id, source, size, source_size, target and taken, the words that the mix takes of each document."""
    rows = stored(placed(stored(sized(docs, text, source, id_col, [text, source, id_col]), spark)), spark)
    p = _pieces(rows, _times(spark, rows, seed, block), block)
    first = [F.first(c).alias(c) for c in ("doc_id", "source", "size", "source_size", "target")]
    by = p.groupBy("k1", "k2", "unit").agg(*first, F.coalesce(F.sum(F.col("n") * (F.col("hi") - F.col("lo"))), F.lit(0)).cast("long").alias("taken"))
    return by.drop("k1", "k2", "unit")


def mixed(spark: SparkSession, docs: DataFrame, seed: int = 1, block: int = BLOCK, text: str = "text", source: str = "source", id_col: str = "doc_id") -> DataFrame:
    """The mix as documents: a row for each time that the mix comes to words of a document.

    The c-th row of a document holds its text without the words that the mix takes less than c
    times; a document that is taken as a whole keeps its text as it is. Texts are shuffled once, to the cuts of their key; rows that
    are the same in all columns are one there.
    """
    rows = stored(placed(stored(sized(docs, text, source, id_col, docs.columns), spark)), spark)
    p = _pieces(rows, _times(spark, rows, seed, block), block).where("n > 0")
    copies = p.select("k1", "k2", "unit", "size", "lo", "hi", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    part = copies.groupBy("k1", "k2", "unit", "copy").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("parts"), (F.sum(F.col("hi") - F.col("lo")) == F.first("size")).alias("whole"))
    k1, k2 = keys(docs, docs.columns)
    own = docs.select(k1.alias("k1"), k2.alias("k2"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    out = own.groupBy("k1", "k2").agg(F.first("doc").alias("doc")).join(part, ["k1", "k2"])
    ws = words(F.col(f"doc.`{text}`"))
    cut = let(ws, lambda w: F.array_join(F.flatten(F.transform("parts", lambda x: F.slice(w, x["lo"].cast("int") + 1, (x["hi"] - x["lo"]).cast("int")))), " "))
    new = F.when(F.col("whole"), F.col(f"doc.`{text}`")).otherwise(cut)
    return out.select(*[new.alias(c) if c == text else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
