"""Exact deduplication against a persistent index of digests.

The index is a table that Spark keeps bucketed and sorted by digest, at a path of its own; another
session that is given the path finds it again. A batch is first reduced to one row for each digest
(partial sums before the shuffle, so a group of copies of any size costs a row a task), then joined
to the index by sort-merge anti-join; only the new digests are appended. Because both sides have a
digest once, neither has hot keys. The way back from digests to rows has the copies on its left
side: the digests with more than a thousandth of the batch's rows, fewer than a thousand, are
answered by a broadcast, and their rows are spread over all tasks of the join.

All of it is DataFrame functions.

Texts are equal when they are identical after lower-casing A-Z; a null text counts as empty.
Within a batch the largest doc_id stays (a null doc_id only where a group has no other; of rows
that repeat this doc_id too, all carry it as keep_id and are kept). A digest that is in the index
already keeps its earlier doc_id. An empty batch changes nothing. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ascii_lower, heavy_keys, spread_join, stored

INDEX = "text_sha256 string, keep_id long, group_size long"


class DigestIndex:
    """The table `name` at `path`: text_sha256, keep_id, group_size, one row for each text seen.

    A path that holds no index yet gets an empty one. The name stands for the path last given.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 64):
        self.spark, self.name, self.buckets = spark, name, buckets
        if spark.catalog.tableExists(name):
            if spark.catalog.getTable(name).tableType != "EXTERNAL":
                raise ValueError(f"{name} is a table of another kind")
            spark.sql(f"DROP TABLE {name}")  # the entry; the files at its path stay
        spark.sql(f"CREATE TABLE {name} ({INDEX}) USING parquet CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {buckets} BUCKETS LOCATION '{path}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, facts: DataFrame) -> DataFrame:
        """Adds the digests that the index lacks; facts has a digest once. Returns the new index."""
        new = facts.join(self.rows().hint("merge"), "text_sha256", "left_anti")
        new = new.repartition(self.buckets, "text_sha256")  # a file for each bucket
        new.write.format("parquet").bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").mode("append").saveAsTable(self.name)
        return self.rows()


def digested(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and text_sha256 of each row."""
    norm = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(norm, 256).alias("text_sha256"))


def facts(digests: DataFrame) -> DataFrame:
    """For each digest the doc_id that stays and how many rows have it."""
    return digests.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def dedup(spark: SparkSession, docs: DataFrame, index: DigestIndex, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Appends a batch to the index; returns doc_id, keep_id, group_size, kept, text_sha256 of each row.

    group_size is the group's size in the batch that brought its digest.
    """
    rows = digested(docs, text, id_col)
    found = stored(facts(rows), spark)
    known = index.append(found)
    heavy = heavy_keys(found, "text_sha256", "group_size", found.agg(F.sum("group_size")).first()[0] or 0)
    out = spread_join(rows, known, "text_sha256", heavy)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
