"""The queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import class_lm, exact_dedup, hard_negatives, lexical_search, line_join, lsh_forest, mixing, nb_svm, packing, quality_rules, simhash_join, token_files, warc
from .oracles import ORACLES
from .shared import shared_dir, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_rules.ledger(spark.read.parquet(table(sf_dir, "documents")))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.passes(quality_rules.BASE)).alias("base_failed"),
        quality_rules.passes(quality_rules.CURRENT).alias("kept"),
        "failures",
        F.lit(quality_rules.CURRENT.version).cast("long").alias("policy_version"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(spark, spark.read.parquet(table(sf_dir, "documents")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, spark.read.parquet(table(sf_dir, "pages")))


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.scored(spark, spark.read.parquet(table(sf_dir, "documents")))


def op5_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_join.by_document(spark, spark.read.parquet(table(sf_dir, "documents")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(table(sf_dir, "documents"))
    return mixing.taken(spark, docs).select("doc_id", "size", "source_size", "target", "taken")


def op7_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.linked(spark, spark.read.parquet(table(sf_dir, "documents"))).drop("text_id")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, "document_digests", shared_dir(spark), buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    return exact_dedup.dedup(spark, spark.read.parquet(table(sf_dir, "documents")), index)


def op9_nb_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(table(sf_dir, "documents"))
    model = nb_svm.trained(docs, spark.read.parquet(table(sf_dir, "labels")))
    return nb_svm.scored(spark, docs, model)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(spark, spark.read.parquet(table(sf_dir, "documents")))


def op11_simhash_gph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_join.linked(spark, spark.read.parquet(table(sf_dir, "documents")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(table(sf_dir, "embeddings"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(spark, rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.Index.built(spark, spark.read.parquet(table(sf_dir, "documents")))
    return index.ranked(spark.read.parquet(table(sf_dir, "benchmark")))


def queries() -> dict:
    first = (op1_quality_rules, op2_packing, op3_warc, op4_class_lm, op5_line_join, op6_mixing, op7_lsh_forest, op8_exact_dedup, op9_nb_svm, op10_token_files)
    return {f.__name__: f for f in (*first, op11_simhash_gph, op12_hard_negatives, op13_lexical_search)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
