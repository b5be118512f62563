"""F1 over a large catalogue: a stored index of trigrams.

Each name is stored under every three characters of it in lower case, sorted by these. A search reads the rows of the
term's trigrams only, which the files' statistics let it find, keeps the names that have all of them, and
verifies these. So it reads a part of the names, and gives what a scan of all would. Terms of less than
three characters have no trigram: all names are scanned for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import rules as R
from tallyloom.sources.files import scratch


class NameIndex:
    """An index at a path. Rows that repeat a key and name are one; a null name is never found; other columns are not kept."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    @classmethod
    def built(cls, items: DataFrame, key: str, name: str, path: str | None = None) -> NameIndex:
        spark = items.sparkSession
        path = path or scratch(spark)
        names = items.select(F.col(key).alias("key"), F.col(name).alias("name")).distinct()
        low = F.lower("name")
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda i: F.substr(low, i, F.lit(3))))
        rows = names.select("key", "name", F.explode(grams).alias("gram"))
        # a frequent trigram's rows lie in several ranges, dealt by name
        rows.repartitionByRange("gram", "name", "key").sortWithinPartitions("gram", "name", "key").write.parquet(path)
        return cls(spark, path, f"key {dict(items.dtypes)[key]}, name string, gram string")

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def candidates(self, term: str) -> DataFrame:
        """key and name of the names that have every trigram of the term."""
        low = term.lower()
        grams = sorted({low[k : k + 3] for k in range(len(low) - 2)})
        if not grams:
            return self.rows().select("key", "name").distinct()
        hit = self.rows().where(F.col("gram").isin(grams))
        return hit.groupBy("key", "name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams)).select("key", "name")

    def search(self, term: str) -> DataFrame:
        """key and name of the names that have the term, in any case."""
        return self.candidates(term).where(R.has_text(F.col("name"), F.lit(term)))
