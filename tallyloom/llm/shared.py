"""Small helpers that several operators of this folder use."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of a text are the longest runs of other characters than these six.
SPACES = "\t\n\x0b\x0c\r "
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_own: dict[str, str] = {}


def table(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which every executor sees.

    Where the session names none, a folder of this machine serves a local master only.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _own.get("dir")
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        base = _own["dir"] = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, spark: SparkSession, path: str | None = None, compression: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage."""
    path = path or shared_dir(spark)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes what stored() wrote, once no later step reads it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def ascii_lower(c: Column) -> Column:
    """A-Z become a-z; all other characters stay."""
    return F.translate(c, UPPER, UPPER.lower())


def words(c: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), r"[\x09-\x0D\x20]+"), "")


def unused(df: DataFrame, name: str) -> str:
    """The name, with more underscores before it as long as df has a column of that name in any case."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name = f"_{name}"
    return name


def let(value: Column, body) -> Column:
    """body(value), where value is computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spread(rows: int, per_part: int, least: int = 1) -> int:
    """Partitions for so many rows."""
    return max(least, -(-rows // per_part))


SHARE = 1000


def heavy_keys(counted: DataFrame, key: str, n: str, total: int) -> list:
    """The keys with more than 1 / SHARE of `total` rows, so fewer than SHARE; counted has a key once and its rows n."""
    return [r[0] for r in counted.where(F.col(n) * SHARE > total).select(key).collect()]


def spread_join(left: DataFrame, right: DataFrame, key: str, heavy: list, nulls: bool = False) -> DataFrame:
    """left with the other columns of right, which has a key once; null where it lacks a row's key.

    Rows of heavy keys, of which there are fewer than SHARE, are answered by a broadcast and go to
    the join under made-up keys, as rows with a null key do if `nulls` may be many. So no task gets
    more rows of one key than heavy_keys() lets be.
    """
    if not heavy and not nulls:
        return left.join(right, key, "left")
    names = [c for c in right.columns if c != key]
    few = right.where(F.col(key).isin(heavy)).select(F.col(key).alias("_heavy"), *[F.col(c).alias(f"_heavy_{c}") for c in names])
    made_up = F.xxhash64(F.monotonically_increasing_id()).cast("string").cast(left.schema[key].dataType)
    marked = left.join(F.broadcast(few), F.col(key) == F.col("_heavy"), "left").withColumn("_key", F.when(F.col("_heavy").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(made_up))
    other = right.select(F.col(key).alias("_right"), *[F.col(c).alias(f"_right_{c}") for c in names])
    out = marked.join(other, F.col("_key") == F.col("_right"), "left")
    return out.select(*left.columns, *[F.when(F.col(key).isNull(), None).when(F.col("_heavy").isNull(), F.col(f"_right_{c}")).otherwise(F.col(f"_heavy_{c}")).alias(c) for c in names])


WORDS_OF_BITS = 1 << 19


def sieved(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows without most of those whose key, a 64-bit hash, is not in keys; a semi-join of what is left is exact.

    A bit is set for each key in a broadcast table of WORDS_OF_BITS longs at most, whatever the number of keys.
    """
    word = lambda: F.pmod(F.col(key), F.lit(WORDS_OF_BITS)).cast("int").alias("_word")
    bit = F.shiftrightunsigned(F.col(key), 32).bitwiseAND(63).cast("int")
    bits = keys.select(word(), bit.alias("_bit")).groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits"))
    return rows.withColumn("_word", word()).join(F.broadcast(bits), "_word").where(F.getbit("_bits", bit) == 1).select(*rows.columns)
