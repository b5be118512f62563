"""The driver's tables in the roles of the studied data. This is an analogy, not its data.

Orders are tasks, customers their owners, an order's year its sprint; events are attempts of a test
(a user's day); parts are the catalogue, an order's lines a cart; event properties, documents and
conversations are bodies and steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "1998-06-01"
SPRINT = 1997


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, sf_dir: str, sprint: int | None = None) -> DataFrame:
    """All tasks, or those of one sprint: a range of dates, which the scan can skip row groups by."""
    o = read(spark, sf_dir, "orders")
    if sprint is not None:
        o = o.where((F.col("o_orderdate") >= F.lit(f"{sprint}-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit(f"{sprint + 1}-01-01").cast("timestamp_ntz")))
    status = F.when(F.col("o_orderstatus") == "F", "Done").when(F.col("o_orderstatus") == "O", "To-Do").otherwise("Pending")
    priority = F.when(F.col("o_orderpriority") == "2-HIGH", "High").when(F.col("o_orderpriority") == "3-MEDIUM", "Medium").otherwise("Low")
    return o.select(F.col("o_orderkey").alias("task"), F.col("o_custkey").alias("owner"), F.year("o_orderdate").alias("sprint"), priority.alias("priority"), status.alias("status"), F.to_date("o_orderdate").alias("start"))


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """start is in microseconds, duration in thousandths of the event's value."""
    e = read(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    day = F.date_format("ts", "yyyy-MM-dd")
    status = F.when(F.col("event_type") == "error", "failed").otherwise("passed")
    return e.select(
        F.concat_ws("/", F.col("user_id").cast("string"), day).alias("history_id"),
        F.col("event_id").alias("attempt"),
        F.unix_micros(ts).alias("start"),
        F.floor(F.col("value") * 1000).cast("long").alias("duration"),
        status.alias("status"),
        F.concat(F.lit("epic"), (F.col("user_id") % 3).cast("string")).alias("epic"),
        F.concat(F.lit("feature"), (F.col("user_id") % 12).cast("string")).alias("feature"),
        F.col("event_type").alias("story"),
        F.array(F.struct(F.lit("epic").alias("name"), F.concat(F.lit("epic"), (F.col("user_id") % 3).cast("string")).alias("value")), F.struct(F.lit("story").alias("name"), F.col("event_type").alias("value"))).alias("labels"),
    )
