"""Sessions of a stream of events, with late rows counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.files import scratch


def sessions(events: DataFrame, key: str, time: str, gap: str, delay: str) -> DataFrame:
    """key, begin, end (the last event and the gap) and n of each session: events of a key that are less than the gap apart.

    events is a stream. A session is given once no event can join it any more: when the largest time seen, less the delay, has
    reached its end. Rows that come after that for their own time are late and are left out. Rows with a null time belong to no session.
    """
    w = F.session_window(time, gap)
    timed = events.where(F.col(time).isNotNull()).withWatermark(time, delay)
    return timed.groupBy(key, w.alias("session")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session.start").alias("begin"), F.col("session.end").alias("end"), "n")


def run_available(spark: SparkSession, stream: DataFrame, path: str | None = None) -> tuple[DataFrame, int]:
    """Runs a stream over all that is there now, in as many batches as its source makes, and ends. Returns what it has given, and how
    many rows (partly aggregated ones of a batch) were too late. State and output are in the shared folder, so another call with the same path goes on from there."""
    path = path or scratch(spark)
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    late = sum(int(op.numRowsDroppedByWatermark) for p in query.recentProgress for op in p.stateOperators)
    return spark.read.schema(stream.schema).parquet(f"{path}/out"), late
