"""Test-run records. Attempts have: history_id, attempt, start, duration, status and labels of any kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ["failed", "broken", "passed", "skipped", "unknown"]


def latest(attempts: DataFrame) -> DataFrame:
    """V1: the attempt of each history id that started last; of equal starts the larger attempt.

    An aggregate, not a window: a test with very many attempts is reduced before the shuffle.
    """
    rest = [c for c in attempts.columns if c not in ("history_id", "start", "attempt")]
    best = F.max(F.struct("start", "attempt", *rest)).alias("last")
    return attempts.groupBy("history_id").agg(best).select("history_id", *[F.col(f"last.{c}").alias(c) for c in ("start", "attempt", *rest)])


def retries(attempts: DataFrame) -> DataFrame:
    """history_id, retries and the earlier attempts, newest first."""
    all_ = F.sort_array(F.collect_list(F.struct("start", "attempt")), asc=False)
    out = attempts.groupBy("history_id").agg((F.count(F.lit(1)) - 1).alias("retries"), all_.alias("every"))
    return out.select("history_id", "retries", F.transform(F.slice("every", 2, F.greatest(F.size("every") - 1, F.lit(0))), lambda x: x["attempt"]).alias("earlier"))


def retry_totals(attempts: DataFrame) -> DataFrame:
    """A12 over all: how many tests ran and how many attempts were repeats."""
    per = attempts.groupBy("history_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("runs"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("retries"))


def status_changed(attempts: DataFrame) -> DataFrame:
    """Whether any earlier attempt ended otherwise than the latest."""
    per = attempts.groupBy("history_id").agg(F.max_by("status", F.struct("start", "attempt")).alias("status"), F.min("status").alias("a"), F.max("status").alias("b"))
    return per.select("history_id", "status", (F.col("a") != F.col("b")).alias("changed"))


def status_counts(last: DataFrame) -> DataFrame:
    """A10: a column for each status and the total, over latest attempts; absent ones are 0."""
    return last.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.count(F.lit(1)).alias("total"))


def duration_stats(last: DataFrame) -> DataFrame:
    """Wall time from first start to last stop, and the durations' min, max and sum."""
    stop = F.col("start") + F.col("duration")
    return last.agg((F.max(stop) - F.min("start")).alias("wall"), F.min("duration").alias("shortest"), F.max("duration").alias("longest"), F.sum("duration").alias("total"))


def group_counts(last: DataFrame, labels: list[str]) -> DataFrame:
    """Tests and passed tests for each combination of labels."""
    return last.groupBy(*labels).agg(F.count(F.lit(1)).alias("tests"), F.count_if(F.col("status") == "passed").alias("passed"))


def tree(last: DataFrame, labels: list[str]) -> DataFrame:
    """The counts of every node of the tree with these levels; deeper labels are null, depth says which node it is."""
    level = sum((1 - F.grouping(c).cast("int") for c in labels), F.lit(0))
    return last.rollup(*labels).agg(level.alias("depth"), F.count(F.lit(1)).alias("tests"), F.count_if(F.col("status") == "passed").alias("passed"))


def distinct_children(last: DataFrame, parent: str, child: str) -> DataFrame:
    """How many different children a parent has, not how many tests."""
    return last.groupBy(parent).agg(F.countDistinct(child).alias("children"))


def metric_lines(stats: DataFrame, prefix: str) -> DataFrame:
    """K7: a row of gauges as one row for each: name, value and the line `name value`."""
    names = stats.columns
    long = stats.select(*[F.col(c).cast("long").alias(c) for c in names]).unpivot([], names, "name", "value")
    return long.select(F.concat(F.lit(f"{prefix}_"), "name").alias("name"), "value", F.concat_ws(" ", F.concat(F.lit(f"{prefix}_"), "name"), F.col("value").cast("string")).alias("line"))


def metric_exports(groups: dict[str, DataFrame], prefix: str, at: int) -> DataFrame:
    """K7: the gauges of each group, a row each, as name, value, the line `prefix_group_name value` and the
    line protocol's `prefix_group name=value at`. Each group has one row."""
    out = None
    for group, stats in groups.items():
        long = stats.select(*[F.col(c).cast("long").alias(c) for c in stats.columns]).unpivot([], stats.columns, "gauge", "value")
        name, value = F.concat(F.lit(f"{prefix}_{group}_"), "gauge"), F.col("value").cast("string")
        rows = long.select(name.alias("name"), "value", F.concat_ws(" ", name, value).alias("line"), F.concat(F.lit(f"{prefix}_{group} "), "gauge", F.lit("="), value, F.lit(f" {at}")).alias("protocol"))
        out = rows if out is None else out.unionByName(rows)
    return out


def container_members(containers: DataFrame, results: DataFrame) -> DataFrame:
    """Containers have uuid and children; a row for each child with its result, null without one."""
    each = containers.select(F.col("uuid").alias("container"), F.explode("children").alias("uuid"))
    return each.join(results, "uuid", "left")
