"""Task trackers. Tasks have: task, owner, sprint, priority, status, start. Owners have: owner.

Text comparison is exact here, unlike in spreadsheets, whose formulas ignore case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import rules as R

PRIORITIES = ["High", "Medium", "Low"]
STATUSES = ["To-Do", "In-Progress", "Pending", "Done"]


def _counts() -> list[Column]:
    done = F.count_if(F.col("status") == R.DONE)
    return [F.count("task").alias("total"), F.count_if(F.col("priority") == R.HIGH).alias("high"), done.alias("done"), (F.count("task") - done).alias("pending")]


def counts(owners: DataFrame, tasks: DataFrame, sprint) -> DataFrame:
    """A row for each owner, those without tasks in the sprint too.

    Tasks are counted before they meet the owners, so a busy owner is a row a task of the shuffle;
    the sprint is a condition on the tasks, not on the result. `pending` is all that isn't done.
    """
    mine = tasks.where(F.col("sprint") == sprint).groupBy("owner").agg(*_counts())
    out = owners.select("owner").join(mine, "owner", "left")
    return out.select("owner", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "high", "done", "pending")])


def counts_by_sprint(owners: DataFrame, tasks: DataFrame, sprints: DataFrame) -> DataFrame:
    """A7 for every sprint of a parameter table: owner, sprint and the counts."""
    mine = tasks.join(F.broadcast(sprints), "sprint", "left_semi").groupBy("owner", "sprint").agg(*_counts())
    grid = owners.select("owner").crossJoin(F.broadcast(sprints))
    out = grid.join(mine, ["owner", "sprint"], "left")
    return out.select("owner", "sprint", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "high", "done", "pending")])


def with_total(counted: DataFrame) -> DataFrame:
    """The rows and a TOTAL row, whose high count is left blank."""
    s = counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("total", "done", "pending")])
    total = s.select(F.lit("TOTAL").alias("owner"), "total", F.lit(None).cast("long").alias("high"), "done", "pending")
    return counted.select(F.col("owner").cast("string"), "total", "high", "done", "pending").unionByName(total)


def kpis(counted: DataFrame) -> DataFrame:
    """Total, pending and the share that is done; one row."""
    s = counted.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("done"), F.lit(0)).alias("done"), F.coalesce(F.sum("pending"), F.lit(0)).alias("pending"))
    return s.select("total", R.share(F.col("done"), F.col("total")).alias("progress"), "pending")


def chart(counted: DataFrame) -> DataFrame:
    """The doughnut's two slices and the bars' three series as chart, category, series, value."""
    ring = counted.agg(F.sum("done").alias("Done"), F.sum("pending").alias("Pending")).unpivot([], ["Done", "Pending"], "series", "value")
    bars = counted.select(F.col("owner").cast("string").alias("category"), F.col("total").alias("Total"), F.col("high").alias("High"), F.col("done").alias("Done")).unpivot("category", ["Total", "High", "Done"], "series", "value")
    ring = ring.select(F.lit("doughnut").alias("chart"), F.lit("all").alias("category"), "series", "value")
    return ring.unionByName(bars.select(F.lit("bar").alias("chart"), "category", "series", "value"))


def table(tasks: DataFrame, as_of: str) -> DataFrame:
    """The task table with its computed columns."""
    t = tasks.withColumn("end", R.end_date(F.col("start")))
    t = t.withColumn("days_left", R.days_left(F.col("status"), F.col("end"), F.lit(as_of).cast("date")))
    t = t.withColumn("flag", R.flag(F.col("days_left"), F.col("status"), F.col("priority")))
    return t.withColumns({"label": R.task_id(F.col("task")), "colour": R.colour(F.col("status"), F.col("flag"))})


def domain_check(tasks: DataFrame) -> DataFrame:
    """how many tasks have values of the lists and how many don't; null is in no list."""
    ok = F.coalesce(F.col("priority").isin(PRIORITIES) & F.col("status").isin(STATUSES), F.lit(False))
    return tasks.groupBy(F.when(ok, "valid").otherwise("rejected").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
