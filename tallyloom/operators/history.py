"""Run-over-run history, kept up to date batch by batch.

A batch holds attempts (run, history_id, attempt, start, duration, status) of any runs, late ones for
earlier runs too. The state has, for each test of a run and each status, the latest attempt and how many there were. A
batch is reduced to that first; then only the runs that it touches are read, merged and written anew, with
their totals. Merging takes the larger (start, attempt) and adds counts, so batches may come in any order
and give what one pass over all of them gives.

Nothing is written over: a run's files are kept under the commit that wrote them, and the log, written last, says
which commit is a run's in which version. So what an ended attempt to apply a batch has left is never seen,
a batch's name is applied once, and every earlier version can be read.

Nulls and other cases: rows without a run or a history_id are no attempts and are left out. An attempt that a batch
repeats counts once; one that comes in two batches counts twice, so batches are named. Other columns are
ignored. An empty batch makes a version without changes. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runs import STATUSES

_LAST = "struct<start: long, attempt: long, duration: long, status: string>"
STATE = f"history_id string, each array<struct<status: string, last: {_LAST}, attempts: long>>, run string, commit string"
TOTALS = f"{', '.join(f'{s} long' for s in STATUSES)}, total long, retries long, changed long, first_start long, last_stop long, shortest long, longest long, time long, run string, commit string"
LOG = "batch string, version long, commit string, run string"


def joined(parts: DataFrame) -> DataFrame:
    """The state of each run and test: of every status its last attempt and how many there were."""
    by = parts.groupBy("run", "history_id", "status").agg(F.max("last").alias("last"), F.sum("attempts").alias("attempts"))
    return by.groupBy("run", "history_id").agg(F.sort_array(F.collect_list(F.struct("status", "last", "attempts"))).alias("each"))


def latest_of(states: DataFrame) -> DataFrame:
    """The latest attempt of each run and test, its retries and whether any attempt ended otherwise."""
    last = F.array_max(F.transform("each", lambda e: e["last"]))
    n = F.aggregate("each", F.lit(0).cast("long"), lambda a, e: a + e["attempts"])
    return states.withColumns({"last": last, "n": n}).select("run", "history_id", "last.start", "last.attempt", "last.duration", "last.status", (F.col("n") - 1).alias("retries"), (F.size("each") > 1).alias("changed"))


def totals_of(states: DataFrame) -> DataFrame:
    """A row of totals for each run."""
    stop = F.col("start") + F.col("duration")
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return latest_of(states).groupBy("run").agg(*counts, F.count(F.lit(1)).alias("total"), F.sum("retries").alias("retries"), F.count_if("changed").alias("changed"), F.min("start").alias("first_start"), F.max(stop).alias("last_stop"), F.min("duration").alias("shortest"), F.max("duration").alias("longest"), F.sum("duration").alias("time"))


class RunHistory:
    """A history at a path that all executors see."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, what: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{what}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def log(self) -> DataFrame:
        """batch, version, commit and run; a version without changes has a null run."""
        return self._read("log", LOG)

    def version(self) -> int:
        """The last version; 0 of a new history."""
        return self.log().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def _of(self, what: str, schema: str, version: int | None) -> DataFrame:
        """Rows of the commits that are the runs' in a version."""
        log = self.log().where("run is not null")
        log = log if version is None else log.where(F.col("version") <= version)
        now = log.groupBy("run").agg(F.max_by("commit", "version").alias("commit"))
        return self._read(what, schema).join(now, ["run", "commit"], "left_semi")

    def apply(self, batch: str, attempts: DataFrame) -> int:
        """Adds a batch; returns the version that has it. A batch that is there already changes nothing."""
        there = self.log().where(F.col("batch") == batch).agg(F.min("version")).first()[0]
        if there is not None:
            return there
        commit, version = uuid.uuid4().hex, self.version() + 1
        rows = attempts.where("run is not null and history_id is not null").select(F.col("run").cast("string").alias("run"), F.col("history_id").cast("string").alias("history_id"), "attempt", "start", "duration", "status")
        own = rows.dropDuplicates(["run", "history_id", "attempt"])
        last = F.struct("start", "attempt", "duration", "status").cast(_LAST)
        new = own.select("run", "history_id", "status", last.alias("last"), F.lit(1).cast("long").alias("attempts"))
        runs = rows.select("run").distinct()
        old = self.states().join(runs, "run", "left_semi").select("run", "history_id", F.explode("each").alias("e"))
        self._write("state", joined(old.select("run", "history_id", "e.status", "e.last", "e.attempts").unionByName(new)), commit)
        self._write("totals", totals_of(self._read("state", STATE).where(F.col("commit") == commit)), commit)
        done = runs.withColumns({"batch": F.lit(batch), "version": F.lit(version).cast("long"), "commit": F.lit(commit)})
        none = self.spark.createDataFrame([(batch, version, commit, None)], LOG)
        done.unionByName(none).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        return version

    def _write(self, what: str, rows: DataFrame, commit: str) -> None:
        # few files for each run, and a run with most of the rows in several tasks
        rows.withColumn("commit", F.lit(commit)).hint("rebalance", "run").write.mode("append").partitionBy("run", "commit").parquet(f"{self.path}/{what}")

    def states(self, version: int | None = None) -> DataFrame:
        return self._of("state", STATE, version)

    def latest(self, version: int | None = None) -> DataFrame:
        """The latest attempt of each run and test in a version, as latest_of()."""
        return latest_of(self.states(version))

    def trend(self, version: int | None = None) -> DataFrame:
        """The totals of each run in a version, with wall time and the totals of the run before."""
        t = self._of("totals", TOTALS, version)
        before = Window.orderBy("run")  # a row for each run
        return t.withColumn("wall", F.col("last_stop") - F.col("first_start")).withColumns({f"{c}_before": F.lag(c).over(before) for c in ("passed", "failed", "total")}).drop("commit", "first_start", "last_stop")

    def changes(self, version: int | None = None) -> DataFrame:
        """run, history_id, status, before and change of each test whose status isn't that of its run before: broken now,
        mended, new or otherwise."""
        w = Window.partitionBy("history_id").orderBy("run")
        bad = lambda c: F.col(c).isin("failed", "broken")
        rows = self.latest(version).select("run", "history_id", "status", F.lag("status").over(w).alias("before"), F.lag("run").over(w).alias("last_run"))
        kind = F.when(F.col("last_run").isNull(), "new").when(bad("status") & ~bad("before"), "broke").when(~bad("status") & bad("before"), "mended").when(F.col("status") != F.col("before"), "other")
        return rows.withColumn("change", kind).where("change is not null").drop("last_run")
