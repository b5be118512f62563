"""Histories of batches in any order against one pass."""

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tallyloom.operators.history import RunHistory

SCHEMA = "run string, history_id string, attempt long, start long, duration long, status string, other string"


def attempts(seed, n):
    r = random.Random(seed)
    rows = [(f"2024-01-0{r.randrange(1, 6)}", f"t{r.randrange(12)}" if r.random() < 0.5 else "hot", k, r.randrange(300), r.randrange(50), r.choice(["passed", "passed", "failed", "broken", None]), "x") for k in range(n)]
    return rows + [(None, "t1", 1, 1, 1, "passed", "x"), ("2024-01-01", None, 2, 1, 1, "passed", "x")]


def plain(rows):
    tests = {}
    for run, test, attempt, start, duration, status, _ in rows:
        if run is not None and test is not None:
            tests.setdefault((run, test), {})[attempt] = (start, attempt, duration, status)
    out = {}
    for run in sorted({k[0] for k in tests}):
        own = [list(v.values()) for k, v in tests.items() if k[0] == run]
        last = [max(v, key=lambda x: x[:2]) for v in own]
        out[run] = {s: sum(x[3] == s for x in last) for s in ("failed", "broken", "passed", "skipped", "unknown")}
        out[run] |= {"total": len(own), "retries": sum(len(v) - 1 for v in own), "changed": sum(len({x[3] for x in v}) > 1 for v in own)}
        out[run] |= {"wall": max(x[0] + x[2] for x in last) - min(x[0] for x in last), "shortest": min(x[2] for x in last), "longest": max(x[2] for x in last), "time": sum(x[2] for x in last)}
    return out


def read(trend):
    return {r["run"]: {k: v for k, v in r.asDict().items() if k != "run" and not k.endswith("_before")} for r in trend.collect()}


@pytest.mark.parametrize("order", list(permutations(range(3)))[::2])
def test_batches_in_any_order(spark, tmp_path, order):
    rows = attempts(1, 400)
    h = RunHistory(spark, f"file://{tmp_path}/h")
    seen = []
    for version, k in enumerate(order):
        part = rows[k::3]
        seen += part
        assert h.apply(f"b{k}", spark.createDataFrame([*part, part[0]], SCHEMA)) == version + 1
        assert read(h.trend()) == plain(seen)
    assert read(h.trend(1)) == plain(rows[order[0] :: 3])  # as it was
    assert h.apply("b1", spark.createDataFrame(rows, SCHEMA)) == order.index(1) + 1 and h.version() == 3
    assert read(h.trend()) == plain(rows)


def test_only_touched_runs_are_written(spark, tmp_path):
    h = RunHistory(spark, f"file://{tmp_path}/h")
    assert h.version() == 0 and h.trend().count() == 0 and h.changes().count() == 0
    h.apply("a", spark.createDataFrame([("1", "x", 1, 5, 1, "passed", ""), ("2", "x", 2, 9, 1, "passed", "")], SCHEMA))
    h.apply("late", spark.createDataFrame([("1", "x", 3, 7, 1, "failed", ""), ("1", "x", 4, 1, 1, "broken", "")], SCHEMA))
    commits = h.log().where("run is not null").groupBy("run").agg(F.count_distinct("commit").alias("n"))
    assert {r["run"]: r["n"] for r in commits.collect()} == {"1": 2, "2": 1}
    assert {tuple(r) for r in h.latest().select("run", "status", "retries", "changed").collect()} == {("1", "failed", 2, True), ("2", "passed", 0, False)}
    assert {(r["run"], r["before"], r["change"]) for r in h.changes().collect()} == {("1", None, "new"), ("2", "failed", "mended")}
    assert {(r["run"], r["change"]) for r in h.changes(1).collect()} == {("1", "new")}
    assert h.apply("none", spark.createDataFrame([], SCHEMA)) == 3 and h.trend().count() == 2


def test_what_an_ended_batch_left_is_not_seen(spark, tmp_path, monkeypatch):
    h = RunHistory(spark, f"file://{tmp_path}/h")
    rows = spark.createDataFrame([("1", "x", 1, 5, 1, "passed", "")], SCHEMA)
    write = RunHistory._write
    monkeypatch.setattr(RunHistory, "_write", lambda self, what, *a: 1 / 0 if what == "totals" else write(self, what, *a))
    with pytest.raises(ZeroDivisionError):
        h.apply("a", rows)
    monkeypatch.undo()
    assert h.version() == 0 and h.latest().count() == 0
    assert h.apply("a", rows) == 1 and h.latest().first()["retries"] == 0
