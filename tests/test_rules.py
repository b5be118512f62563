"""The rules on hand-written rows; each trap of the survey has a test."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import rules as R
from tallyloom.operators import catalogue as C
from tallyloom.operators import harness as H
from tallyloom.operators import runs, tasks

DAY = dt.date(2024, 3, 1)


def one(spark, **columns):
    """The values of the columns over one row."""
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.fixture(scope="module")
def board(spark):
    rows = [(1, "a", 1, "High", "Done", DAY), (2, "a", 1, "Low", "To-Do", DAY), (3, "a", 1, "High", "In-Progress", DAY), (4, "b", 2, "High", "Pending", DAY), (5, "a", 2, "Low", "Done", None)]
    t = spark.createDataFrame(rows, "task long, owner string, sprint int, priority string, status string, start date")
    return spark.createDataFrame([("a",), ("b",), ("c",)], "owner string"), t


def test_owners_without_tasks_have_rows(board):
    got = {r["owner"]: tuple(r)[1:] for r in tasks.counts(*board, 1).collect()}
    assert got == {"a": (3, 2, 1, 2), "b": (0, 0, 0, 0), "c": (0, 0, 0, 0)}


def test_pending_is_all_that_is_not_done(board):
    assert tasks.counts(*board, 1).where("owner = 'a'").first()["pending"] == 2  # none has the status Pending


def test_total_row_has_no_high(board):
    got = tasks.with_total(tasks.counts(*board, 1)).where("owner = 'TOTAL'").first()
    assert tuple(got) == ("TOTAL", 3, None, 1, 2)


def test_kpis_of_nothing(board):
    owners, t = board
    assert tuple(tasks.kpis(tasks.counts(owners, t, 99)).first()) == (0, 0.0, 0)
    assert tuple(tasks.kpis(tasks.counts(owners.where("false"), t, 1)).first()) == (0, 0.0, 0)


def test_table(board):
    got = {r["task"]: (r["days_left"], r["flag"], r["colour"]) for r in tasks.table(board[1], "2024-03-12").collect()}
    assert got == {1: (0, "OK", "green"), 2: (-1, "OVERDUE", "red"), 3: (-1, "OVERDUE", "red"), 4: (-1, "OVERDUE", "red"), 5: (0, "OK", "green")}
    later = {r["task"]: r["flag"] for r in tasks.table(board[1], "2024-03-11").collect()}
    assert later == {1: "OK", 2: "OK", 3: "ATTENTION", 4: "ATTENTION", 5: "OK"}


def test_no_end_is_never_overdue(spark):
    r = one(spark, a=R.flag(F.lit(None).cast("int"), F.lit("To-Do"), F.lit("High")), b=R.flag(F.lit(None).cast("int"), F.lit("To-Do"), F.lit("Low")), c=R.days_left(F.lit("To-Do"), F.lit(None).cast("date"), F.lit(DAY)))
    assert tuple(r) == ("ATTENTION", "OK", None)


def test_null_is_in_no_list(spark):
    t = spark.createDataFrame([("High", "Done"), ("Urgent", "Done"), (None, "Done"), ("Low", None)], "priority string, status string")
    assert {r["outcome"]: r["n"] for r in tasks.domain_check(t).collect()} == {"valid": 1, "rejected": 3}


def test_scalars(spark):
    r = one(
        spark,
        short=R.summary(F.lit("ab")), long=R.summary(F.lit("x" * 600)), null=R.summary(F.lit(None).cast("string")),
        men=R.has_text(F.lit("WOMEN"), F.lit("men")), price=R.price(F.lit("Rs. 500")), none=R.price(F.lit("Rs.")),
        code=R.title_code(F.lit("mR")), other=R.title_code(F.lit(None).cast("string")),
        detail=R.detail({"Params": F.lit("p"), "Data": F.lit(None).cast("string"), "JSON": F.lit(1)}),
        body=R.json_or_raw(F.lit('{"k": 1, "z": 2}'), "k int, z int"), raw=R.json_or_raw(F.lit("no {"), "k int"),
        done=R.percent(F.lit("Done"), F.lit(0.5)), doing=R.percent(F.lit("In-Progress"), F.lit(0.456)),
        light=R.next_light(F.lit("yellow")), all_=R.contains_all(F.lit("a b"), F.array(F.lit("a"), F.lit(None).cast("string"))),
        email=R.timed_email(F.lit("u"), F.timestamp_seconds(F.lit(7)), "e.org"), chosen=R.chosen({"a": F.lit(True), "b": F.lit(None).cast("boolean"), "c": F.lit(True)}),
    )
    assert r["short"] == "ab..." and r["long"] == "x" * 500 + "..." and r["null"] is None
    assert r["men"] and r["price"] == 500.0 and r["none"] is None and (r["code"], r["other"]) == (1, 2)
    assert r["detail"] == "Params: p\nJSON: 1" and r["body"] == '{"k":1,"z":2}' and r["raw"] == "no {"
    assert (r["done"], r["doing"], r["light"], r["all_"], r["email"]) == (1.0, 0.46, "red", False, "u+7@e.org") and r["chosen"] == ["a", "c"]
    names = spark.range(50).select(R.random_name().alias("n")).collect()
    assert len({x["n"] for x in names}) == 50 and all(len(x["n"]) == 15 for x in names)


@pytest.fixture(scope="module")
def attempts(spark):
    rows = [("t1", 1, 100, 5, "failed", "e", "f1"), ("t1", 2, 200, 6, "passed", "e", "f1"), ("t1", 3, 300, 7, "passed", "e", "f1"), ("t2", 4, 150, 9, "passed", "e", "f1"), ("t3", 5, 10, 1, "failed", "e", "f2"), ("t3", 6, 10, 2, "failed", "e", "f2")]
    return spark.createDataFrame(rows, "history_id string, attempt long, start long, duration long, status string, epic string, feature string")


def test_runs(attempts):
    last = runs.latest(attempts)
    assert {r["history_id"]: r["attempt"] for r in last.collect()} == {"t1": 3, "t2": 4, "t3": 6}
    assert {r["history_id"]: (r["retries"], r["earlier"]) for r in runs.retries(attempts).collect()} == {"t1": (2, [2, 1]), "t2": (0, []), "t3": (1, [5])}
    assert {r["history_id"]: r["changed"] for r in runs.status_changed(attempts).collect()} == {"t1": True, "t2": False, "t3": False}
    assert tuple(runs.status_counts(last).first()) == (1, 0, 2, 0, 0, 3)
    assert tuple(runs.duration_stats(last).first()) == (307 - 10, 2, 9, 18)
    assert runs.distinct_children(last, "epic", "feature").first()["children"] == 2  # of three tests
    assert tuple(runs.retry_totals(attempts).first()) == (3, 3)
    tree = {(r["epic"], r["feature"], r["depth"]): (r["tests"], r["passed"]) for r in runs.tree(last, ["epic", "feature"]).collect()}
    assert tree == {(None, None, 0): (3, 2), ("e", None, 1): (3, 2), ("e", "f1", 2): (2, 2), ("e", "f2", 2): (1, 0)}
    lines = {r["line"] for r in runs.metric_lines(runs.status_counts(last), "launch").collect()}
    assert "launch_failed 1" in lines and len(lines) == 6


def test_positions(spark):
    rows = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2)], "g string, n int")
    by = [F.col("n")]
    assert C.nth(rows, by, 1).first()["n"] == 2 and C.nth(rows, by, 9).count() == 0
    assert C.nth_strict(rows, by, 2).first()["n"] == 3
    with pytest.raises(Exception, match="no row at position 3"):
        C.nth_strict(rows, by, 3).collect()
    assert {(r["g"], r["n"]) for r in C.second_else_first(rows, by, ["g"]).collect()} == {("a", 3), ("b", 2)}
    assert {(r["g"], r["n"]) for r in C.without_nth(rows, by, ["g"], 1).collect()} == {("a", 1), ("b", 2)}
    assert {r["g"]: r["one_less"] for r in C.delta(rows, C.without_nth(rows, by, ["g"], 0), "g").collect()} == {"a": True, "b": True}


def test_sets(spark):
    a = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "k int, v int")
    b = spark.createDataFrame([(2, 6), (3, 8), (4, 9)], "k int, v int")
    assert {r["k"]: r["change"] for r in C.snapshot_diff(a, b, ["k"], "v").collect()} == {1: "removed", 3: "changed", 4: "added"}
    assert tuple(C.add_all(a, b.union(b), "k").first()) == (3, 2)
    assert [r["k"] for r in C.unmatched(a, b, ["k", "v"]).orderBy("k").collect()] == [1, 3]
    assert [r["v"] for r in C.duplicates(a.union(a.withColumn("v", F.col("v") + 1)), "k", [F.col("v")]).orderBy("v").collect()] == [6, 7, 8]


def test_markup(spark):
    p = spark.createDataFrame([(1, '<nav><a href="/x">x</a></nav><a href="/y">y</a>'), (2, "")], "page_id int, html string")
    assert [(r["position"], r["href"]) for r in H.links(p, "html").collect()] == [(0, "/x"), (1, "/y")]
    got = p.select(H.first_of(H.scoped(F.col("html"), "aside"), F.lit("other")).alias("h"), H.scoped(F.col("html"), "nav").alias("n")).first()
    assert got["h"] == "other" and got["n"] == '<a href="/x">x</a>'
    steps = spark.createDataFrame([("c", 2, "two"), ("c", 1, "one")], "c string, n int, t string")
    assert H.steps_text(steps, ["c"], "n", F.col("t")).first()["html"] == "<ol><li>one</li><li>two</li></ol>"
    out = H.envelope(spark.createDataFrame([('{"k": 3}',), ("x",), (None,)], "b string"), "b", F.lit(200)).collect()
    assert [r["accepted"] for r in out] == [True, False, False]
