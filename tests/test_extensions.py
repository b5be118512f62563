"""Intervals, sketches, sessions, the name index and bodies against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.bodies import indented_or_raw
from tallyloom.operators import catalogue as C
from tallyloom.operators import intervals, sketches
from tallyloom.operators.name_index import NameIndex
from tallyloom.sources import files
from tallyloom.streaming import sessions


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("by", [[], ["k"]])
def test_overlapping_intervals(spark, by):
    """Lengths from nothing to the whole range, negative numbers, nulls, repeats, a hot place."""
    r = random.Random(7)

    def side(n, seed):
        out = []
        for i in range(n):
            lo = r.randrange(-500, 500) if r.random() < 0.7 else 42
            out.append((i, r.choice([1, 1, 1, 2, None]), lo, lo + r.choice([0, 0, 1, 3, 60, 900, -1])))
        return [*out, (n, 1, None, 5), (n, 1, 5, None), out[0], (n + 1, 1, -(10**12), 10**12)]

    a, b = side(120, 1), side(150, 2)
    left, right = (spark.createDataFrame(x, "id long, k long, b long, e long").repartition(3) for x in (a, b))
    got = intervals.overlapping(left, right, "b", "e", by)
    ok = lambda x: x[2] is not None and x[3] is not None and x[2] <= x[3]
    want = [(*x, *y) for x in a if ok(x) for y in b if ok(y) and x[2] <= y[3] and y[2] <= x[3] and (not by or (x[1] is not None and x[1] == y[1]))]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    assert intervals.overlapping(left, right.where("false"), "b", "e", by).count() == 0


@pytest.mark.parametrize("by", [[], ["k"]])
def test_totals_of_overlaps(spark, by):
    """Against all pairs, in ranges of few rows; nulls, repeats and a hot place; and no pairs are made."""
    r = random.Random(8)

    def side(n):
        out = [(i, r.choice([1, 1, 2, None]), lo := r.choice([42, r.randrange(-300, 300)]), lo + r.choice([0, 0, 3, 60, 900, -1]), r.choice([None, 1, -5, 7])) for i in range(n)]
        return [*out, (n, 1, None, 5, 1), (n, 1, 5, None, 1), out[0], (n + 1, 1, 5000, 5001, 1), (n + 2, 2, -(10**12), -(10**11), None)]

    a, b = side(60), side(90)
    left, right = (spark.createDataFrame(x, "id long, k long, b long, e long, v long").repartition(3) for x in (a, b))
    got = intervals.overlap_totals(left, right, "b", "e", {"s": "v"}, by, range_rows=16)
    ok = lambda x: x[2] is not None and x[3] is not None and x[2] <= x[3]
    want = []
    for x in a:
        near = [y for y in b if ok(x) and ok(y) and x[2] <= y[3] and y[2] <= x[3] and (not by or (x[1] is not None and x[1] == y[1]))]
        values = [y[4] for y in near if y[4] is not None]
        want.append((*x, len(near), sum(values) if values else None, min((y[2] for y in near), default=None), max((y[3] for y in near), default=None)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    none = intervals.overlap_totals(left, right.where("false"), "b", "e", {"s": "v"}, by)
    assert none.where("n = 0 and s is null and first is null and last is null").count() == len(a)
    # a thousand million pairs
    many = spark.range(32_000).select(F.lit(0).cast("long").alias("b"), F.col("id").alias("e"))
    assert intervals.overlap_totals(many, many, "b", "e", {"s": "e"}).where(f"n = 32000 and s = {32_000 * 31_999 // 2} and first = 0 and last = 31999").count() == 32_000


def test_an_interval_is_few_rows(spark):
    rows = spark.createDataFrame([(i, i + n) for i in range(0, 5000, 7) for n in (0, 1, 31, 32, 1000)], "b long, e long")
    at = rows.select(F.col("b").alias("__begin"), F.col("e").alias("__end")).withColumn("__level", intervals._level(F.col("__begin"), F.col("__end")))
    assert at.select(F.max(F.size(intervals._buckets(F.col("__level"))))).first()[0] == 2


def test_merged_sketches(spark):
    """Merged by day or made at once, in any order of the parts, within the bounds; one day has nine tenths of the rows."""
    rows = spark.range(60_000).select((F.col("id") % 5000).alias("item"), F.when(F.col("id") % 10 > 0, 0).otherwise(F.floor(F.col("id") / 10) % 30).alias("day"), F.when(F.col("id") % 9 > 0, F.col("id") * 7919 % 60_000).alias("value"))
    by_day = sketches.sketched(rows, ["day"], F.col("item"), F.col("value"))
    assert by_day.count() == 30
    one = sketches.estimates(sketches.sketched(rows, [], F.col("item"), F.col("value")), [0.25, 0.5]).first()
    for some in (by_day, by_day.orderBy(F.col("day").desc()).repartition(7)):
        got = sketches.estimates(sketches.merged(some, []), [0.25, 0.5]).first()
        assert got["n"] == one["n"] == rows.where("value is not null").count()
        for x in (got, one):
            assert abs(x["distinct"] / 5000 - 1) < 0.06
            for q, rank in zip(x["quantiles"], (0.25, 0.5), strict=True):
                assert abs(rows.where(F.col("value") <= q).count() / x["n"] - rank) < 0.03
    assert sketches.estimates(sketches.merged(sketches.sketched(rows.where("false"), ["day"], F.col("item"), F.col("value")), ["day"]), [0.5]).count() == 0


def test_sessions_and_late_rows(spark, tmp_path):
    """A session is given once it is over; a row that comes after that is counted as late."""
    at = lambda rows: spark.createDataFrame(rows, "who string, at string").select("who", F.to_timestamp("at").alias("at"))
    batches = [
        [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:09:00"), ("a", "2024-01-01 00:30:00"), (None, "2024-01-01 00:05:00"), ("b", None)],
        [("b", "2024-01-01 03:00:00")],
        [("a", "2024-01-01 00:10:00"), ("b", "2024-01-01 03:05:00"), ("b", "2024-01-01 06:00:00")],
    ]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("who string, at timestamp").parquet(f"{tmp_path}/in")
    late = 0
    for k, rows in enumerate(batches):
        at(rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out, n = sessions.run_available(spark, sessions.sessions(stream, "who", "at", "10 minutes", "1 hour"), f"{tmp_path}/run")
        late += n
    got = sorted(((r["who"] or "", str(r["begin"])[11:16], str(r["end"])[11:16], r["n"]) for r in out.collect()))
    assert got == [("", "00:05", "00:15", 1), ("a", "00:00", "00:19", 2), ("a", "00:30", "00:40", 1), ("b", "03:00", "03:15", 2)] and late == 1


def test_name_index(spark):
    names = ["Red Ring", "redder", "blue", "RE", "", None, "ring of red rings", "İstanbul red", "r.d", "red", "red"]
    items = spark.createDataFrame([(i % 9, n, "x") for i, n in enumerate(names)], "id long, name string, other string")
    index = NameIndex.built(items, "id", "name")
    for term in ("red", "RED R", "re", "", "ring of", "nothing", "r.d", "d r"):
        want = {(r["id"], r["name"]) for r in C.search(items, "name", term).collect()}
        assert {tuple(r) for r in index.search(term).collect()} == want, term
    assert index.candidates("ring of").count() < 3 and "In(gram" in plan(index.search("ring of")).split("PushedFilters")[1]


def test_bodies(spark):
    texts = ['{"b":1,"a":2.50}', "[]", ' {"x":{"é":[1,{"y":null}]},"e":{},"l":[[],[1]]} ', "nope", "", None, "1e3", '"t"', "{", '{"a":1,"a":2}', "[" * 5000]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", indented_or_raw("t").alias("t")).orderBy("i").collect()
    for text, r in zip(texts[:-1], got, strict=False):
        try:
            assert r["t"] == json.dumps(json.loads(text), indent=2)
        except (TypeError, ValueError):
            assert r["t"] == text
    assert got[0]["t"] == '{\n  "b": 1,\n  "a": 2.5\n}' and got[-1]["t"] == texts[-1]


def test_sections_are_read_once(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("people:\n  - name: A\n  - name: B\nnone:\n")
    (tmp_path / "b.yaml").write_text("cards:\n  - {n: '1', y: true}\n")
    (tmp_path / "c.yaml").write_text("")
    every = files.all_sections(spark, f"file://{tmp_path}/*.yaml").cache()
    assert {(r["section"], r["position"]) for r in every.collect()} == {("people", 0), ("people", 1), ("none", None), ("cards", 0)}
    assert json.loads(files.section(every, "cards").first()["row"]) == {"n": "1", "y": True}
    assert files.section(every, "none", required=True).count() == 0 and files.section(every, "away").count() == 0
    with pytest.raises(KeyError):
        files.section(every, "away", required=True)
