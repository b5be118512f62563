"""Global order in ranges: against plain windows, with hot keys, ties and nulls."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.operators import catalogue as C
from tallyloom.operators import ranges as R


@pytest.fixture(scope="module")
def hot(spark):
    """One key with nine tenths of the rows, equal times, whole rows repeated, nulls."""
    r = random.Random(3)
    rows = [("hot" if r.random() < 0.9 else r.choice(["a", "b", None]), r.randrange(400), k, r.choice([None, *range(9)])) for k in range(2400)]
    rows += [("same", 7, -1, 5)] * 600
    r.shuffle(rows)
    return spark.createDataFrame(rows, "key string, t long, id long, v long").repartition(5).cache()


def down():
    return [F.col("t").desc_nulls_last(), F.col("id")]


def test_positions(spark, hot):
    got = R.ranged(hot, down(), 200)
    w = Window.orderBy(*down())
    want = hot.withColumn("position", F.row_number().over(w) - 1)
    assert got.n == 3000 and got.numbered().exceptAll(want).count() == 0 and got.numbered().count() == 3000
    assert got.numbered(1400, 1550).exceptAll(want.where("position >= 1400 and position < 1550")).count() == 0 and got.numbered(1400, 1550).count() == 150
    for n in (0, 1234, 2999):
        assert got.at(n).first().asDict() == want.where(F.col("position") == n).drop("position").first().asDict()
    assert got.at(3000).count() == 0 and got.at(-1).count() == 0 and got.numbered(5, 5).count() == 0
    with pytest.raises(IndexError):
        got.strictly_at(3000)
    assert got.strictly_at(2999).count() == 1


def test_no_range_gathers_ties(spark):
    """Rows that tie, and rows that are the same in all columns, are dealt over ranges."""
    same = spark.range(4000).select(F.lit(1).alias("a"), F.create_map(F.lit("k"), F.lit(2)).alias("m"))
    got = R.ranged(same, [F.col("a")], 500)
    sizes = [b - a for a, b in zip(got.starts, got.starts[1:], strict=False)]
    assert got.n == 4000 and max(sizes) < 1500 and got.numbered().select("position").distinct().count() == 4000


def test_only_the_range_of_a_row_is_read(spark, hot):
    got = R.ranged(hot, down(), 200)
    df = got.at(1500)
    df.collect()
    r = next(k for k, start in enumerate(got.starts) if start > 1500) - 1
    assert "PartitionFilters" in (plan := df._jdf.queryExecution().executedPlan().toString()) and f">= {r})" in plan and f"<= {r})" in plan.split("PartitionFilters")[1]


def test_far_rows_of_the_catalogue(spark, hot, monkeypatch):
    monkeypatch.setattr(C, "FAR", 100)
    order = [F.col("id"), F.col("key"), F.col("t")]
    want = hot.withColumn("position", F.row_number().over(Window.orderBy(*order)) - 1)
    for n in (50, 2000):
        assert [tuple(x) for x in C.nth(hot, order, n).collect()] == [tuple(x) for x in want.where(F.col("position") == n).drop("position").collect()]
    assert C.nth(hot, order, 5000).count() == 0 and C.nth_strict(hot, order, 2000).count() == 1
    with pytest.raises(Exception, match="no row at position"):
        C.nth_strict(hot, order, 5000).collect()


def test_running_sums(spark, hot):
    by, order = ["key"], [F.col("t"), F.col("id")]
    rows = hot.distinct()
    got = R.running(rows, by, order, {"total": F.col("v"), "n": F.lit(1).cast("long")}, 200)
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    want = rows.withColumns({"total": F.sum("v").over(w), "n": F.sum(F.lit(1).cast("long")).over(w)})
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    assert R.running(rows.where("false"), by, order, {"total": F.col("v")}).count() == 0


@pytest.mark.parametrize("k", [0, 3, 700])
def test_moving_sums(spark, hot, k):
    """Frames longer than a range, too."""
    by, order = ["key"], [F.col("t"), F.col("id")]
    rows = hot.distinct()
    got = R.moving(rows, by, order, F.col("v"), k, "total", 200)
    want = rows.withColumn("total", F.sum("v").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-k, 0)))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def plain_asof(left, right, tolerance=None, exact=True):
    out = []
    for key, t, i in left:
        near = [(u, v) for k, u, v in right if key is not None and t is not None and k == key and u is not None and (u <= t if exact else u < t) and (tolerance is None or t - u <= tolerance)]
        out.append((key, t, i, max(near, key=lambda x: (x[0], x[1] is not None, x[1]))[1] if near else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("tolerance", "exact"), [(None, True), (None, False), (4, True)])
def test_asof(spark, tolerance, exact):
    r = random.Random(5)
    key = lambda: "hot" if r.random() < 0.9 else r.choice(["a", "b", None])
    left = [(key(), r.choice([None, *range(900)]), k) for k in range(1500)]
    right = [(key(), r.choice([None, *range(900)]), r.choice([None, *range(50)])) for _ in range(250)]
    a, b = spark.createDataFrame(left, "key string, t long, id long").repartition(3), spark.createDataFrame(right, "key string, t long, v long").repartition(3)
    got = R.asof(a, b, ["key"], "t", ["v"], None if tolerance is None else F.lit(tolerance), exact, range_rows=100)
    assert sorted((tuple(x) for x in got.collect()), key=str) == plain_asof(left, right, tolerance, exact)
    assert R.asof(a, b.where("false"), ["key"], "t", ["v"]).where("v is not null").count() == 0
