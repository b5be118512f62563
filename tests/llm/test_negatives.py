"""Hard negatives against all pairs in plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import hard_negatives as H

COLUMNS = "vec_id long, embedding array<double>, label int, list int, v string"


def plain(rows, every=10, positives=5, negatives=5):
    own = []
    for i, v, label, *_ in rows:
        if v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            own.append((i, [math.floor(256 * x) for x in v], label))
    key = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for a, (i, v, label) in enumerate(own):
        if i is None or i % every:
            continue
        scores = [(sum(x * y for x, y in zip(v, w, strict=False)), j, m) for b, (j, w, m) in enumerate(own) if b != a]
        for ps, p, _ in sorted((s for s in scores if s[2] == label), key=key)[:positives]:
            hits = sorted((s for s in scores if s[2] != label and 80 * ps <= 100 * s[0] <= 100 * ps), key=key)[:negatives]
            out += [(i, p, n + 1, j, ps, s) for n, (s, j, _) in enumerate(hits)]
    return sorted(out, key=str)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r[:3], 1, "x") for r in rows], COLUMNS).repartition(3)
    return sorted((tuple(r) for r in H.mined(spark, df, F.col("vec_id") % 10 == 0, **more).collect()), key=str)


def vectors(seed, n, dims=6, groups=4):
    r = random.Random(seed)
    middles = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(groups)]
    return [(i, [x + r.gauss(0, 0.3) for x in r.choice(middles)], r.randrange(3)) for i in range(n)]


def test_against_all_pairs(spark):
    rows = vectors(1, 240)
    assert mined(spark, rows) == plain(rows)


def test_all_cases(spark):
    """Ties, repeats, nulls, no numbers, other lengths, labels of one row."""
    v = [0.5, -0.25, 1.0]
    rows = [(i, v, i % 2) for i in range(24)] + [(30, v, None), (31, None, 1), (32, [1.0, None, 2.0], 1), (33, [float("nan")] * 3, 0), (34, [float("inf"), 0.0, 0.0], 0)]
    rows += [(None, v, 0), (None, [0.45, -0.25, 0.9], 1), (10, v, 0), (40, [], 0), (50, [1.0], 1), (60, [-1.0, 0.0, 0.0, 3.0], 1), (61, [0.9], 7), (70, [0.0, 0.0, 0.0], 0)]
    assert mined(spark, rows) == plain(rows)
    assert mined(spark, [(1, v, 0), (2, v, 1)]) == [] and mined(spark, [(10, v, 0), (2, v, 1)]) == []
    assert mined(spark, []) == [] and mined(spark, [(0, None, 1)]) == [] and mined(spark, [(0, [], 1)]) == []


def test_too_large_scores_are_an_error(spark):
    with pytest.raises(ValueError, match="2 \\*\\* 53"):
        mined(spark, [(0, [1e12], 1)])


def test_units_are_bounded_and_lists_are_skipped(spark, monkeypatch):
    """One vector has a third of the rows: its list is in blocks. Far lists are never visited."""
    for name, value in (("ROWS", 32), ("ANCHORS", 4), ("VISITS", (1, 2))):
        monkeypatch.setattr(H, name, value)
    rows = vectors(2, 200, groups=6)
    rows += [(1000 + i, rows[0][1], i % 3) for i in range(100)]
    assert mined(spark, rows) == plain(rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], COLUMNS)
    own = H.components_of(df, F.col("vec_id") % 10 == 0, "vec_id", "embedding", "label").cache()
    own, lists = H.indexed(spark, own, 300, 6)
    assert lists.blocks.sum() >= 10 and own.count() == 300
    asked = own.where("is_anchor").select("row", "label", "v")
    window = lambda lo, hi, kth: F.array(F.struct(*[F.lit(x).cast("long").alias(n) for x, n in ((lo, "lo"), (hi, "hi"), (kth, "kth"))]))
    every = H.visits(asked.withColumn("windows", window(None, None, None)), lists, 0, None).count()
    assert every == asked.count() * lists.blocks.sum()
    assert H.visits(asked.withColumn("windows", window(None, None, 10**9)), lists, 0, None).count() == 0
    some = H.visits(asked.withColumn("windows", window(50_000, 200_000, None)), lists, 0, None).count()
    assert 0 < some < 0.7 * every


def test_bounds_hold(spark):
    r = np.random.default_rng(1)
    x = np.floor(256 * r.normal(size=(500, 8)))
    rows = [(i, (v / 256).tolist(), 0, 1, "x") for i, v in enumerate(x)]
    own = H.components_of(spark.createDataFrame(rows, COLUMNS), F.lit(True), "vec_id", "embedding", "label").cache()
    own, lists = H.indexed(spark, own, 500, 8)
    least, most = lists.bounds(x[:50])
    for row in own.collect():
        scores = x[:50] @ np.frombuffer(row["v"], "<f8")
        assert (least[:, row["list"]] <= scores).all() and (scores <= most[:, row["list"]]).all()
