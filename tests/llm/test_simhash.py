"""Fingerprints and their links against plain Python over all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyloom.llm import simhash_join as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text, width=3):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    runs = [words[i : i + width] for i in range(len(words) - width + 1)] or ([words] if words else [])
    values = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def reachable(fps, threshold=2):
    """The smallest member that each fingerprint reaches, over all pairs."""
    fps = sorted(fps)
    x = np.array(fps, np.uint64)
    of = {}
    for start in fps:
        if start in of:
            continue
        todo, of[start] = [start], start
        while todo:
            at = todo.pop()
            for y in x[np.bitwise_count(x ^ np.uint64(at)) <= threshold].tolist():
                if y not in of:
                    of[y] = start
                    todo.append(y)
    return of


def expected(rows):
    fp = [plain(t) for _, t in rows]
    of = reachable(set(fp))
    least = {}
    for (i, _), f in zip(rows, fp, strict=True):
        if i is not None:
            least[of[f]] = min(i, least.get(of[f], i))
    return sorted(((i, f"{f:016x}", least.get(of[f])) for (i, _), f in zip(rows, fp, strict=True)), key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_fingerprints(rows):
    texts = [r[1] for r in rows] + ["x " * 256, "x y z", "A\tB\x1cC D", "a b c d " * 300]
    got = S.fingerprints(pa.array(texts, pa.string()), 3).tolist()
    assert got == [plain(t) for t in texts]


def test_all_cases(spark, docs, rows, none):
    assert result(S.linked(spark, docs)) == expected([(r[0], r[1]) for r in rows])
    assert S.linked(spark, none).count() == 0


def family(seed, centres, members, flips):
    """Fingerprints around some centres, which differ by few bits."""
    r = random.Random(seed)
    out = set()
    for _ in range(centres):
        c = r.getrandbits(64)
        for _ in range(members):
            x = c
            for b in r.sample(range(64), r.randint(0, flips)):
                x ^= 1 << b
            out.add(x)
    return out


@pytest.mark.parametrize(("centres", "members", "flips"), [(200, 3, 3), (3, 700, 4), (1, 2000, 5)])
def test_join_of_fingerprints(spark, monkeypatch, centres, members, flips):
    """Sparse and dense families; in the last all allocations cost too much, so nodes meet half-way."""
    fps = family(members, centres, members, flips)
    rows = [(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(sorted(fps))]
    monkeypatch.setattr(S, "fingerprinted", lambda docs, *_: docs)
    got = {r["fingerprint"]: r["component_id"] for r in S.linked(spark, spark.createDataFrame(rows, "doc_id long, fp long").repartition(3)).collect()}
    of = reachable(fps)
    number = {x: i for i, x in enumerate(sorted(fps))}
    assert got == {f"{x:016x}": number[of[x]] for x in fps}


def test_dense_nodes_meet_half_way(spark):
    """No key of the join or of the places gathers a group, and both ways occur."""
    fps = sorted(family(5, 1, 3000, 4) | family(6, 300, 1, 0))
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    parts = S.Parts(S.grouped(S.agreements(nodes), len(fps), 3), len(fps))
    parts.cells = S.counted(nodes, parts)
    assert parts.cells.sum(1).tolist() == [len(fps)] * 3
    plan, dense = parts.plan(np.array(fps, np.uint64).view(np.int64), 2)
    assert 0 < dense.sum() < len(fps) and (plan[~dense] + 1).sum(1).tolist() == [3] * int((~dense).sum())
    most = S.index_rows(nodes, parts).groupBy("part", "value").count().agg(F.max("count")).first()[0]
    assert most < S.BALL
    probes = S.probe_rows(nodes, parts, 2)
    assert probes.count() < (~dense).sum() * S.BALL / S.PROBE


def test_allocations():
    costs = np.array([[[0, 5, 50, 1e18], [0, 900, 999, 1e18], [0, 4, 40, 1e18]], [[0, 1, 90, 1e18], [0, 1, 90, 1e18], [0, 1, 90, 1e18]]])
    t, cost = S.allocated(costs, 2)
    assert t.tolist() == [[0, -1, 1], [0, 0, 0]] and cost.tolist() == [45, 3]


def test_bits_that_go_together_share_a_part():
    r = np.random.default_rng(3)
    x = r.integers(0, 2, (4000, 64))
    for b in range(0, 60, 3):
        x[:, b] = x[:, 63] ^ (r.random(4000) < 0.1)
    both = (x.T @ x).astype(float)
    parts = S.grouped(both, 4000, 3)
    assert sorted(b for p in parts for b in p) == list(range(64)) and [len(p) for p in parts] == [22, 21, 21]
    assert set(range(0, 60, 3)) | {63} <= set(parts[0])
    assert S.parts_for(10**5, 2) == 3 and S.parts_for(10**9, 2) == 2
