"""Ranked search against plain Python."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm import lexical_search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, queries, k):
    """(item_id, rank, doc_id, score), over all pairs of query and document."""
    found = [(i, terms(t)) for i, t in docs]
    n, total = sum(1 for _, ts in found if ts), sum(len(ts) for _, ts in found)
    df = {}
    for _, ts in found:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in queries:
        hits = []
        for i, ts in found:
            score = 0
            for t in set(terms(text)) & set(ts):
                w, m, tf = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))), 50 + 50 * len(ts) * n // total, ts.count(t)
                score += w * (1_000_000_000 * tf // (1000 * tf + 20 * m))
            if score:
                hits.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, h[3], -h[0]) for r, h in enumerate(sorted(hits, key=lambda h: h[:3])[:k])]
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_terms():
    texts = [None, "", " .,", "Ab-cD é1 ÉÀ", "x\x00y\x7fz", "\x1c a_b　c ", "a" * 5000, "Ab", "cd"]
    a = pa.array(texts, pa.string())
    assert S.n_terms(a).tolist() == [len(terms(t)) for t in texts]
    names, code, owner = S.terms_of(a)
    got = [[] for _ in texts]
    for c, o in zip(code, owner, strict=True):
        got[o].append(names[int(c)].as_py())
    assert got == [terms(t) for t in texts]
    assert S.n_terms(pa.array([], pa.string())).tolist() == []
    cut = pa.array(["zz zz", "a b", "c"]).slice(1)
    assert S.n_terms(cut).tolist() == [2, 1]


def test_ties_stay_whole():
    scores = np.array([0, 3, 5, 3, 3, 0, 9, 3])
    assert S.best(scores, 4).tolist() == [6, 2, 1, 3] and S.best(scores, 99).tolist() == [6, 2, 1, 3, 4, 7] and not len(S.best(np.zeros(3, int), 2))


QUERIES = [(1, "the quick brown FOX"), (2, None), (2, "rain, rain; stones"), (None, "nine small birds 3"), (7, "--"), (8, "unknownterm"), (9, "é b  "), (1, "the quick brown FOX")]


@pytest.mark.parametrize("shard_docs", [3, 4096])
def test_all_cases(spark, docs, rows, none, shard_docs):
    queries = spark.createDataFrame([(i, t, i) for i, t in QUERIES], "item_id long, text string, doc_id long").repartition(2)
    index = S.Index.built(spark, docs, shard_docs=shard_docs)
    assert result(index.ranked(queries, 5)) == plain([(r[0], r[1]) for r in rows], QUERIES, 5)
    assert index.ranked(queries.where("item_id = 7")).count() == 0 and index.ranked(queries.limit(0)).count() == 0
    assert S.Index.built(spark, none).ranked(queries).count() == 0


def test_many_ties_over_shards_and_blocks(spark, monkeypatch):
    """More equal scores than ranks, documents in many shards, queries in several blocks."""
    r = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(sorted(r.sample(words, 4)))) for i in range(900)]
    r.shuffle(docs)
    queries = [(i, " ".join(r.sample(words, 3))) for i in range(12)]
    monkeypatch.setattr(S, "BLOCK", 10)
    index = S.Index.built(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(5), shard_docs=50)
    assert result(index.ranked(spark.createDataFrame(queries, "item_id long, text string"))) == plain(docs, queries, 50)
