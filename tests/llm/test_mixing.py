from collections import Counter

import numpy as np
import pytest

from tallyloom.llm import mixing


def by_hand(sizes: dict, most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, rest = {}, list(order), sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / total > most * sizes[s]]
        if not over:
            return target | {s: rest * weight[s] / total for s in free}
        for s in over:
            target[s] = most * sizes[s]
            rest -= target[s]
            free.remove(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 10, None: 5, "c": 1000}, {"a": 1}, {"a": 0, "b": 7}, {None: 50, "z": 50, "Z": 1}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert got == pytest.approx(by_hand(sizes))


def test_taken(spark, docs, rows, none):
    got = mixing.taken(spark, docs, block=16).collect()
    n = lambda t: len((t or "").encode().split())
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((r[0], r[3], n(r[1])) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += n(r[1])
    target = by_hand(sizes)
    for s, size in sizes.items():
        mine = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in mine} == {size} and {round(r["target"], 6) for r in mine} == {round(target[s], 6)}
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= 3 * 16
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    again = mixing.taken(spark, docs.repartition(5), block=16).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixing.taken(spark, none).count() == 0
    assert mixing.taken(spark, docs.where("text is null or text = ''")).count() == 3


def test_mixed_holds_the_words_taken(spark, docs):
    distinct = docs.dropDuplicates(["doc_id"])
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken(spark, distinct, block=16).collect()}
    out = mixing.mixed(spark, distinct, block=16)
    assert out.columns == docs.columns
    got = Counter()
    texts = {r["doc_id"]: (r["text"] or "").encode().split() for r in distinct.collect()}
    for r in out.collect():
        ws = r["text"].encode().split()
        got[r["doc_id"]] += len(ws)
        it = iter(texts[r["doc_id"]])
        assert all(w in it for w in ws)  # in their order
    assert {k: v for k, v in taken.items() if v} == dict(got)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation(n):
    for key in (0, 12345, 1 << 63):
        got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
        assert sorted(got.tolist()) == list(range(n))


def test_drawn_ends_at_its_totals():
    want = np.array([1000, 0, 37, 5000])
    out = mixing.drawn(want, 3, 100)
    total, per = Counter(), Counter()
    for shard, i, first, n in out:
        assert first == total[i]
        total[i] += n
        per[shard] += n
    assert [total[i] for i in range(4)] == want.tolist() and set(list(per.values())[:-1]) == {100}


def test_a_shard_is_drawn_without_the_others(spark, monkeypatch):
    """Two thousand sources: the tasks' counts are those of the draws, every slot once, in shards of one size."""
    monkeypatch.setattr(mixing, "SLOTS", 64)
    want = np.arange(2000) % 7
    known = spark.createDataFrame([(i, int(128 * n), float(128 * n)) for i, n in enumerate(want)], "source_no int, source_size long, target double")
    got = mixing.slots(spark, known, 5).collect()
    assert Counter(r["source_no"] for r in got) == Counter({i: int(n) for i, n in enumerate(want) if n})
    assert len({(r["source_no"], r["slot"]) for r in got}) == len(got) and len({(r["source_no"], r["block"]) for r in got}) == len(got)
    per = Counter(r["shard"] for r in got)
    assert set(list(dict(sorted(per.items())).values())[:-1]) == {64} and len(per) == -(-len(got) // 64)
    draws = {(s, i): (first, n) for s, i, first, n in mixing.drawn(np.array([n for n in want if n]), 5, 64)}
    number = np.flatnonzero(want)
    assert {(r["shard"], r["source_no"]) for r in got} == {(s, int(number[i])) for s, i in draws}


def test_shards_follow_the_shares():
    """Each shard has about a source's share of slots, but not exactly."""
    want = np.array([60_000, 30_000, 10_000])
    counts = np.array([mixing.draw(want, s, 9, 1000)[1] for s in range(100)])
    assert counts.sum(0).tolist() == want.tolist() and counts.std(0).min() > 3
    assert np.abs(counts.mean(0) - want / 100).max() < 1e-9 and np.abs(counts - want / 100).max() < 120
