import random
from collections import Counter

import pytest

from tallyloom.llm import lsh_forest
from tallyloom.llm.components import components


def shingles(text, width=5):
    ws = (text or "").encode().lower().split()
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1)))


def by_hand(rows):
    """doc_id -> smallest doc_id that it reaches; rows of a doc_id are one node."""
    sets = {}
    for i, text in rows:
        sets.setdefault(i, []).append(shingles(text))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b < a and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_edge_cases(spark, docs, rows, none):
    got = lsh_forest.linked(spark, docs).collect()
    component = by_hand([(r[0], r[1]) for r in rows if r[0] is not None])
    want = Counter()
    for r in rows:
        s = shingles(r[1])
        if r[0] is not None:
            c = component[r[0]]
        else:
            same = [x[0] for x in rows if x[0] is not None and s and shingles(x[1]) == s]
            c = component[min(same)] if same else None
        want[r[0], len(s), c, c == r[0]] += 1
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == want
    assert lsh_forest.linked(spark, none).count() == 0


@pytest.fixture(scope="module")
def family(spark):
    """Copies with more and more changed words: many lie on either side of the threshold."""
    r = random.Random(2)
    base = [f"w{r.randrange(5000)}" for _ in range(120)]
    rows = [(i, " ".join(f"x{r.randrange(500)}" for _ in range(60))) for i in range(150)]
    for i in range(300):
        ws = list(base)
        for _ in range(r.randint(0, 9)):
            ws[r.randrange(len(ws))] = f"y{r.randrange(10**6)}"
        rows.append((1000 + i, " ".join(ws).upper() if i % 3 else " ".join(ws)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_family_is_linked_as_by_brute_force(spark, family):
    rows, docs = family
    want = by_hand(rows)
    got = {r["doc_id"]: r["component_id"] for r in lsh_forest.linked(spark, docs).collect()}
    assert got == want and len(set(want.values())) > 160


def test_dense_regions_lose_no_link(spark, family):
    """With two neighbours nearly all regions are dense, and cut into many blocks."""
    rows, docs = family
    got = {r["doc_id"]: r["component_id"] for r in lsh_forest.linked(spark, docs, neighbours=2, block=16).collect()}
    assert got == by_hand(rows)


def test_one_of_each_group_stays(spark, family):
    rows, docs = family
    kept = lsh_forest.kept_documents(spark, docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(by_hand(rows).values())


@pytest.mark.parametrize("few", [10_000, 0])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr("tallyloom.llm.components.FEW", few)  # with 0 all keys are heavy
    r = random.Random(1)
    links = [(i, i + 1) for i in range(0, 40)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(80)] + [(500, 501), (501, 500), (7, 7)]
    root = {}
    for a, b in links:
        root.setdefault(a, a), root.setdefault(b, b)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {x["node"]: x["component"] for x in components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: find(i) for a, b in links if a != b for i in (a, b)}
    assert components(spark, spark.createDataFrame([], "a long, b long")).count() == 0
    assert components(spark, spark.createDataFrame([(1, None), (None, 2), (3, 3)], "a long, b long")).count() == 0


def test_many_nodes_are_dealt_into_more_ranges(spark, family, monkeypatch):
    """A task's part of the sorted orders is bounded whatever the session's partitions; the links are the same."""
    rows, docs = family
    monkeypatch.setattr(lsh_forest, "ORDER_ROWS", 500)
    nodes = lsh_forest.signed(docs, 5, "text", "doc_id").where("digest is not null").withColumnRenamed("doc_id", "node")
    n = nodes.count()
    assert lsh_forest.in_order(lsh_forest.forest(nodes), n).rdd.getNumPartitions() == -(-16 * n // 500) > 4
    assert {r["doc_id"]: r["component_id"] for r in lsh_forest.linked(spark, docs).collect()} == by_hand(rows)
