import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import line_join as L
from tallyloom.llm.shared import sieved

SPACE = b" \t\n\x0b\x0c\r"


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_automaton_is_the_edit_distance():
    r = random.Random(3)
    for _ in range(4000):
        x, y = ("".join(r.choice("abé") for _ in range(r.randint(0, 9))) for _ in "xy")
        for k in range(4):
            assert L.within(x, y, k) == (distance(x, y) <= k)


def near(x, y, threshold=3):
    """The rule of linked(), with a plain edit distance."""
    a, b = x.encode().split(), y.encode().split()
    if min(len(a), len(b)) >= 16:
        return distance(a, b) <= min(threshold, min(len(a), len(b)) // 16)
    n = min(len(x), len(y))
    most = min(threshold, 0 if n < 12 else 1 if n < 25 else 2 if n < 96 else 3)
    return abs(len(x) - len(y)) <= most and distance(x, y) <= most


def components(nodes, pairs):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    groups = {}
    for x in nodes:
        groups.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in groups.values()}


def joined(spark, lines, **more):
    """How many pairs are near by brute force; links() gives some of them, and the same components."""
    df = spark.createDataFrame([(x,) for x in [*lines, *lines[::3]]], "line string").withColumn("id", F.xxhash64("line"))
    ids = {r["line"]: r["id"] for r in df.collect()}
    assert all(L.line_id(x) == i for x, i in ids.items())
    want = {tuple(sorted((ids[x], ids[y]))) for i, x in enumerate(lines) for y in lines[:i] if near(x, y)}
    got = [(r["a"], r["b"]) for r in L.links(spark, df, **more).collect()]
    assert len(got) == len(set(got)) and set(got) <= want
    assert components(ids.values(), got) == components(ids.values(), want)
    return len(want), len(got)


@pytest.fixture(scope="module")
def lines():
    r = random.Random(4)
    base = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(26, 40))).strip() for _ in range(80)]
    base += ["".join(r.choice("abcdefghijk") for _ in range(r.randint(90, 100))) for _ in range(20)]

    def changed(x):
        for _ in range(r.randint(0, 4)):
            p = r.randrange(len(x))
            x = r.choice([x[:p] + r.choice("abxyé") + x[p:], x[:p] + x[p + 1 :], x[:p] + r.choice("abxy ") + x[p + 1 :]])
        return x

    out = base + [changed(r.choice(base)) for _ in range(200)] + [f"one common beginning of number {i:03d} and one common end" for i in range(60)]
    return sorted({x.strip() for x in out if x.strip()})


@pytest.mark.parametrize("run_rows,block", [(256, 4096), (8, 5), (2, 64)])
def test_join_loses_no_link(spark, lines, run_rows, block):
    want, got = joined(spark, lines, run_rows=run_rows, block=block)
    assert want > 500 and (got < want or run_rows == 256)


def test_lines_with_replaced_words(spark):
    r = random.Random(8)
    words = [f"{w}{k}" for w in ("one", "another", "extraordinary") for k in range(60)]

    def changed(x, n):
        x = list(x)
        for _ in range(n):
            p = r.randrange(len(x))
            x[p : p + 1] = r.choice([[r.choice(words)], [], [x[p], r.choice(words)]])
        return x

    base = [[r.choice(words) for _ in range(n)] for n in (14, 15, 16, 17, 18, 19, 31, 32, 33, 47, 48, 60, 200) for _ in range(2)]
    lines = sorted({" ".join(changed(b, n)) for b in base for n in (0, 1, 1, 2, 2, 3, 4)})
    want, _ = joined(spark, lines)
    assert want > 60
    x = base[20]  # 48 words or more: three replaced words, of any length, still link
    assert L.linked(" ".join(x), " ".join(["extraordinarily", *x[1:20], "new", *x[21:-1], "last"]), 3)


def test_a_template_of_many_lines(spark):
    """All lines share all segments but one: the run is long in every part of the parities. Links join components, they
    aren't all pairs."""
    lines = [f"Order {i:05d} was sent to the customer" for i in range(0, 3000, 7)]
    want, got = joined(spark, lines, run_rows=16, block=50)
    assert want > 10_000 and got < want / 2


def by_hand(rows):
    """Lines that take part, their class firsts, by brute force."""
    part = []
    for r in rows:
        for n, x in enumerate((r[1] or "").split("\n") if r[1] is not None else []):
            x = x.encode().strip(SPACE).decode()
            if len(x) >= L.SHORTEST:
                part.append((r[0] is None, r[0] or 0, n, x))
    texts = sorted({p[3] for p in part})
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    n_links = Counter()
    for i, x in enumerate(texts):
        for y in texts[:i]:
            if max(len(x), len(y)) < 3000 and near(x, y):
                n_links[x] += 1
                n_links[y] += 1
                root[find(x)] = find(y)
    first = {}
    for p in part:
        c = find(p[3])
        first[c] = min(first.get(c, p[:3]), p[:3])
    return part, {t: first[find(t)] for t in texts}, n_links


@pytest.fixture(scope="module")
def documents(spark, rows):
    line = "a line that is long enough to take part in it"
    more = [(100, f"{line}\nshort\n{line}!\n  {line}x \nshort", "en", "s", 1, 1, "n", "h"), (101, "\n\n" + line, "en", "s", 1, 1, "n", "h"), (90, line.replace("enough", "enougH"), None, None, None, None, None, None)]
    all_ = [r for r in rows if r[0] != 42] + more
    return all_, spark.createDataFrame(all_, "doc_id long, text string, lang string, source string, n_chars long, failures long, node string, hash string").repartition(3)


def test_by_document(spark, documents, none):
    rows, docs = documents
    part, first, n_links = by_hand(rows)
    got = {r["doc_id"]: r for r in L.by_document(spark, docs).collect()}
    assert set(got) == {r[0] for r in rows}
    for doc_id, r in got.items():
        mine = [p for p in part if (None if p[0] else p[1]) == doc_id]
        gone = sorted((p[2], first[p[3]][1]) for p in mine if first[p[3]] != p[:3])
        assert r["n_lines"] == len(mine) and r["n_linked"] == sum(n_links[p[3]] > 0 for p in mine)
        assert list(zip(r["removed_lines"], r["first_docs"], strict=True)) == gone and r["n_removed"] == len(gone)
    assert L.by_document(spark, none).count() == 0


def test_texts_without_repeats(spark, documents, none):
    rows, docs = documents
    _, first, _ = by_hand(rows)
    want = []
    for r in rows:
        text = r[1]
        if text is not None:
            keep = []
            for n, x in enumerate(text.split("\n")):
                t = x.encode().strip(SPACE).decode()
                if t not in first or first[t] == (r[0] is None, r[0] or 0, n):
                    keep.append(x)
            text = "\n".join(keep)
        want.append((r[0], text, *r[2:]))
    out = L.without_repeats(spark, docs)
    assert out.columns == docs.columns
    assert Counter(map(tuple, out.collect())) == Counter(want)
    assert L.without_repeats(spark, none).count() == 0


def test_short_lines_are_joined_by_their_length(spark):
    r = random.Random(6)
    base = ["".join(r.choice("abc ") for _ in range(n)).strip() for n in range(4, 30) for _ in range(12)]
    some = {x.strip() for b in base for x in (b, b[:-1], b + "d", b[:2] + "e" + b[3:], "x" + b[:-1] + "y") if x.strip()}
    assert joined(spark, sorted(some))[0]


def test_repeats_of_short_lines_go(spark):
    docs = spark.createDataFrame([(1, "Yes.\nAll rights reserved.\nNo\n\nYes."), (2, "All rights reserved\n Yes.\nNot\n\n"), (3, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in L.without_repeats(spark, docs).collect()} == {1: "Yes.\nAll rights reserved.\nNo\n", 2: "Not\n\n", 3: None}
    got = {r["doc_id"]: (r["n_lines"], r["removed_lines"]) for r in L.by_document(spark, docs).collect()}
    assert got == {1: (4, [4]), 2: (3, [0, 1]), 3: (0, [])}


def test_sieve_keeps_all_keys_and_few_others(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 != 3, F.xxhash64("id")).alias("id"), F.col("id").alias("n")).union(spark.sql("select xxhash64(0L), -1L"))
    keys = spark.range(0, 20_000, 50).select(F.xxhash64("id").alias("id"))
    left = {r["n"] for r in sieved(rows, keys, "id").collect()}
    assert left >= {-1, *range(0, 20_000, 50)}
    assert len(left) < 500
    assert sieved(rows, keys.where("false"), "id").count() == 0
    assert sieved(rows.where("false"), keys, "id").columns == rows.columns


def test_single_hashes_are_left_out(spark):
    """Rows of a hash come in any order; a hash that others may follow stays."""
    rng = np.random.default_rng(3)
    hashes = np.sort(rng.integers(-40, 40, 60))
    cols = (hashes, rng.integers(0, 5, 60), rng.integers(0, 3, 60))
    for last in (False, True):
        got = list(zip(*(c.tolist() for c in L.without_singles(cols, last)), strict=True))
        alone = {h for h in hashes.tolist() if (hashes == h).sum() == 1} - {hashes[0]} - (set() if last else {hashes[-1]})
        assert got == sorted(x for x in zip(*(c.tolist() for c in cols), strict=True) if x[0] not in alone)
    assert [len(c) for c in L.without_singles(tuple(c[:0] for c in cols), True)] == [0, 0, 0]


def test_texts_meet_by_sort_merge_at_any_size(spark):
    """A broadcast of few texts says nothing about many."""
    texts = spark.createDataFrame([(1, "a"), (2, "b")], "id long, line string")
    plan = L.verified(spark.createDataFrame([(1, 2)], "a long, b long"), texts, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "BroadcastHashJoin" not in plan


def test_trimmed_lines(spark):
    lines = ["", " ", "a", " a", "a\t", "\x0b\x0c a b \r\n", " a ", "é ", " é", None]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string").select("i", L.trimmed(F.col("x"))).orderBy("i").collect()
    assert [r[1] for r in got] == [x if x is None else x.strip("\t\n\x0b\x0c\r ") for x in lines]
