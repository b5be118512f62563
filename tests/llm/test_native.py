"""Quality rules and exact dedup against plain Python, and their plans."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import exact_dedup, quality_rules as Q
from tallyloom.llm.shared import heavy_keys, shared_dir, spread_join

SPACE = b" \t\n\x0b\x0c\r"


def measures(text):
    t = text or ""
    ws = [w.decode() for w in t.encode().split()]
    windows = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    covered = {i + k for i in range(len(ws) - 7) if windows[tuple(ws[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in t.split("\n") if x.encode().strip(SPACE)]
    return len(ws), sum(map(len, ws)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_measures(docs, rows):
    got = Q.ledger(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    want = [(r[0], *measures(r[1])) for r in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_rows_pass_through(docs, rows):
    def passes(text):
        n, chars, symbols, dup_lines, repeats = measures(text)
        lines = [x for x in (text or "").split("\n") if x.encode().strip(SPACE)]
        return n >= 20 and 100 * repeats <= 30 * n and 10 * symbols <= 3 * n and 2 * dup_lines <= len(lines) and 2 * n <= chars <= 20 * n

    kept = Q.kept_documents(docs)
    assert kept.columns == docs.columns
    want = [r for r in rows if passes(r[1])]
    assert 0 < len(want) < len(rows) and Counter(map(tuple, kept.collect())) == Counter(want)


def test_policies_and_ablations(spark, docs, none):
    entries = Q.ledger(docs).cache()
    both = [Q.BASE, Q.CURRENT]
    ab = {(r["version"], r["rule"]): r for r in Q.ablations(entries, both).collect()}
    bits = {r.name: r.bit for r in Q.rules()}
    fails = [r["failures"] for r in entries.select("failures").collect()]
    for p in both:
        m = Q.mask(p, Q.rules())
        for name in p.rules:
            r = ab[p.version, name]
            assert r["kept"] == sum(f & m == 0 for f in fails)
            assert r["kept_without"] == sum(f & m & ~(1 << bits[name]) == 0 for f in fails)
            assert r["failing"] == sum(f >> bits[name] & 1 for f in fails)
    seen = Q.applied(entries, both)
    assert {"kept_v1", "kept_v2"} <= set(seen.columns)
    assert Q.ledger(none).count() == 0 and Q.ablations(Q.ledger(none), both).count() == 0


def test_exact(spark, docs, rows, none):
    path = shared_dir(spark)
    index = exact_dedup.DigestIndex(spark, "d_exact", path, buckets=4)
    got = exact_dedup.dedup(spark, docs, index).collect()
    low = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
    groups = {}
    for r in rows:
        groups.setdefault(low(r[1]), []).append(r[0])
    want = []
    for r in rows:
        g = groups[low(r[1])]
        keep = max((x for x in g if x is not None), default=None)
        want.append((r[0], keep, len(g), r[0] == keep, hashlib.sha256(low(r[1]).encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert index.rows().count() == len(groups)
    # a second batch: what is known keeps its id, what is new is added
    more = spark.createDataFrame([(1000, rows[5][1]), (1001, "brand new")], "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, "d_again", path, buckets=4)  # found again by its path
    again = {r["doc_id"]: r for r in exact_dedup.dedup(spark, more, index).collect()}
    assert not again[1000]["kept"] and again[1000]["keep_id"] == 18 and again[1001]["kept"]
    assert index.rows().count() == len(groups) + 1
    assert exact_dedup.dedup(spark, none, index).count() == 0 and index.rows().count() == len(groups) + 1


@pytest.mark.parametrize("what", ["rules", "exact"])
def test_no_python_in_the_plan(spark, docs, what):
    out = Q.kept_documents(docs) if what == "rules" else exact_dedup.dedup(spark, docs, exact_dedup.DigestIndex(spark, "d_plan", shared_dir(spark), buckets=4))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_anti_join_is_a_sort_merge_of_buckets(spark, docs):
    index = exact_dedup.DigestIndex(spark, "d_merge", shared_dir(spark), buckets=4)
    facts = exact_dedup.facts(exact_dedup.digested(docs))
    index.append(facts)
    plan = facts.join(index.rows().hint("merge"), "text_sha256", "left_anti")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan
    assert index.rows().where(F.col("keep_id").isNull()).count() == 0


def test_a_large_group_is_spread_over_the_tasks(spark):
    """Four of five rows have one text; no task of the way back gets more than its share of them."""
    docs = spark.range(0, 8000, 1, 8).selectExpr("id as doc_id", "case when id % 5 = 0 then concat('t', id) else 'ONE' end as text")
    rows = exact_dedup.digested(docs)
    found = exact_dedup.facts(rows)
    heavy = heavy_keys(found, "text_sha256", "group_size", 8000)
    assert len(heavy) == 1
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = Counter(r["p"] for r in spread_join(rows, found, "text_sha256", heavy).select("keep_id", F.spark_partition_id().alias("p")).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert max(sizes.values()) < 8000 / len(sizes) * 1.3 and len(sizes) == 4
    got = exact_dedup.dedup(spark, docs, exact_dedup.DigestIndex(spark, "d_large", shared_dir(spark), buckets=4)).collect()
    one = [r for r in got if r["group_size"] > 1]
    assert len(got) == 8000 and len(one) == 6400 and {(r["keep_id"], r["group_size"]) for r in one} == {(7999, 6400)} and sum(r["kept"] for r in got) == 1601
