"""Every stage on its own input, and the registry."""

from collections import Counter

import corpus_pipeline
import pytest
import test_forest
import test_lines
import test_native
import test_packing

import __spark_entry__ as entry
from tallyloom.llm import mixing, registry


def test_stages_and_run(spark, tmp_path, rows, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
    again = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda df: Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in df.collect())
    a, b = key(at), key(again)
    assert sum(n * k[2] for k, n in a.items()) == sum(n * k[2] for k, n in b.items()) > 0
    assert {k[0] for k in a} <= {r[0] for r in rows}


def plain_lines(rows):
    _, first, _ = test_lines.by_hand(rows)
    for r in rows:
        lines = (r[1] or "").split("\n")
        stay = [x for n, x in enumerate(lines) if (t := x.encode().strip(test_lines.SPACE).decode()) not in first or first[t] == (r[0] is None, r[0] or 0, n)]
        yield (r[0], "\n".join(stay), r[2], r[3], len("\n".join(stay)))


def test_every_stage_against_brute_force(spark, tmp_path):
    """Copies, near copies, repeated and nearly repeated lines, junk, three sources; each stage on what the one before kept."""
    prose = lambda n, seed: " ".join(f"{'abcdefghi'[k % 9]}w{(k * 7 + seed * 13 + k * k * seed) % 97}" for k in range(n))
    texts = [prose(40 + 7 * k, k + 5) for k in range(14)]
    texts += [t + " and an end" for t in texts[:5]] + [texts[6], texts[6].upper(), texts[7] + "\n" + prose(30, 3), prose(30, 3) + "x\n" + texts[8], "#* $ % " * 30, "too short", "a b c d e f g h " * 9, ""]
    rows = [(k * 2, t, "en", "abc"[k % 3], len(t)) for k, t in enumerate(texts)]
    at = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = sorted((tuple(r) for r in at.collect()), key=repr)

    def passes(text):
        n, chars, symbols, dup_lines, repeats = test_native.measures(text)
        lines = [x for x in text.split("\n") if x.strip()]
        return n >= 20 and 100 * repeats <= 30 * n and 10 * symbols <= 3 * n and 2 * dup_lines <= len(lines) and 2 * n <= chars <= 20 * n

    assert out["quality_rules"] == sorted((r for r in rows if passes(r[1])), key=repr) and 0 < len(out["quality_rules"]) < len(rows)
    assert out["line_dedup"] == sorted(plain_lines(out["quality_rules"]), key=repr) != out["quality_rules"]
    component = test_forest.by_hand([(r[0], r[1]) for r in out["line_dedup"]])
    assert out["near_dedup"] == [r for r in out["line_dedup"] if component[r[0]] == r[0]]
    words = lambda t: t.encode().split()
    had, got = {r[0]: words(r[1]) for r in out["near_dedup"]}, Counter()
    for r in out["mixing"]:
        rest = iter(had[r[0]])
        assert all(w in rest for w in words(r[1])) and r[4] == len(r[1])
        got[r[0]] += len(words(r[1]))
    source = {r[0]: r[3] for r in out["near_dedup"]}
    sizes, taken = Counter(), Counter()
    for i, ws in had.items():
        sizes[source[i]] += len(ws)
        taken[source[i]] += got[i]
        assert got[i] <= 3 * len(ws)
    weight = {s: k + 1 for k, s in enumerate(sorted(sizes))}
    assert all(abs(taken[s] - min(3 * sizes[s], sum(sizes.values()) * weight[s] / sum(weight.values()))) <= 2 * mixing.BLOCK for s in sizes)
    assert sum(p[2] for p in out["packing"]) == sum(len(test_packing.whole(r[1])) for r in out["mixing"])


def test_stages_on_nothing(spark, none, tmp_path):
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, none, str(tmp_path)).count() == 0, name


INTERNAL = ["_id", "_gone", "_text_id", "_word", "_words", "_lines", "_sha1", "_source", "_bucket", "_start", "_before", "_key", "_heavy", "_right", "_bits", "doc", "document", "row", "line", "line_no", "id", "k1", "k2", "n", "unit", "copy", "part", "parts", "whole", "size", "block", "component", "node", "labels", "digest", "failures", "a.b"]


def test_columns_with_internal_names(spark, rows, tmp_path):
    """Other columns pass through every stage, whatever they are called."""
    own = spark.createDataFrame([(*r[:5], *[f"{k}"] * len(INTERNAL)) for k, r in enumerate(rows[:8])], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in INTERNAL))
    at = own
    for name, stage in corpus_pipeline.STAGES[:4]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == own.columns, name
        at.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        assert at.count(), name
        for r in at.select("doc_id", *[f"`{c}`" for c in INTERNAL]).collect():
            assert set(r[1:]) == {str(r["doc_id"] // 3)}, name
    assert corpus_pipeline.STAGES[4][1](spark, at, str(tmp_path)).count()


@pytest.mark.parametrize("n", range(1, 14))
def test_registered_once(n):
    assert sum(q.startswith(f"op{n}_") for q in registry.queries()) == 1


def test_entry_has_all():
    assert set(registry.queries()) | {"pipeline"} <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert "pipeline" in entry.queries() and len(corpus_pipeline.STAGES) == 5
