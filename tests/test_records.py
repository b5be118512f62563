"""Records with steps of any depth, by round trips and against plain recursion."""

import json
import random

from pyspark.sql import functions as F

from tallyloom.sources import records as S


def walk(steps, above="", depth=1):
    for i, s in enumerate(steps if isinstance(steps, list) else []):
        s = s if isinstance(s, dict) else {}
        path = f"{above}{i}"
        below = s.get("steps") if isinstance(s.get("steps"), list) else []
        yield path, depth, s.get("name"), s.get("status"), s.get("start"), s.get("stop"), len(below)
        yield from walk(below, f"{path}.", depth + 1)


def tree(r, depth):
    step = {"name": f'n"{r.randrange(99)}\n', "status": r.choice(["passed", "failed", "broken"]), "start": r.randrange(10**12), "stop": r.randrange(10**12)}
    if depth > 1:
        step["steps"] = [tree(r, r.randrange(1, depth)) for _ in range(r.randrange(3))] + [tree(r, depth - 1)]
    return step


def written(tmp_path, docs):
    for i, d in enumerate(docs):
        (tmp_path / f"{i}-result.json").write_text(d if isinstance(d, str) else json.dumps(d, indent=i % 2))
    return f"{tmp_path}/*-result.json"


def test_steps_of_any_depth(spark, tmp_path):
    r = random.Random(1)
    docs = [{"uuid": str(k), "status": "passed", "steps": [tree(r, d) for d in range(1, 1 + k % 8)]} for k in range(12)]
    records = S.read_records(spark, written(tmp_path, docs))
    got = S.flat_steps(spark, records).select("uuid", "path", "depth", "name", "status", "start", "stop", "n_steps").collect()
    assert sorted(map(tuple, got)) == sorted((d["uuid"], *row) for d in docs for row in walk(d["steps"]))
    assert max(x["depth"] for x in got) == 7


def test_odd_records(spark, tmp_path):
    docs = [{"uuid": "a"}, {"uuid": "b", "steps": None}, {"uuid": "c", "steps": "x"}, {"uuid": "d", "steps": [1, None, {"steps": [{}, {"name": "z", "steps": {}}]}]}, "no json {", {"uuid": "e", "steps": [], "extra": {"steps": [1]}}]
    records = S.read_records(spark, written(tmp_path, docs)).cache()
    assert sorted(x["broken"] for x in records.where("broken is not null").collect()) == ["no json {"] and records.count() == 6
    got = S.flat_steps(spark, records).select("uuid", "path", "name", "n_steps").collect()
    assert sorted(map(tuple, got)) == [("d", "0", None, 0), ("d", "1", None, 0), ("d", "2", None, 2), ("d", "2.0", None, 0), ("d", "2.1", "z", 0)]
    assert S.flat_steps(spark, records.where("uuid = 'a'")).count() == 0


def test_attachments_and_stats(spark, tmp_path):
    at = lambda n: [{"name": n, "source": f"{n}.txt", "type": "text/plain"}]
    deep = {"name": "x", "status": "failed", "steps": [{"status": "passed", "attachments": at("p")}, {"status": "broken", "statusDetails": {"message": "m"}, "attachments": at("q") * 2}]}
    docs = [{"uuid": "a", "steps": [{"status": "passed"}] * 11 + [deep, deep]}, {"uuid": "b", "steps": [{"status": "passed"}]}]
    steps = S.flat_steps(spark, S.read_records(spark, written(tmp_path, docs))).cache()
    assert sorted(map(tuple, S.step_stats(steps).collect())) == [("a", 17, 15, 2, 4, "11.1"), ("b", 1, 1, 1, 0, None)]
    assert sorted(tuple(x) for x in S.step_attachments(steps).collect()) == sorted(("a", f"{k}.{i}", p, n, f"{n}.txt", "text/plain") for k in (11, 12) for i, n, ps in ((0, "p", [0]), (1, "q", [0, 1])) for p in ps)
    assert steps.where("message = 'm'").count() == 2


def test_containers(spark, tmp_path):
    (tmp_path / "1-result.json").write_text(json.dumps({"uuid": "c", "children": ["a"], "befores": [{"name": "set up", "steps": [{"name": "in"}]}], "afters": [{"name": "tear down"}]}))
    c = S.read_containers(spark, f"{tmp_path}/*-result.json")
    assert [r["name"] for r in S.flat_steps(spark, c, steps="befores").orderBy("path").collect()] == ["set up", "in"]
    assert [r["name"] for r in S.flat_steps(spark, c, steps="afters").collect()] == ["tear down"]


def test_nested_is_the_way_back(spark, tmp_path):
    r = random.Random(2)
    docs = [{"uuid": str(k), "steps": [tree(r, 6) for _ in range(k + 1)]} for k in range(4)]
    docs[0]["steps"] = [{"name": None, "status": "é"}] * 12  # positions beyond nine
    flat = S.flat_steps(spark, S.read_records(spark, written(tmp_path, docs))).drop("attachments").cache()
    back = S.nested(spark, flat).withColumn("steps", F.parse_json("steps"))
    again = S.flat_steps(spark, back).drop("attachments")
    assert again.exceptAll(flat).count() == 0 and again.count() == flat.count()
    assert S.nested(spark, flat.where("false")).count() == 0


def test_nested_with_gaps(spark):
    """Steps without their parents are left out with all that is below them, repeated paths are one step, whole records stay whole."""
    rows = [(u, p, f"{u}{p}", None, None, None) for u, ps in {"a": ["0", "0.0", "0.2.0", "0.2.0.1", "0.3", "2.0", "10", "10.1"], "b": ["1.0", "1.0.0"], "c": ["0", "1", "1.0", "1.0"], "d": ["0.0", "1"]}.items() for p in ps]
    got = {r["uuid"]: json.loads(r["steps"]) for r in S.nested(spark, spark.createDataFrame(rows, "uuid string, path string, name string, status string, start long, stop long").repartition(3)).collect()}
    step = lambda name, *below: {"name": name, "steps": list(below)}
    assert got == {"a": [step("a0", step("a0.0"), step("a0.3")), step("a10", step("a10.1"))], "c": [step("c0"), step("c1", step("c1.0"))], "d": [step("d1")]}


def test_steps_cost_no_shuffle_and_few_files(spark, tmp_path):
    """Twenty levels are three parts, not twenty; the way back is one shuffle."""
    deep = {"name": "20"}
    for k in range(19, 0, -1):
        deep = {"name": str(k), "steps": [deep, {"name": "leaf"}]}
    flat = S.flat_steps(spark, S.read_records(spark, written(tmp_path, [{"uuid": "a", "steps": [deep]}])))
    assert sorted((r["depth"], r["name"]) for r in flat.collect()) == sorted([(k, str(k)) for k in range(1, 21)] + [(k, "leaf") for k in range(2, 21)])
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    assert plan(flat).count("FileScan") == 3
    back = S.nested(spark, flat)
    assert "Join" not in plan(back) and back._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
