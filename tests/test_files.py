"""Readers and writers, by round trips."""

import json

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import runs
from tallyloom.plans import tables
from tallyloom.sources import files


def test_results_and_containers(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}-result.json").write_text(json.dumps({"uuid": str(k), "historyId": "h", "name": "n", "status": "passed", "start": k, "stop": k + 5, "labels": [{"name": "epic", "value": "E"}], "steps": [{"name": "s", "steps": [{"name": "deep"}]}]}, indent=1))
    (tmp_path / "c-container.json").write_text(json.dumps({"uuid": "c", "children": ["0", "2", "9"]}))
    r = files.read_results(spark, f"{tmp_path}/*-result.json")
    assert r.count() == 3 and r.select(F.col("steps")[0]["steps"][0]["name"]).first()[0] == "deep"
    c = files.read_containers(spark, f"{tmp_path}/*-container.json")
    got = runs.container_members(c, r.select("uuid", "start")).orderBy("uuid").collect()
    assert [(x["uuid"], x["start"]) for x in got] == [("0", 0), ("2", 2), ("9", None)]


def test_quoted_text(spark, tmp_path):
    rows = [("a\nb", 'say "x", y'), ("", None), ("é", "z")]
    df = spark.createDataFrame(rows, "a string, b string")
    files.write_quoted(df, f"{tmp_path}/q")
    got = files.read_quoted(spark, f"{tmp_path}/q", "a string, b string")
    assert {(r["a"] or "", r["b"] or "") for r in got.collect()} == {(a, b or "") for a, b in rows}


def test_failed_rows_by_day(spark, tmp_path):
    df = spark.createDataFrame([("failed", "2024-01-02 03:00:00"), ("passed", "2024-01-02 04:00:00"), ("failed", "2024-01-03 05:00:00")], "status string, start string").withColumn("start", F.to_timestamp("start"))
    files.write_failed(df, f"{tmp_path}/f")
    assert sorted(p.name for p in (tmp_path / "f").iterdir() if p.is_dir()) == ["dt=2024-01-02", "dt=2024-01-03"]
    assert spark.read.parquet(f"{tmp_path}/f").where("dt = '2024-01-03'").count() == 1


def test_an_existing_table_stays(spark, tmp_path):
    df = spark.range(3)
    files.write_table(df, f"{tmp_path}/t")
    with pytest.raises(Exception, match="(?i)already exists"):
        files.write_table(df, f"{tmp_path}/t")
    files.write_attachments(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 3


def test_sections(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "d.yaml").write_text("people:\n  - name: A\n    born: {day: '1'}\n  - name: B\n")
    got = files.read_sections(spark, f"file://{tmp_path}/d.yaml", "people", required=True).orderBy("position").collect()
    assert [json.loads(r["row"])["name"] for r in got] == ["A", "B"]
    assert files.read_sections(spark, f"file://{tmp_path}/d.yaml", "none").count() == 0
    with pytest.raises(KeyError):
        files.read_sections(spark, f"file://{tmp_path}/d.yaml", "none", required=True)


def test_generated_tasks(spark):
    a = files.generate_tasks(spark, 500, ["x", "y"], seed=3)
    assert a.count() == 500 and a.exceptAll(files.generate_tasks(spark, 500, ["x", "y"], seed=3)).count() == 0
    assert a.select("owner").distinct().count() == 2 and a.where("share < 0.1 or share > 0.9").count() == 0
    assert set(r[0] for r in a.select("status").distinct().collect()) == {"Done", "In-Progress", "Pending", "To-Do"}


def test_small_things(spark):
    df = files.invoice_lines(spark.createDataFrame([("A", 5)], "n string, t int"), "n", "t")
    assert df.first()["invoice"] == "Hi A, Your total purchase amount is 5. Thank you"
    assert files.file_name("a b/c?.png") == "a_b_c_.png" and tables.SPRINT == 1997
