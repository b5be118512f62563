"""Readers and writers that Spark's own formats need a little help for."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A result record with two levels of steps; records.py reads steps of any depth.
_STEP = "name: string, status: string, start: bigint, stop: bigint"
RESULT = (
    "uuid string, historyId string, testCaseId string, fullName string, name string, status string, description string, start bigint, stop bigint, "
    "labels array<struct<name: string, value: string>>, attachments array<struct<name: string, source: string, type: string>>, statusDetails struct<message: string, trace: string>, "
    f"steps array<struct<{_STEP}, statusDetails: struct<message: string, trace: string>, steps: array<struct<{_STEP}, attachments: array<struct<name: string, source: string, type: string>>>>>>"
)
CONTAINER = f"uuid string, children array<string>, befores array<struct<{_STEP}>>, afters array<struct<{_STEP}>>, start bigint, stop bigint"


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which every executor sees; of this machine only where the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="files-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def read_results(spark: SparkSession, path: str, a_file_each: bool = True) -> DataFrame:
    """JSON documents of a fixed schema, one a file or else one a line; what is no JSON has null fields."""
    return spark.read.schema(RESULT).option("multiLine", a_file_each).json(path)


def read_containers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONTAINER).option("multiLine", True).json(path)


def all_sections(spark: SparkSession, path: str) -> DataFrame:
    """Section, position and row (as JSON) of all sections of all YAML files at the path, read once, by a task for each file.

    A section that has no rows has one with a null position. Each file is whole in one task, as YAML has no parts.
    """
    try:
        import yaml  # noqa: F401
    except ImportError as e:  # pragma: no cover
        raise RuntimeError("reading YAML sections needs the yaml library") from e

    def run(batches):
        import json

        import pyarrow as pa
        import yaml

        for b in batches:
            for text in b.column(0).to_pylist():
                rows = []
                for name, items in (yaml.safe_load(text) or {}).items():
                    rows += [(str(name), i, json.dumps(x, default=str)) for i, x in enumerate(items or [])] or [(str(name), None, None)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.string()))], ["section", "position", "row"])

    return spark.read.text(path, wholetext=True).mapInArrow(run, "section string, position int, row string")


def section(sections: DataFrame, name: str, required: bool = False) -> DataFrame:
    """position and row of a section of all_sections(). One that isn't there has no rows; if it is required, that is an error."""
    own = sections.where(F.col("section") == name)
    if required and not own.limit(1).count():
        raise KeyError(name)
    return own.where("position is not null").select("position", "row")


def read_sections(spark: SparkSession, path: str, name: str, required: bool = False) -> DataFrame:
    """One section; for several, all_sections() reads the files once."""
    return section(all_sections(spark, path), name, required)


def generate_tasks(spark: SparkSession, n: int, owners: list[str], seed: int = 1) -> DataFrame:
    """N tasks with a random owner, weighted priority and status; equal seeds give equal tasks."""
    return _tasks(spark.range(1, n + 1), owners, [F.rand(seed + k) for k in range(4)])


def tasks_for(rows: DataFrame, key: str, owners: list[str], seed: int = 1) -> DataFrame:
    """A task for each row, with draws that follow from the row's key and the seed by md5, on any cluster."""
    draw = lambda k: F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.lit(str(k)), F.col("id").cast("string"))), 1, 8), 16, 10).cast("double") / 2**32
    return _tasks(rows.select(F.col(key).alias("id")), owners, [draw(k) for k in range(4)])


def keyed_tasks(spark: SparkSession, n: int, owners: list[str], seed: int = 1) -> DataFrame:
    """As generate_tasks, as tasks_for() the numbers from 1 to n."""
    return tasks_for(spark.range(1, n + 1), "id", owners, seed)


def _tasks(rows: DataFrame, owners: list[str], draws: list[Column]) -> DataFrame:
    pick = F.element_at(F.array(*[F.lit(o) for o in owners]), (F.floor(F.col("_o") * len(owners)) + 1).cast("int"))
    t = rows.withColumns(dict(zip(("_o", "_p", "_s", "_d"), draws, strict=True)))
    priority = F.when(F.col("_p") < 0.3, "High").when(F.col("_p") < 0.75, "Medium").otherwise("Low")
    status = F.when(F.col("_s") < 0.3, "Done").when(F.col("_s") < 0.6, "In-Progress").when(F.col("_s") < 0.8, "Pending").otherwise("To-Do")
    return t.select(F.col("id").alias("task"), pick.alias("owner"), priority.alias("priority"), status.alias("status"), F.round(0.1 + 0.8 * F.col("_d"), 2).alias("share"))


def write_table(df: DataFrame, path: str) -> None:
    """K1: as CSV with a header; an existing folder is an error that names it, and stays."""
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_workbook(sheets: dict[str, DataFrame], path: str) -> str:
    """K1: each sheet as a CSV folder below path. Returns a message: what was saved, or the sheet that is there already,
    before which the sheets have been written and after which none is."""
    for name, df in sheets.items():
        try:
            write_table(df, f"{path}/{file_name(name)}")
        except AnalysisException as e:
            return f"{name} was not saved: {e.getCondition()}"
    return f"saved {', '.join(sheets)}"


def write_quoted(df: DataFrame, path: str) -> None:
    """K6: every field in quotes, quotes doubled."""
    df.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def read_quoted(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """K6: fields may hold line ends and doubled quotes."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_attachments(df: DataFrame, path: str) -> None:
    """K2: a JSON line for each row."""
    df.write.json(path)


def write_failed(df: DataFrame, path: str, at: str = "start", status: str = "status") -> None:
    """K4: failed rows only, in a folder for each day."""
    df.where(F.col(status) == "failed").withColumn("dt", F.date_format(at, "yyyy-MM-dd")).write.partitionBy("dt").parquet(path)


def invoice_lines(df: DataFrame, name: str, total: str) -> DataFrame:
    """K5: the invoice's text for each row."""
    return df.withColumn("invoice", F.format_string("Hi %s, Your total purchase amount is %s. Thank you", F.col(name), F.col(total).cast("string")))


def file_name(name: str) -> str:
    """A name that every store takes."""
    return re.sub(r"[^A-Za-z0-9._-]+", "_", name)
