"""Result records whose steps may be nested to any depth.

A record is read with its steps as a VARIANT, which has no depth. A step gives its own row and those of the steps right below it,
so LEVELS levels come out of a record's row one after another in one go; they are written once to the shared
folder. What is deeper goes on from there, LEVELS levels at a time, until nothing is below. `nested` is the way back:
a record's steps are sorted and written down as one text, as a record is one document anyway.

A step's path has the position, from 0, of each step on the way to it: '0.2' is the third step of the
first one. Nulls and other cases: a record without steps gives no rows; steps that are null, no array,
or items that are no objects are kept as a row with null fields, so that no position is lost.
Documents that are no JSON have null fields and their text in `broken`. Records that repeat an id
are not told apart. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import scratch

_ATTACHMENTS = "array<struct<name: string, source: string, type: string>>"
RECORD = (
    "uuid string, historyId string, testCaseId string, fullName string, name string, status string, description string, start bigint, stop bigint, "
    f"labels array<struct<name: string, value: string>>, attachments {_ATTACHMENTS}, statusDetails struct<message: string, trace: string>, steps variant, broken string"
)
CONTAINER = "uuid string, children array<string>, befores variant, afters variant, start bigint, stop bigint, broken string"
STEP = {"name": "string", "status": "string", "start": "bigint", "stop": "bigint"}
#: A step as it is read; what doesn't fit is null.
_STEP = f"struct<{', '.join(f'{n}: {kind}' for n, kind in STEP.items())}, statusDetails: struct<message: string>, attachments: {_ATTACHMENTS}, steps: array<variant>>"
LEVELS = 8


def read_records(spark: SparkSession, path: str, a_file_each: bool = True) -> DataFrame:
    """Result records, one a file or else one a line; the columns of RECORD."""
    return spark.read.schema(RECORD).option("multiLine", a_file_each).option("columnNameOfCorruptRecord", "broken").json(path)


def read_containers(spark: SparkSession, path: str, a_file_each: bool = True) -> DataFrame:
    """Fixture containers; what runs before and after has steps too."""
    return spark.read.schema(CONTAINER).option("multiLine", a_file_each).option("columnNameOfCorruptRecord", "broken").json(path)


def flat_steps(spark: SparkSession, records: DataFrame, id_col: str = "uuid", steps: str = "steps") -> DataFrame:
    """uuid, path, depth (from 1), the fields of STEP, message, attachments and n_steps, the number of steps
    right below, of every step at every depth."""
    fields, none = [*STEP, "message", "attachments", "n_steps"], F.expr("cast(null as variant)")

    def own(at: DataFrame, step: str = "step") -> DataFrame:
        return at.withColumn("__t", F.try_variant_get(step, "$", _STEP)).withColumn("__n", F.coalesce(F.size("__t.steps"), F.lit(0)))

    value = {**{n: F.col(f"__t.{n}") for n in STEP}, "message": F.col("__t.statusDetails.message"), "attachments": F.col("__t.attachments"), "n_steps": F.greatest("__n", F.lit(0))}
    below = F.when(F.col("__n") > 0, F.col("__t.steps"))
    at = records.select(F.col(id_col).alias("uuid"), F.posexplode(F.try_variant_get(steps, "$", "array<variant>")).alias("position", "step"))
    at, parts, depth = at.withColumn("above", F.lit("")), [], 1
    while True:
        rows = own(at).select("uuid", F.concat("above", F.col("position").cast("string")).alias("path"), F.lit(depth).alias("depth"), *[value[n].alias(n) for n in fields], below.alias("below"))
        for _ in range(LEVELS - 1):  # each row again, and the steps below those that are new
            each = F.posexplode(F.when(F.col("below").isNull(), F.array(none)).otherwise(F.concat(F.array(none), "below"))).alias("position", "step")
            new = F.col("position") > 0
            out = own(rows.select("uuid", "path", "depth", *fields, each))
            path = F.when(new, F.concat("path", F.lit("."), (F.col("position") - 1).cast("string"))).otherwise(F.col("path"))
            rows = out.select("uuid", path.alias("path"), F.when(new, F.col("depth") + 1).otherwise(F.col("depth")).alias("depth"), *[F.when(new, value[n]).otherwise(F.col(n)).alias(n) for n in fields], below.alias("below"))
        depth += LEVELS
        where = scratch(spark)
        rows.write.parquet(where)
        part = spark.read.schema(rows.schema).parquet(where)
        parts.append(part.drop("below"))
        deeper = part.where((F.col("depth") == depth - 1) & (F.col("n_steps") > 0))
        if not deeper.limit(1).count():
            return reduce(DataFrame.unionByName, parts)
        at = deeper.select("uuid", F.concat("path", F.lit(".")).alias("above"), F.posexplode("below").alias("position", "step"))


def step_attachments(steps: DataFrame) -> DataFrame:
    """uuid, path, position, name, source and type of each attachment of flat_steps()."""
    return steps.select("uuid", "path", F.posexplode("attachments").alias("position", "a")).select("uuid", "path", "position", "a.name", "a.source", "a.type")


def step_stats(steps: DataFrame) -> DataFrame:
    """Of each record: steps, leaves, the greatest depth, failed steps, and the deepest failed step: of the deepest the
    first in the order of the record, where a failure began."""
    bad = F.col("status").isin("failed", "broken")
    first = F.min_by("path", F.when(bad, F.struct(-F.col("depth"), place("path"))))
    return steps.groupBy("uuid").agg(F.count(F.lit(1)).alias("steps"), F.count_if(F.col("n_steps") == 0).alias("leaves"), F.max("depth").alias("deepest"), F.count_if(bad).alias("failed"), first.alias("failed_at"))


def place(path: str) -> Column:
    """The path as numbers, which sort as the steps do."""
    return F.transform(F.split(path, r"\."), lambda x: x.cast("int"))


def nested(spark: SparkSession, steps: DataFrame) -> DataFrame:
    """uuid and steps, a JSON array, of flat steps (uuid, path and the fields of STEP).

    A record's steps are gathered in one row, as a record is one document anyway. Of rows that
    repeat a record's path one is taken; a step whose parent isn't there is left out.
    """
    # nothing but the object's own braces is trimmed, as a value ends with a digit or a quotation mark
    own = F.btrim(F.to_json(F.struct(*STEP), {"ignoreNullFields": "true"}), F.lit("{}"))
    each = steps.where("path is not null").groupBy("uuid").agg(F.sort_array(F.collect_list(F.struct(place("path").alias("at"), own.alias("own")))).alias("all"))

    def follows(x: Column, last: Column) -> Column:
        """Whether the parent of x is `last` or above it, as it is for each step of a whole tree and the one before it."""
        n = F.size(x["at"]) - 1
        return (n == 0) | (last.isNotNull() & (F.size(last["at"]) >= n) & (F.slice(x["at"], 1, n) == F.slice(last["at"], 1, n)))

    def opened(x: Column, last: Column) -> Column:
        """A step up to where those below it come, after the ends of those before it."""
        up = F.coalesce(F.size(last["at"]), F.lit(0)) - F.size(x["at"])
        return F.concat(F.when(up >= 0, F.concat(F.repeat(F.lit("]}"), up), F.lit("]},"))).otherwise(""), F.lit("{"), x["own"], F.when(x["own"] == "", '"steps":[').otherwise(',"steps":['))

    def joined(pieces: Column, tree: Column) -> Column:
        return F.concat(F.lit("["), F.array_join(pieces, ""), F.repeat(F.lit("]}"), F.size(F.get(tree, F.size(tree) - 1)["at"])), F.lit("]"))

    tree = F.col("all")
    before = lambda c, i: F.get(c, i - 1)
    again = lambda x, last: last.isNotNull() & (x["at"] == last["at"])
    # null where a step lacks its parent; only such a record's steps are kept one by one
    pieces = F.transform(tree, lambda x, i: F.when(again(x, before(tree, i)), "").when(follows(x, before(tree, i)), opened(x, before(tree, i))))
    last = lambda found: F.get(found, F.size(found) - 1)
    kept = F.aggregate(tree, F.slice(tree, 1, 0), lambda found, x: F.when(follows(x, last(found)) & ~again(x, last(found)), F.concat(found, F.array(x))).otherwise(found))
    some = F.filter(F.array(kept), lambda x: F.size(x) > 0)  # no text without steps
    mended = F.get(F.transform(some, lambda t: joined(F.transform(t, lambda x, i: opened(x, before(t, i))), t)), 0)
    text = F.when(F.exists("pieces", lambda x: x.isNull()), mended).otherwise(joined(F.col("pieces"), tree))
    # inline, as a filter would be computed below this, and the text twice
    return each.withColumn("pieces", pieces).withColumn("text", text).select(F.inline(F.filter(F.array(F.struct("uuid", F.col("text").alias("steps"))), lambda x: x["steps"].isNotNull())))
