"""Positions, running sums and as-of joins in a global order, without a task that sees all rows of it or of a key.

Rows are dealt into ranges of the order: a range shuffle, written to the shared folder with the
number of its range as a partition column, so a later step reads only the ranges that it needs. What goes
from one range to the next is small: a count, or a carry for each key that goes on. A key with most of the
rows lies in many ranges, and each of them is a task.

The order may have ties: after its own columns come a hash of all columns and a number, so that equal
keys, and rows that are the same in all columns, are spread over ranges too. Rows that are the same in
all columns take each other's place. Nulls are placed as the order's columns say. An empty table has no ranges that
hold rows. Columns keep their names; those added here begin with two underscores.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.sources.files import scratch

RANGE_ROWS = 1 << 20


def _hashed(rows: DataFrame) -> Column:
    """A hash of all columns; maps and variants, which have no hash, as text."""
    plain = lambda f: F.col(f"`{f.name}`").cast("string") if any(x in f.dataType.simpleString() for x in ("map<", "variant")) else F.col(f"`{f.name}`")
    return F.xxhash64(*[plain(f) for f in rows.schema.fields])


@dataclass
class Ranged:
    """Rows at a path by range; starts[r] rows come before range r, and the last of starts is the number of rows."""

    spark: SparkSession
    path: str
    schema: str
    order: list[Column]
    starts: list[int]

    @property
    def n(self) -> int:
        return self.starts[-1]

    def rows(self, first: int = 0, last: int | None = None) -> DataFrame:
        """The rows of some ranges, with __range; other ranges' files aren't read."""
        df = self.spark.read.schema(f"{self.schema}, `__range` int").parquet(self.path)
        return df if not first and last is None else df.where((F.col("__range") >= first) & (F.col("__range") <= (len(self.starts) if last is None else last)))

    def inside(self, *by: str) -> Window:
        """The order within a range, or within a key's rows of a range."""
        return Window.partitionBy("__range", *by).orderBy(*self.order, "__hash", "__row")

    def per_range(self, first: int, last: int) -> DataFrame:
        """__range and __start of some ranges: as many rows as there are ranges."""
        return F.broadcast(self.spark.createDataFrame([(r, self.starts[r]) for r in range(first, last + 1)], "__range int, __start long"))

    def numbered(self, lo: int = 0, hi: int | None = None, name: str = "position") -> DataFrame:
        """The rows at positions lo (from 0) to hi, hi not included, with their position. Reads the ranges that hold them."""
        hi = self.n if hi is None else min(hi, self.n)
        lo = max(lo, 0)
        if lo >= hi:
            return self.rows(0, -1).drop("__range", "__hash", "__row").withColumn(name, F.lit(0).cast("long"))
        first, last = bisect_right(self.starts, lo) - 1, bisect_right(self.starts, hi - 1) - 1
        own = self.rows(first, last).withColumn("__at", F.row_number().over(self.inside()) - 1)
        out = own.join(self.per_range(first, last), "__range").withColumn(name, F.col("__start") + F.col("__at"))
        out = out if (lo, hi) == (0, self.n) else out.where((F.col(name) >= lo) & (F.col(name) < hi))
        return out.drop("__range", "__hash", "__row", "__start", "__at")

    def at(self, n: int) -> DataFrame:
        """L2: the row at position n, or no row."""
        return self.numbered(n, n + 1).drop("position")

    def strictly_at(self, n: int) -> DataFrame:
        """L1: the row at position n; it is an error if there is none."""
        if not 0 <= n < self.n:
            raise IndexError(f"no row at position {n} of {self.n}")
        return self.at(n)


def ranged(rows: DataFrame, order: list[Column], range_rows: int = RANGE_ROWS) -> Ranged:
    """Deals rows into ranges of about range_rows rows, or into as many as there are shuffle partitions."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // range_rows))
    named = rows.withColumns({"__hash": _hashed(rows), "__row": F.monotonically_increasing_id()})
    path = scratch(spark)
    named.repartitionByRange(n, *order, "__hash", "__row").withColumn("__range", F.spark_partition_id()).write.partitionBy("__range").parquet(path)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema.fields)
    counts = [0] * n
    for r in spark.read.schema(f"{schema}, `__range` int").parquet(path).groupBy("__range").count().collect():  # a row for each range
        counts[r["__range"]] = r["count"]
    return Ranged(spark, path, schema, order, [0, *accumulate(counts)])


def running(rows: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column], range_rows: int = RANGE_ROWS, least: dict[str, Column] | None = None, greatest: dict[str, Column] | None = None) -> DataFrame:
    """rows with running sums, least and greatest values: of the rows of the same `by` up to this one, itself included. Two
    levels: those of the ranges of a key are carried on, and each range takes in its own rows.

    A null adds nothing; before the first value the result is null, as it is in SQL. Rows with equal `order` in
    a key follow each other in no given order, so it should be total in it.
    """
    least, greatest = least or {}, greatest or {}
    how = dict.fromkeys(sums, F.sum) | dict.fromkeys(least, F.min) | dict.fromkeys(greatest, F.max)
    values = rows.withColumns({f"__v_{name}": c for name, c in (sums | least | greatest).items()})
    r = ranged(values, [*map(F.col, by), *order], range_rows)
    own = [f(f"__v_{name}").alias(f"__s_{name}") for name, f in how.items()]
    before = _carried(r, by, own, {f"__c_{name}": f(f"__s_{name}") for name, f in how.items()})
    local = r.rows().withColumns({f"__l_{name}": f(f"__v_{name}").over(r.inside(*by).rowsBetween(Window.unboundedPreceding, 0)) for name, f in how.items()})
    out = _with_carry(local, before, by)
    zero = lambda c: F.coalesce(c, F.lit(0))
    total = {name: F.when(F.col(f"__l_{name}").isNotNull() | F.col(f"__c_{name}").isNotNull(), zero(F.col(f"__l_{name}")) + zero(F.col(f"__c_{name}"))) for name in sums}
    total |= {name: F.least(f"__l_{name}", f"__c_{name}") for name in least} | {name: F.greatest(f"__l_{name}", f"__c_{name}") for name in greatest}
    return out.withColumns(total).select(*rows.columns, *how)


def moving(rows: DataFrame, by: list[str], order: list[Column], value: Column, preceding: int, name: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows with the sum of value over the frame ROWS BETWEEN preceding PRECEDING AND CURRENT ROW of each `by`.

    The frame's sum is the running sum less the one `preceding` + 1 rows before, which a join by the position
    in the key gets. So frames may be longer than a range. Values should be whole numbers or decimals, as differences of sums of doubles are
    not sums of doubles.
    """
    counted = running(rows, by, order, {"__sum": F.coalesce(value, F.lit(0)), "__there": value.isNotNull().cast("long"), "__n": F.lit(1).cast("long")}, range_rows)
    path = scratch(rows.sparkSession)
    counted.write.parquet(path)
    counted = rows.sparkSession.read.schema(counted.schema).parquet(path)
    # a null key has a text of its own
    key = F.to_json(F.struct(*by)) if by else F.lit("")
    past = counted.select(key.alias("__of"), (F.col("__n") + preceding + 1).alias("__at"), F.col("__sum").alias("__old"), F.col("__there").alias("__gone"))
    both = counted.withColumn("__key", key).join(past, (F.col("__n") == F.col("__at")) & (F.col("__key") == F.col("__of")), "left")
    there = F.col("__there") - F.coalesce("__gone", F.lit(0))
    return both.select(*rows.columns, F.when(there > 0, F.col("__sum") - F.coalesce("__old", F.lit(0))).alias(name))


def asof(left: DataFrame, right: DataFrame, by: list[str], time: str, values: list[str], tolerance: Column | None = None, exact: bool = True, range_rows: int = RANGE_ROWS) -> DataFrame:
    """left with the `values` of the last row of right with the same `by` whose time isn't after its own; null without one.

    With exact=False the time must be before its own; with a tolerance it must not be earlier by more than that (times
    are then numbers). Of several rows of right at one time the one with the largest values, compared in
    the order given, is taken. A null key or time matches nothing. Both sides are one stream of ranges by key and time; the
    last row of right before a range is carried to it.
    """
    late = 0 if exact else 2  # where right's rows come among left's of the same time
    body = F.struct(*left.columns)
    a = left.select(*by, F.col(time).alias("__time"), F.lit(1).alias("__side"), body.alias("__left"), F.lit(None).cast(right.select(F.struct(F.col(time).alias("__time"), *values)).schema[0].dataType).alias("__right"))
    own = right.where(F.col(time).isNotNull())
    b = own.select(*by, F.col(time).alias("__time"), F.lit(late).alias("__side"), F.lit(None).cast(left.select(body).schema[0].dataType).alias("__left"), F.struct(F.col(time).alias("__time"), *values).alias("__right"))
    r = ranged(a.unionByName(b), [*map(F.col, by), F.col("__time"), F.col("__side"), F.col("__right").asc_nulls_first()], range_rows)
    # within a key later rows have larger times, and of one time larger values, so the last is the greatest
    before = _carried(r, by, [F.max("__right").alias("__s_right")], {"__c_right": F.max("__s_right")})
    local = r.rows().withColumn("__l_right", F.last("__right", ignorenulls=True).over(r.inside(*by).rowsBetween(Window.unboundedPreceding, 0)))
    out = _with_carry(local, before, by).where(F.col("__left").isNotNull())
    found = F.coalesce("__l_right", "__c_right")
    whole = F.lit(True)
    for c in [*by, "__time"]:
        whole = whole & F.col(c).isNotNull()
    if tolerance is not None:
        whole = whole & (F.col("__time") - found["__time"] <= tolerance)
    return out.select(*[F.col(f"__left.{c}").alias(c) for c in left.columns], *[F.when(whole, found[v]).alias(v) for v in values])


def _carried(r: Ranged, by: list[str], own: list[Column], carry: dict[str, Column]) -> DataFrame:
    """For keys in several ranges: what comes before each of their ranges. There are fewer such keys than ranges, and fewer
    than two rows for each range."""
    per = r.rows().groupBy("__range", *by).agg(*own)
    several = per.withColumn("__ranges", F.count(F.lit(1)).over(Window.partitionBy(*by))).where("__ranges > 1")
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return several.select("__range", *by, *[c.over(before).alias(name) for name, c in carry.items()])


def _with_carry(local: DataFrame, before: DataFrame, by: list[str]) -> DataFrame:
    small = F.broadcast(before.withColumnsRenamed({"__range": "__r", **{c: f"__k_{c}" for c in by}}))
    same = F.col("__range") == F.col("__r")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    return local.join(small, same, "left")
