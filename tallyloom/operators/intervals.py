"""Joins of intervals that overlap, as equal keys of a hierarchy of buckets.

Buckets of level k are 2 ** k long. An interval belongs to the smallest level whose buckets are as long as
it, so it lies in two of them at most. Of two that overlap, the one with the lower level meets the other in
the other's level, where it lies in two buckets at most as well. So each interval is a row or two for its own level,
and a row or two for each higher level that the other side has; levels are 64 at most. Both sides meet by (level,
bucket) and, if given, further keys, in an ordinary join that adaptive execution can split; no row is compared
with those that are nowhere near. A pair that shares two buckets is given in the one where the later of the two begins.

Pairs may be many more than rows. `overlap_totals` gives what is counted and summed up over them without making any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.ranges import RANGE_ROWS, running
from tallyloom.sources.files import scratch


def _level(begin: Column, end: Column) -> Column:
    """Of an interval with end - begin = n the bits of n."""
    return F.when(end > begin, F.length(F.bin(end - begin))).otherwise(0).cast("int")


def _buckets(level: Column) -> Column:
    lo, hi = (F.expr(f"shiftright({c}, __level)") for c in ("__begin", "__end"))
    return F.when(lo == hi, F.array(lo)).otherwise(F.sequence(lo, hi))


def overlapping(left: DataFrame, right: DataFrame, begin: str, end: str, by: list[str] | None = None, prefix: str = "other_") -> DataFrame:
    """Pairs of rows whose closed intervals [begin, end], of whole numbers, have a number in common, and that agree in `by`:
    the columns of left and those of right with the prefix.

    Nulls and other cases: an interval with a null or whose end is before its begin overlaps nothing; a null in `by` agrees with nothing. Rows
    that repeat give repeated pairs. The ends must be less than 2 ** 62 apart.
    """
    by = by or []

    def sided(df: DataFrame, side: str) -> DataFrame:
        whole = df.where((F.col(end) >= F.col(begin))).select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(side), F.col(begin).cast("long").alias("__begin"), F.col(end).cast("long").alias("__end"), *[F.col(c).alias(f"__by_{i}") for i, c in enumerate(by)])
        return whole.withColumn("__own", _level(F.col("__begin"), F.col("__end")))

    a, b = sided(left, "__left"), sided(right, "__right")
    # the levels that a side has: 64 rows at most
    levels = {side: sorted(r[0] for r in df.select("__own").distinct().collect()) for side, df in (("a", a), ("b", b))}
    keys = ["__level", "__bucket", *[f"__by_{i}" for i in range(len(by))]]

    def rows(df: DataFrame, at: Column, names: dict[str, str]) -> DataFrame:
        out = df.withColumn("__level", F.explode(at))
        return out.withColumn("__bucket", F.explode(_buckets(F.col("__level")))).withColumnsRenamed(names)

    def met(high: DataFrame, low: DataFrame, of: list[int], same: bool) -> DataFrame:
        """Pairs where `high` is of the higher level, or of the same one if `same`."""
        entries = rows(high, F.array("__own"), {"__begin": "__b1", "__end": "__e1"}).drop("__own")
        there = F.array(*[F.lit(x) for x in of]).cast("array<int>")
        probes = rows(low, F.filter(there, lambda x: (x >= F.col("__own")) if same else (x > F.col("__own"))), {"__begin": "__b2", "__end": "__e2"}).drop("__own")
        both = entries.join(probes, keys)
        later = F.greatest("__b1", "__b2")
        return both.where((F.col("__b1") <= F.col("__e2")) & (F.col("__b2") <= F.col("__e1")) & (F.expr("shiftright(greatest(__b1, __b2), __level)") == F.col("__bucket")) & later.isNotNull()).select("__left", "__right")

    pairs = met(a, b, levels["a"], True).unionByName(met(b, a, levels["b"], False))
    return pairs.select(*[F.col(f"__left.`{c}`").alias(c) for c in left.columns], *[F.col(f"__right.`{c}`").alias(f"{prefix}{c}") for c in right.columns])


def overlap_totals(left: DataFrame, right: DataFrame, begin: str, end: str, sums: dict[str, str], by: list[str] | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """left with what a row's pairs in overlapping() would give: n, the number of rows of right that overlap it, the sums
    of right's columns over these, `first`, their least begin, and `last`, their greatest end. sums: a new name and the column.

    Right is first summed up by begin and by end. Of [b, e] those that overlap are all that begin by e less
    those that end before b; all that end from b on have a least begin, which is theirs if it is by e; likewise the greatest
    end. These are running values over the points of both sides in order, forth and back, so the work grows with the rows
    and not with the pairs.

    Nulls and other cases: as in overlapping(); a row of left that overlaps nothing has n 0 and nulls. A null adds nothing; a
    sum of nulls is null. Columns summed up should be whole numbers or decimals, as differences of sums of doubles are not sums of doubles.
    """
    by, spark = by or [], left.sparkSession

    def kept(df: DataFrame) -> DataFrame:
        path = scratch(spark)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    keys = [f"__by_{i}" for i in range(len(by))]
    keyed = [F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)]
    whole = F.col(end) >= F.col(begin)
    for c in by:
        whole = whole & F.col(f"`{c}`").isNotNull()
    ends = [F.col(begin).cast("long").alias("__begin"), F.col(end).cast("long").alias("__end")]
    adds = {"__n": F.lit(1).cast("long")}
    for i, c in enumerate(sums.values()):
        adds |= {f"__sum_{i}": F.col(f"`{c}`"), f"__there_{i}": F.col(f"`{c}`").isNotNull().cast("long")}
    rows = kept(left.select(F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("__left"), *keyed, *ends, F.coalesce(whole, F.lit(False)).alias("__whole")).withColumn("__id", F.monotonically_increasing_id()))
    # intervals that are equal are one row from here on
    spans = kept(right.where(whole).select(*keyed, *ends, *[c.alias(a) for a, c in adds.items()]).groupBy(*keys, "__begin", "__end").agg(*[F.sum(a).alias(a) for a in adds]))
    added = [F.sum(a).alias(a) for a in adds]
    opened = spans.groupBy(*keys, F.col("__begin").alias("__at")).agg(*added, F.max("__end").alias("__far"))
    closed = spans.groupBy(*keys, F.col("__end").alias("__at")).agg(*added, F.min("__begin").alias("__far"))
    asked = rows.where("__whole")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in opened.schema.fields[len(keys) + 1 :]]
    at = lambda place: asked.select(*keys, F.col(place).alias("__at"), *none, "__id")
    sided = lambda df, side: df.withColumn("__side", F.lit(side))
    id_ = F.lit(None).cast("long").alias("__id")
    totals = {f"__up_{a}": F.col(a) for a in adds}
    # at one place: begins before the question for a row's end, ends after the one for its begin, each in its own stream
    up = running(sided(opened.select("*", id_), 0).unionByName(sided(at("__end"), 1)), keys, [F.col("__at"), F.col("__side"), F.col("__id")], totals, range_rows, greatest={"__most": F.col("__far")})
    gone = running(sided(closed.select("*", id_), 1).unionByName(sided(at("__begin"), 0)), keys, [F.col("__at"), F.col("__side"), F.col("__id")], totals, range_rows)
    down = running(sided(closed.select("*", id_), 0).unionByName(sided(at("__begin"), 1)), keys, [F.col("__at").desc(), F.col("__side"), F.col("__id")], {}, range_rows, least={"__most": F.col("__far")})
    answers = lambda df, names: df.where("__id is not null").select("__id", *[F.col(x).alias(y) for x, y in names.items()])
    zero = lambda c: F.coalesce(c, F.lit(0))
    met = answers(up, {t: t for t in totals} | {"__most": "__last"}).join(answers(gone, {t: f"{t}_gone" for t in totals}), "__id").join(answers(down, {"__most": "__first"}), "__id")
    less = {a: zero(F.col(f"__up_{a}")) - zero(F.col(f"__up_{a}_gone")) for a in adds}
    out = rows.join(met.select("__id", *[c.alias(a) for a, c in less.items()], "__first", "__last"), "__id", "left")
    summed = [F.when(F.col(f"__there_{i}") > 0, F.col(f"__sum_{i}")).alias(name) for i, name in enumerate(sums)]
    some = F.col("__n") > 0
    return out.select(*[F.col(f"__left.`{c}`").alias(c) for c in left.columns], zero(F.col("__n")).cast("long").alias("n"), *summed, F.when(some, F.col("__first")).alias("first"), F.when(some, F.col("__last")).alias("last"))
