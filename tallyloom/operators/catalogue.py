"""Catalogues, carts and accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import rules as R

from .ranges import ranged

FAR = 10_000  # rows up to here are taken task by task


def search(items: DataFrame, name: str, term: str) -> DataFrame:
    """items whose name has the term, in any case."""
    return items.where(R.has_text(F.col(name), F.lit(term)))


def numbered(rows: DataFrame, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """V3: position, from 0, in the given total order, within each group."""
    w = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    return rows.withColumn("position", F.row_number().over(w) - 1)


def nth(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """L2, L3: the n-th row (from 0) in the order, or no row.

    Near the front each task keeps n + 1 rows at most; a row beyond FAR is found by ranges of the order, of which only its own is
    numbered.
    """
    if n > FAR:
        return ranged(rows, order).at(n)
    first = rows.orderBy(*order).limit(n + 1)
    return numbered(first, order).where(F.col("position") == n).drop("position")


def nth_strict(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """L1: as nth, but having no such row is an error when the result is read."""
    there = nth(rows, order, n)
    counted = there.agg(F.count(F.lit(1)).alias("_n")).select(F.when(F.col("_n") == 0, F.raise_error(F.lit(f"no row at position {n}")).cast("int")).otherwise(F.lit(1)).alias("_n"))
    return there.crossJoin(F.broadcast(counted.where("_n = 1"))).drop("_n")


def second_else_first(rows: DataFrame, order: list[Column], by: list[str]) -> DataFrame:
    """L4: of each group the second row, or the first where there is no other."""
    w = Window.partitionBy(*by).orderBy(*order)
    near = rows.withColumns({"_at": F.row_number().over(w), "_next": F.lead(F.lit(1)).over(w)})
    return near.where((F.col("_at") == 2) | ((F.col("_at") == 1) & F.col("_next").isNull())).drop("_at", "_next")


def without_nth(rows: DataFrame, order: list[Column], by: list[str], n: int) -> DataFrame:
    """Each group without its n-th row (from 0); a group without such a row stays whole."""
    return numbered(rows, order, by).where(F.col("position") != n)


def counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows of each group and whether there are any."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) > 0).alias("any_there"))


def delta(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """Counts of each group before and after, and whether exactly one row has gone."""
    b, a = (d.groupBy(by).agg(F.count(F.lit(1)).alias(n)) for d, n in ((before, "n_before"), (after, "n_after")))
    out = b.join(a, by, "left").withColumn("n_after", F.coalesce("n_after", F.lit(0).cast("long")))
    return out.withColumn("one_less", F.col("n_after") == F.col("n_before") - 1)


def snapshot_diff(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """U2, and stricter than a count: what was added, removed or changed between two snapshots."""
    a = before.groupBy(*key).agg(F.sum(value).alias("was"))
    b = after.groupBy(*key).agg(F.sum(value).alias("now"))
    out = a.join(b, key, "full_outer")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return out.withColumn("change", kind).where("change is not null")


def add_all(wanted: DataFrame, stock: DataFrame, key: str) -> DataFrame:
    """How many items were attempted and how many of them succeeded, which may be fewer."""
    hit = wanted.join(stock.select(key).distinct().withColumn("_there", F.lit(1)), key, "left")
    return hit.agg(F.count(F.lit(1)).alias("attempted"), F.count("_there").alias("succeeded"))


def duplicates(accounts: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """F16: the rows that come after the first of their key, which a sign-up would reject."""
    w = Window.partitionBy(key).orderBy(*order)
    return accounts.withColumn("_at", F.row_number().over(w)).where("_at > 1").drop("_at")


def unmatched(attempts: DataFrame, accounts: DataFrame, keys: list[str]) -> DataFrame:
    """attempts that no account matches in all keys."""
    return attempts.join(accounts.select(*keys), keys, "left_anti")


def brand_counts(items: DataFrame, brand: str) -> DataFrame:
    """How often each brand is listed; the number of rows is the number of different brands."""
    return items.groupBy(F.col(brand).alias("brand")).agg(F.count(F.lit(1)).alias("n"))
