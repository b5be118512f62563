"""Quality rules as a ledger of bits.

Every rule is evaluated once for each document. The ledger keeps the measurements and one
long whose bit i says that rule i failed. A policy is a version with a mask of rules; a
document passes it if no bit of the mask is set. Which documents a policy drops, and what
each rule adds to it, then need the ledger only, never the texts.

All of it is DataFrame functions; a text is read by one projection without a shuffle.

Nulls, empty tables and other cases: a null text counts as empty and has no words, so it
fails "few_words". Rows with a null or repeated doc_id are judged one by one, each has its
row in the ledger. The input's columns are in the struct `document`, so no name clashes. Long texts are measured whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACES, let, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    name: str
    bit: int
    fails: Column


@dataclass(frozen=True)
class Policy:
    version: int
    rules: tuple[str, ...]


def repeated_words(ws: Column, width: int = WINDOW) -> Column:
    """How many words lie in a window of so many words that the array holds twice or more.

    Windows are compared by a 64-bit hash. Only texts that have equal windows pay for the sort
    that finds where they are.
    """

    def hashes(w: Column) -> Column:
        at = lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width)))
        return F.transform(F.sequence(F.lit(0), F.size(w) - width), at)

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        starts = F.sort_array(F.transform(let(placed, twice), lambda x: x["i"]))
        begin = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).alias("last"))
        step = lambda acc, x: F.struct((acc["n"] + F.least(F.lit(width), x - acc["last"])).alias("n"), x.alias("last"))
        return F.aggregate(starts, begin, step, lambda acc: acc["n"])

    def judged(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h))

    return F.when(F.size(ws) <= width, F.lit(0).cast("long")).otherwise(let(let(ws, hashes), judged))


def measured(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, the measurements and the row itself as `document`; one row for each row of docs."""
    t = F.coalesce(F.col(text), F.lit(""))
    with_word = lambda x: F.length(F.translate(x, SPACES, "")) > 0
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"),
        words(F.col(text)).alias("_words"),
        F.filter(F.split(t, "\n"), with_word).alias("_lines"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    found = F.struct(
        F.size("_words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
    )
    # a later filter stays above the explode, so nothing is measured once for the filter and once more
    return base.select("doc_id", "document", F.explode(F.array(found)).alias("m")).select("doc_id", "document", "m.*")


def rules() -> list[Rule]:
    """The rules in the order of their bits. A bit is never given to another rule later."""
    c = F.col
    return [
        Rule("few_words", 0, c("n_words") < 20),
        Rule("repeated_windows", 1, 100 * c("n_repeat_words") > 30 * c("n_words")),
        Rule("symbols", 2, 10 * c("n_symbols") > 3 * c("n_words")),
        Rule("repeated_lines", 3, 2 * c("n_dup_lines") > c("n_lines")),
        Rule("short_words", 4, c("word_chars") < 2 * c("n_words")),
        Rule("long_words", 5, c("word_chars") > 20 * c("n_words")),
    ]


BASE = Policy(1, ("few_words", "repeated_windows"))
CURRENT = Policy(2, ("few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words"))


def mask(policy: Policy, of: list[Rule]) -> int:
    bits = {r.name: r.bit for r in of}
    return sum(1 << bits[name] for name in policy.rules)


def ledger(docs: DataFrame, of: list[Rule] | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The measurements and `failures`, the long with a bit for each failed rule."""
    of = of or rules()
    bits = [F.when(r.fails, F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")) for r in of]
    return measured(docs, text, id_col).withColumn("failures", reduce(lambda a, b: a.bitwiseOR(b), bits))


def passes(policy: Policy, of: list[Rule] | None = None) -> Column:
    """Whether a row of the ledger passes the policy."""
    return F.col("failures").bitwiseAND(F.lit(mask(policy, of or rules())).cast("long")) == 0


def applied(entries: DataFrame, policies: list[Policy], of: list[Rule] | None = None) -> DataFrame:
    """The ledger with a column kept_v<version> for each policy."""
    return entries.withColumns({f"kept_v{p.version}": passes(p, of) for p in policies})


def kept_documents(docs: DataFrame, policy: Policy = CURRENT, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs, as they are, that pass the policy."""
    return ledger(docs, None, text, id_col).where(passes(policy)).select("document.*")


def ablations(entries: DataFrame, policies: list[Policy], of: list[Rule] | None = None) -> DataFrame:
    """For each policy and each of its rules: documents that the policy keeps, that it would keep
    without the rule, and that fail the rule.

    The ledger is first counted by its failure bits, of which there are 2 ** rules at most, so
    the text and the rows are not needed again.
    """
    of = of or rules()
    patterns = entries.groupBy("failures").agg(F.count(F.lit(1)).alias("n"))
    bits = {r.name: r.bit for r in of}
    cases = [F.struct(F.lit(p.version).alias("version"), F.lit(name).alias("rule"), F.lit(mask(p, of)).cast("long").alias("mask"), F.lit(1 << bits[name]).cast("long").alias("bit")) for p in policies for name in p.rules]
    each = patterns.select("failures", "n", F.explode(F.array(*cases)).alias("p"))
    some = lambda m: F.sum(F.when(F.col("failures").bitwiseAND(m) == 0, F.col("n")).otherwise(0))
    return each.groupBy("p.version", "p.rule").agg(
        some(F.col("p.mask")).alias("kept"),
        some(F.col("p.mask").bitwiseAND(F.bitwise_not(F.col("p.bit")))).alias("kept_without"),
        F.sum(F.when(F.col("failures").bitwiseAND(F.col("p.bit")) != 0, F.col("n")).otherwise(0)).alias("failing"),
    )
