"""Line deduplication by an edit join over segments.

Lines, without the white space around them, are linked when few edits turn one into the other. The
unit is the character where the line with fewer words has less than WORDS of them: one edit from
ONE characters on, two from FULL, three from LONG; shorter lines are in a class only if equal. From
WORDS words on the unit is the word, with an edit for each WORDS words, so a replaced word is one
edit whatever its length. `threshold` is the most edits in either case. Links give classes; the
first line of a class, by doc_id and line number, stays and the others go. Lines without words stay
as they are.

1. A task first leaves out the lines that it has met, by a 64-bit hash, so a very common line is one
   row a task in all that follows.
2. A text of l units is cut into one segment more than it allows edits, and is in the index under
   each segment with its number and l. Within the threshold at least one segment is left whole in
   the other text, so every text probes the index for its own and the shorter lengths with those
   stretches, and at those places only, that a segment can have moved to. Entries and probes are
   rows of a hash, the text's id, and 59 parities of its units, of which an edit changes two at most.
3. Rows meet in a shuffle by hash. A run of equal hashes gives pairs of an entry and a probe whose
   parities are near enough, if they are not many more than its rows. The texts of these candidates
   are found by a sieve of their ids, so that the others aren't shuffled, meet them in two joins,
   are verified by a banded bit-parallel automaton and give components.
4. What is left are the rows of long runs and of runs with many candidates, such as those of a
   template's lines or of near-copies. They get their texts and components, and a run is cut
   into blocks of ROWS; each two blocks are a unit, where pairs of different components are
   verified at once, the likeliest first, and each link joins two components. So no task holds a
   run, no group gives all its pairs, and no two near texts are left in different components.
5. The classes' first lines come from partial minima, and go back to the lines in joins that spread
   the rows of frequent lines and of large classes.

Nulls and other cases: a null text has no lines. Lines of documents with a null doc_id come after
all others. Rows that repeat a doc_id, a line number and the line are the same line: all stay or
all go. An empty table gives no rows. Other columns are ignored or, in `without_repeats`, pass
through. Texts and lines are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import parted, releasing, slices
from .components import components
from .shared import SPACES, heavy_keys, removed, shared_dir, sieved, spread_join, stored, unused

THRESHOLD, SHORTEST = 3, 1
ONE, FULL, LONG, WORDS = 12, 25, 96, 16
RUN, ROWS, PAIRS_A_ROW = 256, 4096, 2
CHARACTERS = 32 << 20  # of a block's lines
KEPT = 1 << 18
LINES_AT_ONCE = 1 << 14
ENTRY, PROBE = 1, 2
#: A mark holds BITS parities, then two bits of the role and two of the edits that the indexed length allows.
BITS = 59
INDEX = "hash long, id long, mark long"
SEED = 42  # of Spark's xxhash64
_FACTOR = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_FACTOR, -1, 1 << 64))


def signed64(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def line_id(line: str) -> int:
    """As F.xxhash64 of the line."""
    return signed64(xxhash.xxh64_intdigest(line, SEED))


def of_characters(length: int, threshold: int) -> int:
    """The edits that a line of this length may be away from one as long or longer."""
    return min(threshold, (length >= ONE) + (length >= FULL) + (length >= LONG))


def of_words(length: int, threshold: int) -> int:
    return min(threshold, length // WORDS)


def segments(length: int, threshold: int) -> list[tuple[int, int]]:
    """Begin and size of the threshold + 1 segments of a line; the later ones take what is over."""
    n = threshold + 1
    small, over = divmod(length, n)
    sizes = [small + (k >= n - over) for k in range(n)]
    return [(sum(sizes[:k]), sizes[k]) for k in range(n)]


def places(length: int, threshold: int, allowed: Callable[[int, int], int]) -> list[tuple[int, int, int, int, int]]:
    """(indexed length, segment, begin, size, role) of all rows of a line of this length."""
    out = {}
    for l in range(max(length - threshold, 1), length + 1):
        moved, most = length - l, allowed(l, threshold)
        if most < max(moved, 1):
            continue
        for k, (begin, size) in enumerate(segments(l, most)):
            # k errors at most before the segment, the others after it
            lo = max(0, begin - k, begin + moved - (most - k))
            hi = min(length - size, begin + k, begin + moved + (most - k))
            for at in range(lo, hi + 1):
                out[l, k, at, size] = PROBE
    if most := allowed(length, threshold):
        for k, (begin, size) in enumerate(segments(length, most)):
            out[length, k, begin, size] = out.get((length, k, begin, size), 0) | ENTRY
    return [(*where, role) for where, role in out.items()]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def parities(units: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each line BITS bits: bit c is the parity of how often units of that residue occur."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    odd = np.bincount(owner * 64 + (units % np.uint64(BITS)).astype(np.int64), minlength=64 * len(sizes)).reshape(-1, 64).astype(np.uint8) & 1
    return np.packbits(odd, axis=1, bitorder="little").view("<u8")[:, 0]


def rows_of(units: np.ndarray, sizes: np.ndarray, members: np.ndarray, allowed: Callable[[int, int], int], threshold: int, kind: int, known: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hash, line and mark of the members' entries and probes; the units of all lines come one after another."""
    out = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint64))]
    begins, parity = np.cumsum(sizes) - sizes, parities(units, sizes)
    with np.errstate(over="ignore"):
        power, back = (np.cumprod(np.append(np.uint64(1), np.full(len(units), f, np.uint64))) for f in (np.uint64(_FACTOR), _BACK))
        sums = np.append(np.uint64(0), np.cumsum(mixed(units + np.uint64(_FACTOR)) * power[:-1]))
        for length in np.unique(sizes[members]).tolist():
            if (kind, length) not in known:
                found = places(length, threshold, allowed)
                l, k, at, size, role = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else [np.empty(0, np.int64)] * 5
                most = np.array([allowed(int(x), threshold) for x in l], np.uint64)
                known[kind, length] = at, at + size, mixed(((l << 8 | k) << 2 | kind).astype(np.uint64)), role.astype(np.uint64) << np.uint64(BITS) | most << np.uint64(BITS + 2)
            lo, hi, name, role = known[kind, length]
            if not len(lo):
                continue
            lines = members[sizes[members] == length]
            lo, hi = begins[lines, None] + lo, begins[lines, None] + hi
            out.append((mixed((sums[hi] - sums[lo]) * back[lo] ^ name).ravel(), np.repeat(lines, len(name)), (parity[lines, None] | role).ravel()))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def new_in_task(b: pa.RecordBatch, seen: set[int]) -> pa.RecordBatch:
    """The rows with ids that the batch has not had before and that are not in `seen`, which remembers about KEPT."""
    ids, first = np.unique(b.column("id").to_numpy(), return_index=True)
    new = [k for k, i in zip(first.tolist(), ids.tolist(), strict=True) if i not in seen]
    if len(seen) > KEPT:
        seen.clear()
    seen.update(ids.tolist())
    return b.take(pa.array(sorted(new), pa.int64()))


def index_rows(texts: DataFrame, threshold: int) -> DataFrame:
    """Entries and probes of the texts (id, line); those of a text that a task has met are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        seen: set[int] = set()
        for batch in batches:
            for b in slices(new_in_task(batch, seen), "line", LINES_AT_ONCE):
                lines, ids = b.column("line").cast(pa.large_string()), b.column("id").to_numpy()
                names, code, n_words = parted(lines)
                words = np.array([xxhash.xxh64_intdigest(x) for x in names.to_pylist()], np.uint64)[code]
                # an edit of a character makes a word more or less at most
                few, many = np.flatnonzero(n_words < WORDS + threshold), np.flatnonzero(n_words >= WORDS)
                text = lines.take(pa.array(few)).to_pylist()
                chars = np.frombuffer("".join(text).encode("utf-32-le"), "<u4").astype(np.uint64)
                n_chars = np.zeros(len(lines), np.int64)
                n_chars[few] = [len(x) for x in text]
                for found in (rows_of(chars, n_chars, few, of_characters, threshold, 1, known), rows_of(words, n_words, many, of_words, threshold, 2, known)):
                    yield pa.RecordBatch.from_pydict({"hash": found[0].view(np.int64), "id": ids[found[1]], "mark": found[2].view(np.int64)})

    return texts.select("id", "line").mapInArrow(releasing(run), INDEX)


def _near(ids, marks, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the rows x and y of one hash are an entry and a probe of candidates."""
    role = marks >> BITS & 3
    meet = (role[x] & (role[y] >> 1) | role[y] & (role[x] >> 1)) & ENTRY
    apart = np.bitwise_count((marks[x] ^ marks[y]) & ((1 << BITS) - 1))
    return (meet > 0) & (ids[x] != ids[y]) & (apart <= 2 * (marks[x] >> (BITS + 2)))


def _pairs(hashes, ids, marks) -> tuple[np.ndarray, np.ndarray]:
    """Positions of candidates among rows that are sorted by hash."""
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    at, k = np.arange(len(hashes)), 1
    while len(at):
        at = at[at + k < len(hashes)]
        at = at[hashes[at + k] == hashes[at]]
        ok = at[_near(ids, marks, at, at + k)]
        a.append(ok)
        b.append(ok + k)
        k += 1
    return np.concatenate(a), np.concatenate(b)


def without_singles(cols: tuple, last: bool) -> tuple:
    """Rows in order of hash, id and mark, given in order of hash, without most of those that have a hash alone. More rows of
    the last hash may come unless `last`, so it stays; so does the first, which may go on from a batch before."""
    hashes = cols[0]
    if not len(hashes):
        return cols
    alone = np.append(True, hashes[1:] != hashes[:-1]) & np.append(hashes[1:] != hashes[:-1], last)
    alone[0] = False
    kept = np.flatnonzero(~alone)
    hashes, ids, marks = (c[kept] for c in cols)
    order = np.lexsort((marks, ids, hashes))
    return hashes[order], ids[order], marks[order]


def candidates(rows: DataFrame, run_rows: int) -> DataFrame:
    """a, b: pairs of ids; hash, id, mark: rows of long runs and of those with many candidates, with a and b
    null. Rows come sorted by hash, so a task holds a batch and a short run at most; those of one hash are put in order there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(cols: tuple, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, long
            cols = without_singles(cols, last)
            new = [np.append(True, c[1:] != c[:-1]) for c in cols] if len(cols[0]) else [np.empty(0, bool)]
            cols = tuple(c[np.logical_or.reduce(new)] for c in cols)  # a text comes once for each task that has it
            hashes = cols[0]
            ends = np.flatnonzero(np.append(hashes[1:] != hashes[:-1], last)) + 1 if len(hashes) else np.empty(0, np.int64)
            whole = int(ends[-1]) if len(ends) else 0
            begins = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
            size = ends - begins
            deferred = np.repeat(size > run_rows, size)
            if len(hashes) and long is not None:
                deferred |= hashes[:whole] == long
            rest = tuple(c[whole:] for c in cols)
            if len(rest[0]) > run_rows or (len(rest[0]) and rest[0][0] == long):  # a long run goes on in the next batch
                long, deferred, whole = rest[0][0], np.append(deferred, np.ones(len(rest[0]), bool)), len(hashes)
                rest = tuple(c[:0] for c in cols)
            held = rest
            short = np.flatnonzero(~deferred)
            own = [c[short] for c in cols]
            x, y = _pairs(*own)
            of = np.cumsum(np.append(True, own[0][1:] != own[0][:-1])) - 1 if len(short) else short
            many = (np.bincount(of[x], minlength=len(short)) > PAIRS_A_ROW * np.bincount(of, minlength=len(short)))[of[x]]
            deferred[short[np.concatenate([x[many], y[many]])]] = True
            a, b = own[1][x[~many]], own[1][y[~many]]
            if len(a):
                pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                none = pa.nulls(len(pair), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), none, none, none], names)
            if deferred.any():
                none = pa.nulls(int(deferred.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, *(pa.array(c[:whole][deferred]) for c in cols)], names)

        names = ["a", "b", "hash", "id", "mark"]
        held, long = None, None
        for batch in batches:
            cols = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if held is not None:
                cols = tuple(np.concatenate([x, y]) for x, y in zip(held, cols, strict=True))
            yield from out(cols, False)
        if held is not None and len(held[0]):
            yield from out(held, True)

    ordered = rows.repartition(F.col("hash")).sortWithinPartitions("hash")  # one number, which Spark sorts by radix
    return ordered.mapInArrow(releasing(run), f"a long, b long, {INDEX}")


def joining(ids, marks, component, lines, left: np.ndarray, right: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links that join components; of two rows at one position in left and right the earlier ones only."""
    out, same = [], left is right
    for k, j in enumerate(right):
        i = left[:k] if same else left
        i = i[component[i] != component[j]]
        i = i[_near(ids, marks, i, np.full(len(i), j))]
        for x in i[np.argsort(np.bitwise_count(marks[i] ^ marks[j]), kind="stable")]:
            if component[x] != component[j] and linked(lines[x], lines[j], threshold):
                out.append((int(min(ids[x], ids[j])), int(max(ids[x], ids[j]))))
                component[component == component[j]] = component[x]
    return out


def in_blocks(rows: DataFrame, threshold: int, block: int) -> DataFrame:
    """a, b: links between components, in runs of any length; each two blocks of a run are a unit.
    rows: hash, id, mark, line, component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(t: pa.Table) -> pa.RecordBatch:
            """Of whole units."""
            key = np.stack([t.column(c).to_numpy() for c in ("hash", "x", "y")])
            side, ids, marks, component = (t.column(c).to_numpy() for c in ("side", "id", "mark", "component"))
            component, lines = component.copy(), t.column("line").to_pylist()
            begins = np.append(np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0))), len(side))
            found = []
            for lo, hi in zip(begins, begins[1:], strict=False):
                own = slice(lo, hi)
                left, right = np.flatnonzero(side[own] <= 1), np.flatnonzero(side[own] >= 1)
                found += joining(ids[own], marks[own], component[own], lines[lo:hi], left, left if side[lo] == 1 else right, threshold)
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["a", "b"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            hash_, x, y = (t.column(c).to_numpy() for c in ("hash", "x", "y"))
            lo = int(np.flatnonzero((hash_ != hash_[-1]) | (x != x[-1]) | (y != y[-1])).max(initial=-1)) + 1
            if lo:
                yield done(t.slice(0, lo))
            held = t.slice(lo)
        if held is not None:
            yield done(held)

    runs = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("characters")).where("n > 1")
    blocks = F.ceil(F.greatest(F.col("n") / block, F.col("characters") / CHARACTERS)).cast("int")
    sized = rows.join(runs.select("hash", blocks.alias("blocks")), "hash")
    own = sized.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    each = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # side 0 and 2: the blocks of a unit; 1: the only block of a unit
    side = F.when(F.col("own") == F.col("other"), 1).when(F.col("own") < F.col("other"), 0).otherwise(2)
    units = each.select("hash", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), side.alias("side"), "id", "mark", "line", "component")
    return units.repartition(F.col("hash"), F.col("x"), F.col("y")).sortWithinPartitions("hash", "x", "y").mapInArrow(releasing(run), "a long, b long")


def within(a, b, threshold: int) -> bool:
    """Whether the edit distance of the sequences a and b is at most the threshold.

    After j units of b bit i of at[e] says that j - threshold + i units of a have been matched with
    e edits. The band of 2 * threshold + 1 bits moves with j.
    """
    if abs(len(a) - len(b)) > threshold:
        return False
    lo, most = 0, min(len(a), len(b))
    while lo < most and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < most - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    band = (1 << 2 * threshold + 1) - 1
    where: dict = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i + threshold
    inside = ((1 << len(a) + 1) - 1) << threshold
    at = [((1 << e + 1) - 1) << threshold & inside & band for e in range(threshold + 1)]
    for j, c in enumerate(b):
        same = where.get(c, 0) >> j & band
        room = inside >> j + 1 & band
        new = [at[0] & same]
        for e in range(1, threshold + 1):
            new.append((at[e] & same | at[e - 1] | at[e - 1] >> 1 | new[e - 1] << 1) & room)
        at = new
        if not at[-1]:
            return False
    return any(r >> len(a) - len(b) + threshold & 1 for r in at)


def linked(a: str, b: str, threshold: int) -> bool:
    """Whether the lines are near enough."""
    x, y = a.encode().split(), b.encode().split()
    if (few := min(len(x), len(y))) >= WORDS:
        return within(x, y, of_words(few, threshold))
    return within(a, b, of_characters(min(len(a), len(b)), threshold))


def verified(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """Those of the pairs a, b whose lines are near enough; texts: id, line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [linked(x, y, threshold) for x, y in zip(b.column("of_a").to_pylist(), b.column("of_b").to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    sided = lambda c: texts.select(F.col("id").alias(c), F.col("line").alias(f"of_{c}"))
    return pairs.join(sided("a").hint("merge"), "a").join(sided("b").hint("merge"), "b").mapInArrow(releasing(run), "a long, b long")


def links(spark: SparkSession, texts: DataFrame, threshold: int = THRESHOLD, run_rows: int = RUN, block: int = ROWS) -> DataFrame:
    """a, b: ids of lines that are near enough, so many that near lines are in one component. texts: id, line;
    repeated ones are one text.

    run_rows and block change what the work costs and which links stand for a component, never the components.
    """
    path = shared_dir(spark)
    found = stored(candidates(index_rows(texts, threshold), run_rows), spark, path)
    pairs = stored(found.where("a is not null").select("a", "b").distinct(), spark)
    late = stored(found.where("a is null").select("hash", "id", "mark").distinct(), spark)
    removed(spark, path)
    ids = stored(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).union(late.select("id")).distinct(), spark)
    # sort-merge joins at every size, as both sides grow with the input
    some = stored(sieved(texts, ids, "id").join(ids.hint("merge"), "id", "left_semi").groupBy("id").agg(F.first("line").alias("line")), spark)
    first = stored(verified(pairs, some, threshold), spark)
    if not late.limit(1).count():
        return first
    known = some.join(components(spark, first).withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    more = in_blocks(late.join(known, "id"), threshold, block)
    return stored(first.union(more).distinct(), spark)


def trimmed(c: Column) -> Column:
    """c without white space around it. Few lines have any, and trimming looks at every character of a line."""
    around = F.lit(False)
    for space in SPACES:
        around = around | c.startswith(space) | c.endswith(space)
    return F.when(around, F.btrim(c, F.lit(SPACES))).otherwise(c)


def line_rows(docs: DataFrame, shortest: int, text: str, id_col: str) -> DataFrame:
    """doc_id, line_no, line and id of the lines that take part."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    return rows.select("doc_id", "line_no", trimmed(F.col("line")).alias("line")).where(F.length("line") >= shortest).withColumn("id", F.xxhash64("line"))


def classes(spark: SparkSession, docs: DataFrame, threshold: int, shortest: int, text: str, id_col: str) -> DataFrame:
    """doc_id, line_no, id, linked (whether its class has other texts), first (doc_id and line_no of the first line
    of its class) and stays of each line that takes part."""
    lines = line_rows(docs, shortest, text, id_col)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line_no")
    found = links(spark, lines.select("id", "line"), threshold)
    rows = stored(lines.select("doc_id", "line_no", "id"), spark)
    texts = stored(rows.groupBy("id").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), spark)
    known = components(spark, found).withColumnRenamed("node", "id")
    by_text = texts.select("id", "first", "n").join(known, "id", "left")
    by_text = by_text.select("id", "first", "n", F.col("component").isNotNull().alias("linked"), F.coalesce("component", "id").alias("class")).where("n > 1 or linked")
    by_class = stored(by_text.groupBy("class").agg(F.min("first").alias("class_first"), F.count(F.lit(1)).alias("n_texts")), spark)
    large = heavy_keys(by_class, "class", "n_texts", by_class.agg(F.sum("n_texts")).first()[0] or 0)
    several = spread_join(by_text.select("id", "linked", "class"), by_class.select("class", "class_first"), "class", large).drop("class")
    frequent = heavy_keys(texts, "id", "n", texts.agg(F.sum("n")).first()[0] or 0)
    out = spread_join(rows, stored(several, spark), "id", frequent)
    first = F.coalesce("class_first", place)
    return out.select("doc_id", "line_no", "id", F.coalesce("linked", F.lit(False)).alias("linked"), first.alias("first"), (first == place).alias("stays"))


def by_document(spark: SparkSession, docs: DataFrame, threshold: int = THRESHOLD, shortest: int = SHORTEST, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_lines (those that take part), n_linked (those whose class has other texts), n_removed, removed_lines
    and first_docs: for each removed line its number and the document that has the first line of its class. A row
    for each doc_id."""
    c = classes(spark, docs, threshold, shortest, text, id_col)
    gone = F.when(~F.col("stays"), F.struct("line_no", F.col("first")["doc_id"].alias("doc")))
    per = c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("linked").alias("n_linked"), F.sort_array(F.collect_list(gone)).alias("gone"))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    out = ids.join(per.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    gone = F.coalesce("gone", F.array().cast("array<struct<line_no:int,doc:bigint>>"))
    return out.select("doc_id", zero(F.col("n_lines")).alias("n_lines"), zero(F.col("n_linked")).alias("n_linked"), F.size(gone).cast("long").alias("n_removed"), F.transform(gone, lambda x: x["line_no"]).alias("removed_lines"), F.transform(gone, lambda x: x["doc"]).alias("first_docs"))


def without_repeats(spark: SparkSession, docs: DataFrame, threshold: int = THRESHOLD, shortest: int = SHORTEST, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with the lines that don't stay taken out of the texts; every document is kept."""
    c = classes(spark, docs, threshold, shortest, text, id_col).where("not stays")
    of, lines = unused(docs, "_id"), unused(docs, "_gone")
    gone = c.groupBy(F.col("doc_id").alias(of)).agg(F.collect_set(F.struct("line_no", "id")).alias(lines))
    rows = docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col(of)), "left")
    # each line number of a document once, so a sorted search isn't needed
    left = F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains(F.col(lines), F.struct(i.alias("line_no"), F.xxhash64(trimmed(x)).alias("id"))))
    new = F.when(F.col(lines).isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))
    return rows.select(*[new.alias(x) if x == text else F.col(f"`{x}`") for x in docs.columns])
