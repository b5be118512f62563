"""Ranked lexical search over document shards.

Terms are the maximal runs of ASCII letters, digits and characters beyond ASCII; only A-Z are
lower-cased. With N the documents that have a term, L all their terms, n a document's, df the
documents that hold a term and tf its occurrences in one:

    w = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))             in doubles
    m = 100 - 50 + ((50 * n * N) div L)
    score = sum of w * ((1000000000 * tf) div (1000 * tf + 20 * m)) over the query's different terms

1. One scan counts N and L from the bytes of the texts, without making terms.
2. A second cuts each task's documents into shards of at most `shard_docs` documents and about
   `shard_bytes` of text. A shard is one row in CSR form: the ids of its documents in order, its terms
   in order, offsets, ordinals of documents, and integer impacts, the score's part of document and
   term. No text, term or posting is shuffled. A file has few shards, so that reading it needs little memory.
3. Queries are read in blocks of about BLOCK terms each, the only thing that is sent to all tasks. A scan of
   terms and offsets gives the df of a block's terms, a second one scores: for each shard and query
   the terms' lists are added, one after another, into a dense array over the shard's documents, of
   which those at or above the k-th largest score are kept, so ties are never cut by chance.
4. The shards' k best meet by query in two rounds, first by parts of a query, so no task gets all
   shards' rows of one query.

Nulls and other cases: a null, empty or termless text has no terms; such documents are never found
and such queries give no rows. Ties go by ascending id, null ids last. Rows that repeat an id, of
documents or of queries, are documents and queries of their own. Empty tables give no rows. Other
columns are ignored. Texts and queries are read whole; a block holds one query at least, whatever
its length, and a shard one document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .columns import releasing, slices
from .shared import shared_dir, stored

SHARD_DOCS, SHARD_BYTES = 4096, 4 << 20
SHARDS_A_FILE = 4
BLOCK = 1 << 20
DOCS_AT_ONCE = 4096
PARTS = 64
MISSING = np.iinfo(np.int64).max
#: For each byte: itself, A-Z as a-z, and a space where it is no part of a term.
_BYTE = np.arange(256, dtype=np.uint8)
_LETTER = ((_BYTE | 32) >= 97) & ((_BYTE | 32) <= 122) & (_BYTE < 128)
_PART = _LETTER | (_BYTE >= 128) | ((_BYTE >= 48) & (_BYTE <= 57))
CLEAN = np.where(_PART, np.where(_LETTER, _BYTE | 32, _BYTE), 32).astype(np.uint8)
SHARDS = "ids binary, terms array<string>, offsets binary, ordinals binary, impacts binary"


def cleaned(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts with terms parted by spaces only, and where each text begins; null as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = CLEAN[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data is not None else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def n_terms(texts: pa.Array) -> np.ndarray:
    """How many terms each text has."""
    raw, offsets = cleaned(texts)
    first = np.flatnonzero(raw != 32)
    first = first[(first == 0) | (raw[first - 1] == 32) | np.isin(first, offsets)]
    return np.diff(np.searchsorted(first, offsets))


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different terms, each term of the texts as a position among them, and its text's position."""
    raw, offsets = cleaned(texts)
    parts = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())))
    flat = parts.flatten().dictionary_encode()
    code = flat.indices.to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    empty = pc.index(flat.dictionary, "").as_py()
    if empty >= 0:  # comes before and after white space at a text's ends
        owner, code = owner[code != empty], code[code != empty]
    return flat.dictionary, code, owner


def totals(docs: DataFrame, text: str) -> tuple[int, int]:
    """N and L."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for b in batches:
            for cut in slices(b, "text", DOCS_AT_ONCE):
                found = n_terms(cut.column(0))
                n, total = n + int((found > 0).sum()), total + int(found.sum())
        yield pa.RecordBatch.from_pydict({"n": [n], "total": [total]})

    counted = docs.select(F.col(text).alias("text")).mapInArrow(releasing(run), "n long, total long")
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()


class Shard:
    """A shard in the making: postings of slices of documents."""

    def __init__(self):
        self.ids, self.docs, self.size, self.slices = [], 0, 0, []

    def add(self, ids: np.ndarray, texts: pa.Array, n: int, total: int) -> None:
        names, code, owner = terms_of(texts)
        length = np.bincount(owner, minlength=len(ids))
        at, tf = np.unique(code * len(ids) + owner, return_counts=True)
        code, owner = np.divmod(at, max(len(ids), 1))
        m = 50 + 50 * length[owner] * n // max(total, 1)
        impact = 1_000_000_000 * tf // (1000 * tf + 20 * m)
        self.slices.append((names, code, owner + self.docs, impact))
        self.ids.append(ids)
        self.docs += len(ids)
        self.size += pc.sum(pc.binary_length(texts)).as_py() or 0

    def row(self) -> pa.RecordBatch:
        """The shard as a row of SHARDS."""
        ids = np.concatenate(self.ids)
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        every = pa.concat_arrays([s[0] for s in self.slices]).dictionary_encode()
        by_name = pc.array_sort_indices(every.dictionary).to_numpy()
        place = np.empty(len(by_name), np.int64)
        place[by_name] = np.arange(len(by_name))
        moved = place[every.indices.to_numpy()]
        before = np.cumsum([0, *(len(s[0]) for s in self.slices)])
        code = np.concatenate([moved[lo : lo + len(s[0])][s[1]] for lo, s in zip(before, self.slices, strict=False)])
        doc, impact = rank[np.concatenate([s[2] for s in self.slices])], np.concatenate([s[3] for s in self.slices])
        sort = np.lexsort((doc, code))
        offsets = np.append(0, np.cumsum(np.bincount(code, minlength=len(by_name))))
        terms = pa.array([every.dictionary.take(pa.array(by_name)).to_pylist()], pa.list_(pa.string()))
        binary = [pa.array([x.tobytes()], pa.binary()) for x in (ids[order].astype("<i8"), offsets.astype("<i8"), doc[sort].astype("<u4"), impact[sort].astype("<u4"))]
        return pa.RecordBatch.from_arrays([binary[0], terms, *binary[1:]], ["ids", "terms", "offsets", "ordinals", "impacts"])


def shards(docs: DataFrame, n: int, total: int, text: str, id_col: str, shard_docs: int, shard_bytes: int) -> DataFrame:
    """The index of the documents, a row for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for b in batches:
            for cut in slices(b, "text", shard_docs, shard_bytes):
                if shard.docs and (shard.docs + cut.num_rows > shard_docs or shard.size >= shard_bytes):
                    yield shard.row()
                    shard = Shard()
                shard.add(pc.fill_null(cut.column(0), MISSING).to_numpy(), cut.column(1), n, total)
        if shard.docs:
            yield shard.row()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(releasing(run), SHARDS)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores above 0, largest first, equal ones by position."""
    there = np.flatnonzero(scores)
    if len(there) > k:
        least = -np.partition(-scores[there], k - 1)[k - 1]
        there = there[scores[there] >= least]  # with all that tie with the k-th
    return there[np.lexsort((there, -scores[there]))][:k]


class Block:
    """Queries, with their different terms as numbers of the block's vocabulary."""

    def __init__(self, rows: pa.Table):
        names = rows.column("terms").combine_chunks()
        flat = names.flatten().cast(pa.string()).dictionary_encode()
        self.vocabulary, codes = flat.dictionary, flat.indices.to_numpy()
        ends = names.offsets.to_numpy() - (names.offsets[0].as_py() if len(names.offsets) else 0)
        self.query = rows.column("query").to_numpy()
        self.terms = [codes[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        self.weight = np.zeros(len(self.vocabulary), np.int64)

    def found(self, b: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a shard's terms those that the block has, as the block's numbers, and where their lists begin and end."""
        own = pc.index_in(b.column("terms")[row].values, value_set=self.vocabulary)
        at = np.flatnonzero(own.is_valid().to_numpy(zero_copy_only=False))
        offsets = np.frombuffer(b.column("offsets")[row].as_buffer(), "<i8")
        return own.take(pa.array(at)).to_numpy(), offsets[at], offsets[at + 1]


def frequencies(index: DataFrame, block: Block) -> DataFrame:
    """term (its number in the block) and df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(block.vocabulary), np.int64)
        for b in batches:
            for row in range(b.num_rows):
                term, begin, end = block.found(b, row)
                df[term] += end - begin
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": at, "df": df[at]})

    return index.select("terms", "offsets").mapInArrow(releasing(run), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def scored(index: DataFrame, block: Block, k: int) -> DataFrame:
    """query, doc_id and score of the k best documents of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                ids = np.frombuffer(b.column("ids")[row].as_buffer(), "<i8")
                ordinals, impacts = (np.frombuffer(b.column(c)[row].as_buffer(), "<u4") for c in ("ordinals", "impacts"))
                lists = {int(t): slice(lo, hi) for t, lo, hi in zip(*block.found(b, row), strict=True)}
                parts = {t: block.weight[t] * impacts[at].astype(np.int64) for t, at in lists.items()}
                scores, query, doc, score = np.empty(len(ids), np.int64), [], [], []
                for q, terms in zip(block.query, block.terms, strict=True):
                    scores[:] = 0
                    for t in terms:
                        if t in lists:
                            scores[ordinals[lists[t]]] += parts[t]  # a document once in a list
                    at = best(scores, k)
                    query.append(np.full(len(at), q))
                    doc.append(ids[at])
                    score.append(scores[at])
                if query:
                    doc = np.concatenate(doc)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(query)), pa.array(doc, mask=doc == MISSING), pa.array(np.concatenate(score))], ["query", "doc_id", "score"])

    return index.mapInArrow(releasing(run), "query long, doc_id long, score long")


def query_terms(text: str):
    """The different terms of a query, as an expression."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1), ""))


@dataclass
class Index:
    """Shards at a path, with N and L."""

    spark: SparkSession
    path: str
    n: int
    total: int

    @classmethod
    def built(cls, spark: SparkSession, docs: DataFrame, path: str | None = None, text: str = "text", id_col: str = "doc_id", shard_docs: int = SHARD_DOCS, shard_bytes: int = SHARD_BYTES) -> Index:
        """Writes the index of all documents."""
        n, total = totals(docs, text)
        path = path or shared_dir(spark)
        rows = shards(docs, n, total, text, id_col, shard_docs, shard_bytes)
        rows.write.option("compression", "zstd").option("maxRecordsPerFile", SHARDS_A_FILE).parquet(path)
        return cls(spark, path, n, total)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(SHARDS).parquet(self.path)

    def ranked(self, queries: DataFrame, k: int = 50, text: str = "text", id_col: str = "item_id") -> DataFrame:
        """item_id, rank, doc_id and score of the k best documents of each query."""
        asked = queries.select(F.col(id_col).alias("item_id"), query_terms(text).alias("terms")).where(F.size("terms") > 0)
        asked = stored(asked.withColumn("query", F.monotonically_increasing_id()), self.spark)
        blocks = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK))
        found = None
        for number in range(blocks):
            block = Block(asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == number).select("query", "terms").toArrow())
            for r in frequencies(self.rows(), block).collect():  # a row for each term of the block at most
                block.weight[r["term"]] = math.floor(1000 * math.log((2 * self.n + 2) / (2 * r["df"] + 1)))
            own = scored(self.rows(), block, k)
            found = own if found is None else found.unionByName(own)
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
        for by in (["query", "part"], ["query"]):
            found = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
        return found.join(asked.select("query", "item_id"), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
