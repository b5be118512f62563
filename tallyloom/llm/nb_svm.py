"""Naive Bayes support vectors for text quality.

A text's features are indicators of hashed n-grams, n = 1 and 2, over two streams: its words, and
its words' shapes (runs of capitals, small letters, digits and each sign; "=" for a word that
repeats the one before). For each feature the classes' log-count ratio is its scale; scaled
vectors have length 1. A linear hinge-loss model is fitted to them by dual coordinate descent, and
its margin is turned into a probability on labelled rows that were kept aside.

The fit uses at most `sample` labelled training rows, those with the smallest hashes of doc_id.
That bounds the broadcast of their ids, the memory of the one task that fits, and the model's two
arrays of `1 << bits` numbers, which go to all tasks. Scoring then is a projection of every text.

Neither labels nor ids, languages or sources are inputs of a score. A doc_id with several labels
has their majority, a tie counts as 1; a null label is none. Null and empty texts are scored by the
bias alone. Rows that repeat a doc_id are scored each; a null doc_id is scored and never trained
on. Without rows of both classes every score is the share of class 1 (0.5 without any). An empty
table gives no rows. Other columns are ignored. A text is scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import parted, slices

BITS, SAMPLE, EPOCHS, C = 18, 20_000, 8, 1.0
TEXTS_AT_ONCE = 1024
_RUNS = [(re.compile(p), s) for p, s in ((r"[^\W\d_a-zß-öø-ÿ]+", "A"), (r"[^\W\dA]+", "a"), (r"\d+", "0"), (r"([^\w])\1+", r"\1"))]


def shape(word: str) -> str:
    for pattern, by in _RUNS:
        word = pattern.sub(by, word)
    return word


class Hashes:
    """Hashes of words and shapes that this task has met."""

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.known) > 500_000:
            self.known = {}
        for w in words:
            if w not in self.known:
                self.known[w] = xxhash.xxh64_intdigest(w.lower()), xxhash.xxh64_intdigest(shape(w), 1)
        return np.array([self.known[w] for w in words], np.uint64).reshape(-1, 2)


def features(texts: pa.Array, hashes: Hashes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of all texts one after another, and how many each text has."""
    names, code, sizes = parted(pc.fill_null(texts.cast(pa.large_string()), ""))
    table = hashes.of(names.to_pylist())
    owner = np.repeat(np.arange(len(texts)), sizes)
    same = (owner[1:] == owner[:-1]) if len(code) else np.empty(0, bool)
    w, s = table[code, 0], table[code, 1].copy()
    s[1:][same & (code[1:] == code[:-1])] = xxhash.xxh64_intdigest("=", 2)
    prime = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        two = [(x[:-1] * prime + np.uint64(k)) ^ (x[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) for k, x in enumerate((w, s))]
        mix = lambda x: ((x ^ (x >> np.uint64(29))) * prime) >> np.uint64(64 - bits)
        grams = [mix(w), mix(s), *(mix(x[same]) for x in two)]
    owners = [owner, owner, owner[1:][same], owner[1:][same]] if len(code) else [owner] * 4
    keys = np.unique(np.concatenate([o.astype(np.int64) << bits | g.astype(np.int64) for o, g in zip(owners, grams, strict=True)]))
    return (keys & ((1 << bits) - 1)).astype(np.int32), np.bincount(keys >> bits, minlength=len(texts))


@dataclass
class Model:
    """weight and scale of each feature, the bias, and the line that turns margins into log odds."""

    weight: np.ndarray
    scale: np.ndarray
    bias: float
    slope: float
    level: float

    def margins(self, idx: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        owner = np.repeat(np.arange(len(sizes)), sizes)
        dot = np.bincount(owner, self.weight[idx] * self.scale[idx], len(sizes))
        norm = np.sqrt(np.bincount(owner, self.scale[idx] ** 2, len(sizes)))
        return dot / np.maximum(norm, 1e-9) + self.bias

    def scores(self, idx: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(idx, sizes) + self.level, -50, 50)))


def log_count_ratios(idx: np.ndarray, sizes: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    own = np.repeat(y > 0, sizes)
    p, q = (1 + np.bincount(idx[own == k], minlength=1 << bits) for k in (True, False))
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(idx: np.ndarray, val: np.ndarray, ends: np.ndarray, y: np.ndarray, bits: int, c: float, epochs: int, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model; y is -1 or 1. Rows are visited in a new order each epoch."""
    w, bias, alpha = np.zeros(1 << bits), 0.0, np.zeros(len(y))
    begins = np.concatenate([[0], ends[:-1]])
    square = np.array([val[a:b] @ val[a:b] + 1 for a, b in zip(begins, ends, strict=True)])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            at, x = idx[begins[i] : ends[i]], val[begins[i] : ends[i]]
            gradient = y[i] * (w[at] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), c)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * x
                bias += step
                alpha[i] = new
    return w, bias


def calibrated(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and level of the log odds of y = 1, by Newton's method on smoothed targets."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, beta = np.stack([margin, np.ones(len(margin))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -50, 50)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (t - p) - 1e-3 * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fitted(idx: np.ndarray, sizes: np.ndarray, label: np.ndarray, bits: int = BITS, c: float = C, epochs: int = EPOCHS) -> Model:
    """Fits to four of five rows and calibrates on each fifth."""
    y = np.where(label > 0, 1.0, -1.0)
    aside = np.arange(len(y)) % 5 == 4
    if len(set(y[~aside])) < 2:
        share = (np.clip((y > 0).mean(), 0.01, 0.99)) if len(y) else 0.5
        return Model(np.zeros(1 << bits), np.zeros(1 << bits), 0.0, 1.0, float(np.log(share / (1 - share))))
    own = np.repeat(~aside, sizes)
    at, n = idx[own], sizes[~aside]
    scale = log_count_ratios(at, n, y[~aside], bits)
    owner = np.repeat(np.arange(len(n)), n)
    norm = np.maximum(np.sqrt(np.bincount(owner, scale[at] ** 2, len(n))), 1e-9)
    w, bias = dual_descent(at, scale[at] / norm[owner], np.cumsum(n), y[~aside], bits, c, epochs)
    model = Model(w, scale, bias, 1.0, 0.0)
    rest = ~aside if len(set(y[aside])) < 2 else aside
    keep = np.repeat(rest, sizes)
    model.slope, model.level = calibrated(model.margins(idx[keep], sizes[rest]), y[rest])
    return model


def training_labels(labels: DataFrame, label: str, id_col: str, sample: int) -> DataFrame:
    """doc_id and y of at most `sample` labelled rows whose crc32(doc_id) mod 5 is not 0."""
    one = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    return one.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def trained(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", id_col: str = "doc_id", sample: int = SAMPLE, bits: int = BITS) -> Model:
    """The model; the features of the sampled rows come from all tasks, one task fits."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            for cut in slices(b, "text", TEXTS_AT_ONCE):
                idx, sizes = features(cut.column("text"), hashes, bits)
                yield pa.RecordBatch.from_arrays([cut.column("doc_id"), cut.column("y"), pa.array([x.tobytes() for x in np.split(idx, np.cumsum(sizes)[:-1])], pa.binary())], ["doc_id", "y", "idx"])

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by([("at", "ascending"), ("idx", "ascending")])
        rows = [np.frombuffer(x, np.int32) for x in t.column("idx").to_pylist()]
        m = fitted(np.concatenate(rows), np.array([len(r) for r in rows]), t.column("y").to_numpy(), bits)
        return pa.table({"weight": [m.weight.astype("<f4").tobytes()], "scale": [m.scale.astype("<f4").tobytes()], "bias": [m.bias], "slope": [m.slope], "level": [m.level]})

    wanted = F.broadcast(training_labels(labels, label, id_col, sample))  # `sample` rows at most
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).join(wanted, "doc_id")
    found = rows.mapInArrow(extract, "doc_id long, y int, idx binary").withColumn("at", F.xxhash64("doc_id"))
    got = found.groupBy(F.lit(1).alias("all")).applyInArrow(fit, "weight binary, scale binary, bias double, slope double, level double").first()
    if got is None:
        return fitted(np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0), bits)
    return Model(np.frombuffer(got["weight"], "<f4"), np.frombuffer(got["scale"], "<f4"), got["bias"], got["slope"], got["level"])


def scored(spark: SparkSession, docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    sent = spark.sparkContext.broadcast(model)
    bits = len(model.weight).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            for cut in slices(b, "text", TEXTS_AT_ONCE):
                score = sent.value.scores(*features(cut.column("text"), hashes, bits))
                yield pa.RecordBatch.from_arrays([cut.column("doc_id"), cut.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
