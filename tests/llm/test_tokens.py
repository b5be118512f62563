import gc
import io
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tokenizers import Tokenizer

from tallyloom.llm import token_files
from tallyloom.llm.columns import lowered, parted, slices
from tallyloom.llm.tokens import Encoder, vocabulary

ODD = ["<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|>x", *"ab'stve 1 \n\t\r   é́\x1c\x0b !.#<|>ÀßİΣ漢​\x85\x01 ", "<|endoftext|>", "</w>", "'s", "\n\n", "a,", "É,", "É.", "≠", " \n", "x\n"]


def texts(n):
    r = random.Random(5)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("name,leading", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_are_those_of_the_whole_text(name, leading):
    e = Encoder(name, leading)
    t = texts(20_000)
    ids, sizes = e.batch(pa.array([None, *t]).slice(1))
    want = [np.array(x.ids, e.dtype) for x in Tokenizer.from_file(vocabulary(name)).encode_batch(t, add_special_tokens=False)]
    assert sizes.tolist() == [len(x) for x in want] and np.array_equal(ids, np.concatenate(want))


def test_kept_ids_may_go(monkeypatch):
    monkeypatch.setattr("tallyloom.llm.tokens.MOST_KEPT", 50)
    e = Encoder("word_bpe_49k.json", False)
    for k in range(20):
        t = [f"word{k} again w{i}" for i in range(k, k + 30)]
        ids, _ = e.batch(pa.array(t))
        assert np.array_equal(ids, np.concatenate([np.array(x.ids) for x in e.tokenizer.encode_batch_fast(t, add_special_tokens=False)]))
    assert len(e.young) + len(e.old) < 400


@pytest.mark.parametrize("name,leading", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_kept_ids_are_small(name, leading):
    """What a worker keeps of 80,000 different words is no Python object for each, and is found again."""
    e = Encoder(name, leading)
    t = [" ".join(["", *(f"w{k * 1000 + i:x}q" for i in range(1000))]) for k in range(80)]
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    try:
        for k in range(0, 80, 10):
            e.batch(pa.array(t[k : k + 10]))
        gc.collect()
        objects = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert len(e.young) + len(e.old) >= 80_000
    assert objects + pa.total_allocated_bytes() - before < 80 * len(e.young) + 80 * len(e.old)
    e.tokenizer = None  # nothing is encoded anew
    ids, sizes = e.batch(pa.array(t[:1]))
    want = Tokenizer.from_file(vocabulary(name)).encode(t[0], add_special_tokens=False).ids
    assert ids.tolist() == want and sizes.tolist() == [len(want)]


@pytest.mark.parametrize("name,leading,token", [("byte_bpe_50k.json", True, "<|endoftext|>"), ("word_bpe_49k.json", False, "<|endoftext|>"), ("word_bpe_49k.json", False, "<|startoftext|>")])
def test_added_tokens_are_one_id(name, leading, token):
    plain = Tokenizer.from_file(vocabulary(name))
    t = [token, f"a {token} b", f"a{token}b", f"{token}{token}", f"x.\n{token}\ny", token.upper(), token[:-1], f" {token} ", "none"]
    ids, sizes = Encoder(name, leading).batch(pa.array(t))
    want = [plain.encode(x, add_special_tokens=False).ids for x in t]
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want
    assert want[0] == [plain.token_to_id(token)] and want[0][0] in want[2]


def test_slices_hold_all_rows_and_few_bytes():
    b = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (5, 50, 0, 3, 3, 200)] + [None, "x"], "k": list(range(8))})
    got = list(slices(b, "text", 3, 20))
    assert [x for s in got for x in s.column("k").to_pylist()] == list(range(8))
    assert all(s.num_rows <= 3 and (s.num_rows == 1 or sum(len(x or "") for x in s.column("text").to_pylist()) <= 20) for s in got)
    assert list(slices(b.slice(0, 0), "text", 3)) == []


def test_words_of_slices():
    t = [" É A b", None, "", "\x1cX\x0bY ", "Zz É"] * 3
    for lo in range(5):
        part = pa.array(t).slice(lo, 7)
        low = lowered(part)
        want = [(x or "").encode().lower() for x in part.to_pylist()]
        assert [x.encode() for x in low.to_pylist()] == want
        names, code, n = parted(low)
        assert [names[int(k)].as_py().encode() for k in code] == [w for x in want for w in x.split()]
        assert n.tolist() == [len(x.split()) for x in want]


def test_round_trip(spark, docs, rows, none):
    got = token_files.round_trip(spark, docs).collect()
    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    ids = sorted(((r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""), [*t.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in rows)
    start, want = 0, []
    for key, x in ids:
        want.append((key[1] if key[0] else None, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert token_files.round_trip(spark, none).count() == 0


def test_reader_decompresses_only_what_is_asked_for():
    out = io.BytesIO()
    w = token_files.FrameWriter(out, np.dtype("<u2"), frame=1000)
    data = {k: np.arange(k, k + 100 + k, dtype="<u2") for k in range(0, 60, 2)}
    for k, x in data.items():
        w.add(k, x.tobytes())
    w.close()
    r = token_files.FrameReader(io.BytesIO(out.getvalue()))
    assert len(r.seek) > 5
    assert np.array_equal(r.find(30)[0], data[30]) and r.decoded == 1
    assert r.find(31) == [] and r.decoded == 1
    raw = bytearray(out.getvalue())
    raw[int(r.at[1]) + 12] ^= 0xFF
    broken = token_files.FrameReader(io.BytesIO(bytes(raw)))
    assert np.array_equal(broken.find(0)[0], data[0])
    with pytest.raises(Exception):  # noqa: B017  zstandard's own error or ours
        broken.frame(1)


def test_wanted_documents(spark, docs):
    from tallyloom.llm.shared import shared_dir

    m = token_files.written(spark, docs, shared_dir(spark), "word_bpe_49k.json", 1)
    every = {tuple(r) for r in token_files.read(m).where("doc_id in (9, 21)").collect()}
    assert {tuple(r) for r in token_files.read(m, [9, 21]).collect()} == every and every


def test_rows_without_an_id_are_many_files(spark, tmp_path):
    """Four of five documents have no id, half of these one text: no file has more than a few times the median, and each is read by a task of its own."""
    from pyspark.sql import functions as F

    docs = spark.range(2000).select(F.when(F.col("id") % 5 == 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("same text")).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text")).repartition(3)
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in zip(names, ("8", "false"), strict=True):
            spark.conf.set(n, v)
        manifest = token_files.written(spark, docs, f"file://{tmp_path}/t", "word_bpe_49k.json", 1)
        sizes = sorted(r["documents"] for r in manifest.collect())
        out = token_files.read(manifest)
        tasks = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
        rows = out.orderBy("start").collect()
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert len(sizes) == 8 and sizes[-1] < 3 * sizes[4] and sorted(tasks) == sizes
    assert len(rows) == 2000 and [r["start"] for r in rows[1:]] == [r["start"] + r["n_tokens"] for r in rows[:-1]]
    ids = [r["doc_id"] for r in rows]
    assert ids[:1600] == [None] * 1600 and ids[1600:] == sorted(ids[1600:])
