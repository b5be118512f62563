import zlib

import numpy as np
from tokenizers import Tokenizer

from tallyloom.llm import packing
from tallyloom.llm.tokens import vocabulary

PLAIN = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))


def whole(text):
    return np.array([*PLAIN.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_every_id_lies_in_one_piece(spark, docs, rows, none):
    got = packing.packed(spark, docs).collect()
    per, texts = {}, {}
    for r in rows:
        texts.setdefault(r[0], []).append(whole(r[1]))
    for p in got:
        per.setdefault(p["doc_id"], []).append(p)
    for doc_id, ids in texts.items():
        want = sorted(len(x) for x in ids)
        assert sum(p["length"] for p in per[doc_id]) == sum(want)
        for p in per[doc_id]:
            cuts = [x[p["start"] : p["start"] + p["length"]] for x in ids if len(x) == p["doc_tokens"]]
            assert any(len(c) == p["length"] and zlib.crc32(c.tobytes()) == p["ids_crc32"] for c in cuts)
    sequences = {}
    for p in got:
        sequences.setdefault(p["sequence_id"], []).append(p)
    short = 0
    for ps in sequences.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= 1024
        short += at < 1024
    assert short <= 4  # one a task
    assert packing.packed(spark, none).count() == 0


def test_neighbours_come_by_their_score():
    rng = np.random.default_rng(1)
    tails = [rng.integers(0, 50, 40).astype("<u2") for _ in range(30)]
    ids, n = np.unique(np.concatenate([np.unique(t) for t in tails]), return_counts=True)
    w = packing.Weights(ids, n.astype(float), len(tails), 40.0)
    shard = packing.Shard(tails, w)
    shard.unused[[3, 7]] = False
    query = np.unique(tails[3])
    score = {k: sum(float(x) for u, x in zip(*w.of(t), strict=True) if u in query) for k, t in enumerate(tails) if shard.unused[k]}
    got = list(shard.neighbours(query.astype(np.int64)))
    assert sorted(got) == sorted(score) and all(score[a] >= score[b] - 1e-4 for a, b in zip(got, got[1:], strict=False))


def test_a_window_takes_the_likest_first():
    a, b = np.arange(100, dtype="<u2"), np.arange(500, 600, dtype="<u2")
    rows = [(0, 0, 100, a), (1, 0, 100, b), (2, 0, 100, a[::-1].copy()), (3, 0, 100, b[::-1].copy())]
    ids, n = np.unique(np.concatenate([a, b]), return_counts=True)
    w = packing.Weights(ids, np.full(len(ids), 2.0), 4, 100.0)
    out = [p for part in packing.pack_range(iter(rows), w, 200, 0) for p in part]
    together = {}
    for doc_id, *_, sequence, _ in out:
        together.setdefault(sequence, set()).add(doc_id)
    assert sorted(map(sorted, together.values())) == [[0, 2], [1, 3]]


def test_weights_come_for_many_tails_at_once(monkeypatch):
    """The same as tail by tail, ties and single ids included; no tail of a shard or a range's key is weighed alone."""
    rng = np.random.default_rng(2)
    tails = [rng.integers(0, 60, rng.integers(1, 40)).astype("<u2") for _ in range(300)] + [np.array([5], "<u2"), np.array([7, 7], "<u2"), np.array([1, 2], "<u2")]
    ids, n = np.unique(np.concatenate([np.unique(t) for t in tails]), return_counts=True)
    n[1:3] = n[1]
    w = packing.Weights(ids, n.astype(float), len(tails), 20.0)
    want = [w.of(t) for t in tails]
    top = [u[np.lexsort((u, -x))[:2]] for u, x in want]
    monkeypatch.setattr(packing.Weights, "of", None)
    u, x, at = w.of_all(tails)
    assert all(np.array_equal(u[a:b], k) and np.array_equal(x[a:b], y) for (k, y), a, b in zip(want, at, at[1:], strict=False))
    first, second = w.heaviest(tails)
    assert first.tolist() == [t[0] for t in top] and second.tolist() == [t[-1] for t in top]
    rows = [(k, 0, len(t), t) for k, t in enumerate(tails)]
    assert sum(p[2] for part in packing.pack_range(iter(rows), w, 64, 0) for p in part) == sum(map(len, tails))
