"""The class language model and the quality classifier."""

import math
import random
import struct
import zlib
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tallyloom.llm import class_lm, nb_svm


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def test_sums_of_each_document(spark, docs, rows, none):
    got = class_lm.scored(spark, docs, top=50, classes=8).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for r in rows if not held(r[0]) for w in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    want = []
    for r in rows:
        t = tokens(r[1])
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        want.append((str(r[0]), held(r[0]), len(t), sum(c[w] > 0 for w in t), n, round(base, 4)))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == sorted(want)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert class_lm.scored(spark, none).count() == 0
    only = spark.createDataFrame([(next(i for i in range(100) if held(i)), "nothing to learn from")], "doc_id long, text string")
    assert math.isfinite(class_lm.scored(spark, only).first()["score"])


def test_exchange_finds_alternating_classes():
    r = np.random.default_rng(1)
    kind = np.arange(20) % 4  # class k comes before class k + 1
    seq, k = [], 0
    for _ in range(6000):
        seq.append(r.choice(np.flatnonzero(kind == k)))
        k = (k + 1) % 4
    order = np.argsort(-np.bincount(seq, minlength=20), kind="stable")
    rank = np.empty(20, int)
    rank[order] = np.arange(20)
    s = rank[np.array(seq)]
    pair, n = np.unique(np.stack([s[:-1], s[1:]], 1), axis=0, return_counts=True)
    of = class_lm.exchange(pair[:, 0], pair[:, 1], n.astype(float), 20, 21, 4, 20)
    assert all(len({of[rank[w]] for w in np.flatnonzero(kind == k)}) == 1 for k in range(4))
    assert len(set(of[:20])) == 4


def test_model_is_a_distribution():
    counts = class_lm.Counts(tokens=100, types=8, once=2, twice=1, words=np.array([11, 12, 13]))
    end, once = counts.end_unit, counts.once_unit
    seq = [0, 1, 2, 0, 1, once, end, 0, 2, once + 1, once + 1, end, 1, once, 0, end]
    s = np.array([end, *seq])
    pair, n = np.unique(np.stack([s[:-1], s[1:]], 1), axis=0, return_counts=True)
    m = class_lm.Model.fitted(counts, pair[:, 0], pair[:, 1], n.astype(float), 2, 5)
    size = Counter(seq)
    for before in set(m.of[seq]):
        total = 0.0
        for u in (0, 1, 2, once + 1, end):  # known words weigh their count, here all of the unit's words
            total += 10 ** (m.transition[before, m.of[u]] + m.emission[u]) * size[u]
        total += 10 ** m.transition[before, m.of[once]] * (2 * 10 ** m.emission[once] + 10 ** m.emission[counts.unknown_unit])
        assert total == pytest.approx(1.0)


def test_words_beyond_the_top_ones_get_classes(spark):
    r = random.Random(2)
    names, verbs = [f"name{i}" for i in range(40)], [f"verb{i}" for i in range(40)]
    rows = [(i, " ".join(f"{r.choice(names)} {r.choice(verbs)}" for _ in range(40))) for i in range(200)]
    got = class_lm.scored(spark, spark.createDataFrame(rows, "doc_id long, text string"), top=8, classes=2).where("held_out").toPandas()
    assert len(got) > 20 and got["score"].sum() > got["base_score"].sum() + 0.2 * got["n_tokens"].sum()


def test_model_beats_the_base_on_held_out_texts(spark):
    r = random.Random(1)
    names, verbs = [f"name{i}" for i in range(30)], [f"verb{i}" for i in range(30)]
    rows = [(i, " ".join(f"{r.choice(names)} {r.choice(verbs)}" for _ in range(40))) for i in range(200)]
    got = class_lm.scored(spark, spark.createDataFrame(rows, "doc_id long, text string"), top=100, classes=4).where("held_out").toPandas()
    assert len(got) > 20 and got["score"].sum() > got["base_score"].sum() + 0.2 * got["n_tokens"].sum()


def information(pairs, of):
    """Mutual information of neighbouring classes, from all pairs anew."""
    both, left, right = Counter(), Counter(), Counter()
    for (a, b), n in pairs.items():
        both[of(a), of(b)] += n
        left[of(a)] += n
        right[of(b)] += n
    f = lambda c: sum(n * math.log(n) for n in c.values())
    return f(both) - f(left) - f(right)


def class_scores(rows, top, classes):
    """The whole class model in loops: classes by exchange, transitions, emissions; the scores of all texts."""
    texts = {i: [*t.lower().split(), None] for i, t in rows}  # None: the end
    train = [ts for i, ts in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    count = Counter(w for ts in train for w in ts)
    signed = lambda w: (h := xxhash.xxh64_intdigest(w)) - (1 << 64 if h >> 63 else 0)
    first = sorted((w for w in count if w), key=lambda w: (-count[w], signed(w)))[:top]
    cls = {w: k % classes for k, w in enumerate(first)}

    def of(w):
        return cls[w] if w in cls else "end" if w is None else f"band {int(math.log2(count[w]))}" if count[w] else "band 0"

    pairs = Counter(x for ts in train for x in zip([None, *ts], ts))
    # the information's last term is the number of pairs, which no move changes
    whole = len(list(x for ts in train for x in ts))
    rest, now = whole * math.log(whole), information(pairs, of)
    for _ in range(class_lm.SWEEPS):
        before = now
        for w in first:
            was, each = cls[w], []
            for c in range(classes):
                cls[w] = c
                each.append(information(pairs, of))
            best = max(range(classes), key=lambda c: (each[c], -c))
            cls[w] = best if each[best] > each[was] + 1e-9 else was
        now = information(pairs, of)
        if now - before < class_lm.STILL * abs(now + rest):
            break
    size, out, both = Counter(), Counter(), Counter()
    for (a, b), n in pairs.items():
        size[of(b)] += n
        out[of(a)] += n
        both[of(a), of(b)] += n
    there = {*size, "band 0", "end"}
    share = {c: (size[c] + 0.5) / (whole + 0.5 * len(there)) for c in there}
    once, twice = (sum(n == k for w, n in count.items() if w) for k in (1, 2))
    novel = (once + 0.5) / (once + 2 * twice + 1)

    def word(w):
        return novel if not count[w] else (1 - novel) / once if of(w) == "band 0" else count[w] / size[of(w)]

    chance = lambda a, b: (both[of(a), of(b)] + class_lm.PRIOR * share[of(b)]) / (out[of(a)] + class_lm.PRIOR) * word(b)
    return {i: sum(math.log10(chance(a, b)) for a, b in zip([None, *ts], ts)) for i, ts in texts.items()}


def test_scores_of_the_class_model_are_those_of_a_plain_one(spark):
    """Top words, bands of counts, words seen once, unknown words, the end; held-out texts too."""
    r = random.Random(11)
    groups = [[f"{g}{k}" for k in range(4)] for g in ("name", "verb", "thing")]
    rare = [f"rare{k}" for k in range(60)]
    rows = []
    for i in range(90):
        text = " ".join(" ".join(r.choice(g) if r.random() < 0.95 else r.choice(rare) for g in groups) for _ in range(r.randint(0, 12)))
        rows.append((i, text if i % 9 else text.upper() + f" new{i}"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x["score"] for x in class_lm.scored(spark, df, top=12, classes=3, enough=10**9).collect()}
    assert got == pytest.approx(class_scores(rows, 12, 3), rel=1e-9)


def labelled(n):
    r = random.Random(7)
    good = [f"word{i}" for i in range(300)]
    out = []
    for i in range(n):
        ws = [r.choice(good) for _ in range(r.randint(5, 60))]
        if i % 4 == 0:
            ws = r.choice([[w.upper() + "!!" for w in ws], [w + r.choice(["***", "###"]) for w in ws], [ws[0]] * len(ws)])
        out.append((i, " ".join(ws), int(i % 4 != 0)))
    return out


def test_held_out_accuracy(spark):
    rows = labelled(600)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(rows[0][0], None)], "doc_id long, quality int")
    model = nb_svm.trained(docs, labels)
    got = {r["doc_id"]: r for r in nb_svm.scored(spark, docs, model).collect()}
    assert len(got) == 600
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(got[r[0]]["held_out"] == (r in held) for r in rows)
    assert sum(got[r[0]]["predicted"] == r[2] for r in held) / len(held) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got.values())
    # the labels of held-out rows don't matter
    turned = spark.createDataFrame([(r[0], 1 - r[2] if r in held else r[2]) for r in rows], "doc_id long, quality int")
    assert np.allclose(nb_svm.trained(docs, turned).weight, model.weight)


def plain_features(text):
    """The distinct n-grams of a text of ASCII without "_" as they are, unhashed."""
    kind = lambda c: "A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else c
    ws = text.split()
    shapes = ["=" if i and w == ws[i - 1] else "".join(k for k, _ in groupby(w, kind)) for i, w in enumerate(ws)]
    out = set()
    for name, stream in (("word", [w.lower() for w in ws]), ("shape", shapes)):
        out |= {(name, x) for x in stream} | {(name, *x) for x in zip(stream, stream[1:], strict=False)}
    return sorted(out)


def plain_scores(docs, labels, bits, c=1.0, epochs=8):
    """The score of each text, by dictionaries and loops."""
    order = sorted((i for i in labels if zlib.crc32(str(i).encode()) % 5), key=lambda i: int.from_bytes(xxhash.xxh64_digest(struct.pack("<q", i), 42), "big", signed=True))
    fit = [i for k, i in enumerate(order) if k % 5 != 4]
    aside = [i for k, i in enumerate(order) if k % 5 == 4]
    feats = {i: plain_features(t) for i, t in docs}
    n = {y: Counter(f for i in fit if labels[i] == y for f in feats[i]) for y in (0, 1)}
    total = {y: sum(n[y].values()) + (1 << bits) for y in (0, 1)}
    ratio = lambda f: math.log((n[1][f] + 1) / total[1]) - math.log((n[0][f] + 1) / total[0])

    def vector(i):
        x = {f: ratio(f) for f in feats[i]}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {f: v / max(norm, 1e-9) for f, v in x.items()}

    xs, w, bias, alpha = [vector(i) for i in fit], Counter(), 0.0, [0.0] * len(fit)
    rng = np.random.default_rng(1)
    for _ in range(epochs):
        for k in rng.permutation(len(fit)):
            x, y = xs[k], 2 * labels[fit[k]] - 1
            gradient = y * (sum(w[f] * v for f, v in x.items()) + bias) - 1
            new = min(max(alpha[k] - gradient / (sum(v * v for v in x.values()) + 1), 0.0), c)
            step, alpha[k] = (new - alpha[k]) * y, new
            for f, v in x.items():
                w[f] += step * v
            bias += step
    margin = {i: sum(w[f] * v for f, v in vector(i).items()) + bias for i, _ in docs}
    n1 = sum(labels[i] for i in aside)
    goal = {i: (n1 + 1) / (n1 + 2) if labels[i] else 1 / (len(aside) - n1 + 2) for i in aside}
    slope, level = 1.0, 0.0
    for _ in range(50):  # Newton's method on the log loss with a small ridge
        p = {i: 1 / (1 + math.exp(-slope * margin[i] - level)) for i in aside}
        g1 = sum((goal[i] - p[i]) * margin[i] for i in aside) - 1e-3 * slope
        g0 = sum(goal[i] - p[i] for i in aside) - 1e-3 * level
        v = {i: p[i] * (1 - p[i]) for i in aside}
        h11, h10, h00 = sum(v[i] * margin[i] ** 2 for i in aside) + 1e-3, sum(v[i] * margin[i] for i in aside), sum(v.values()) + 1e-3
        det = h11 * h00 - h10 * h10
        slope, level = slope + (h00 * g1 - h10 * g0) / det, level + (h11 * g0 - h10 * g1) / det
    return {i: 1 / (1 + math.exp(-slope * m - level)) for i, m in margin.items()}


def test_scores_are_those_of_a_plain_model(spark):
    r = random.Random(5)
    words = [f"w{chr(97 + i)}" for i in range(12)] + ["Big", "X1", "no!!"]
    docs = [(i, " ".join(r.choice(words[: 8 + i % 8]) for _ in range(r.randint(0, 12)))) for i in range(120)]
    labels = {i: int("Big" not in t and r.random() < 0.9) for i, t in docs if i < 100}
    bits = 22
    hashed = {int(x) for _, t in docs for x in nb_svm.features(pa.array([t], pa.string()), nb_svm.Hashes(), bits)[0]}
    assert len(hashed) == len({f for _, t in docs for f in plain_features(t)})  # no two share a hash
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    model = nb_svm.trained(frame, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"), bits=bits)
    want = plain_scores(docs, labels, bits)
    assert 0 < sum(labels.values()) < len(labels) and max(want.values()) - min(want.values()) > 0.3
    got = {x["doc_id"]: x["score"] for x in nb_svm.scored(spark, frame, model).collect()}
    assert got == pytest.approx(want, abs=1e-4)


def test_classifier_edge_cases(spark, docs, rows, none):
    labels = spark.createDataFrame([(r[0], 1) for r in rows], "doc_id long, quality int")
    one = nb_svm.trained(docs, labels)
    got = nb_svm.scored(spark, docs, one).collect()
    assert len(got) == len(rows) and len({r["score"] for r in got}) == 1
    nothing = nb_svm.trained(docs, labels.where("false"))
    assert {r["score"] for r in nb_svm.scored(spark, docs, nothing).collect()} == {0.5}
    assert nb_svm.scored(spark, none, one).count() == 0


def test_features_of_a_batch_are_those_of_its_texts():
    texts = ["a b a", None, "  ", "X x X!! X!!", "a b a"]
    idx, sizes = nb_svm.features(pa.array(texts), nb_svm.Hashes())
    each = np.split(idx, np.cumsum(sizes)[:-1])
    for t, f in zip(texts, each, strict=True):
        alone, n = nb_svm.features(pa.array([t], pa.string()), nb_svm.Hashes())
        assert n[0] == len(f) and sorted(alone) == sorted(f)
    assert sizes[1] == sizes[2] == 0


def test_dual_descent_separates():
    idx = np.array([0, 1, 0, 2, 3, 1, 3, 2], np.int32)
    w, b = nb_svm.dual_descent(idx, np.ones(8), np.array([2, 4, 6, 8]), np.array([1.0, 1.0, -1.0, -1.0]), 3, 10.0, 200)
    assert w[0] > 0 > w[3]
    for at, y in (([0, 1], 1), ([0, 2], 1), ([3, 1], -1), ([3, 2], -1)):
        assert y * (w[at].sum() + b) >= 1 - 1e-3
