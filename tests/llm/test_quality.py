"""Quality scores: the fit against direct formulas, and accuracy on held-out labels."""

import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from seqloom.llm import quality as op

SF = "/root/testdata/sf0.01"


def auc(score, label):
    """The share of pairs (1, 0) in the right order; ties count half."""
    ones, zeros = (np.array([s for s, y in zip(score, label, strict=True) if y == k]) for k in (1, 0))
    return ((ones[:, None] > zeros).mean() + 0.5 * (ones[:, None] == zeros).mean()) if len(ones) and len(zeros) else 0.5


def test_pooling_is_the_isotonic_fit():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(1, 12))
        y, w = rng.random(n), rng.integers(1, 5, n).astype(float)
        mean = lambda a, b: np.average(y[a : b + 1], weights=w[a : b + 1])  # noqa: B023, E731
        want = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        assert np.allclose(op.pool_adjacent(y, w), want)


def test_partition_sums_give_the_direct_ridge_fit(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, op.N_STATS)).astype(np.float32)
    y = (x[:, 0] + x[:, 1] > 0).astype(float)
    rows = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)], "x array<float>, y double").repartition(7)
    model = op.fit(rows)
    z, x = None, x.astype(np.float64)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, x.std(0))
    z = model.map(x)
    penalty = op.RIDGE * np.eye(z.shape[1])
    penalty[0, 0] = 0
    assert np.allclose(model.beta, np.linalg.solve(z.T @ z + penalty, z.T @ y), atol=1e-6)
    assert (np.diff(model.levels) >= 0).all() and auc(model.score(x), y) > 0.9


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(op.SEED)
    w, b = rng.normal(size=(op.N_STATS, 4096)) / op.BANDWIDTH, rng.uniform(0, 2 * np.pi, 4096)
    model = op.Model(np.zeros(op.N_STATS), np.ones(op.N_STATS), w, b, np.zeros(4097), np.zeros(1), np.zeros(1))
    x = rng.normal(size=(20, op.N_STATS))
    z = model.map(x)[:, 1:]
    want = np.exp(-((x[:, None] - x) ** 2).sum(-1) / (2 * op.BANDWIDTH**2))
    assert np.abs(z @ z.T - want).max() < 0.1


def corpus():
    rng = random.Random(4)
    good = lambda: ". ".join(" ".join(rng.choice(["time", "people", "water", "house", "between", "never", "long"]) for _ in range(9)).capitalize() for _ in range(8)) + "."
    bad = lambda: " ".join(rng.choice(["$$$", "BUY", "!!!", "x9x", "###", "CLICK", "1234"]) for _ in range(60))
    rows = [(i, good() if i % 2 else bad()) for i in range(400)]
    return rows, [(i, i % 2) for i in range(400)]


def test_scores(spark):
    rows, labels = corpus()
    rows += [(900, None), (901, ""), (902, "long " * 100_000), (903, "same"), (903, "same"), (None, "no id")]
    labels += [(1, None), (None, 1), (5000, 1), (1, 1)]
    docs = spark.createDataFrame([(d, t, "src", 1.0) for d, t in rows], "doc_id long, text string, source string, score double")
    got = op.score_quality(docs, spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, text string")).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= op.THRESHOLD) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert len(held) > 40 and auc([r.score for r in held], [r.doc_id % 2 for r in held]) > 0.99


def plain_statistics(text):
    """Each number by its definition, byte by byte and word by word."""
    data = text.encode()
    if not data:
        return [0.0] * op.N_STATS
    kinds = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", ".,;:?", "!", "|", "#$%&*+=<>/\\@^_~{}[]", "\n", "\"'()-"]
    out = [sum(chr(b) in k for b in data if b < 128) / len(data) for k in kinds] + [sum(b >= 128 for b in data) / len(data), sum(b < 33 for b in data) / len(data)]
    counts, lines, words = Counter(data), text.split("\n"), data.split()
    out += [math.log1p(len(data)), -sum(c / len(data) * math.log2(c / len(data)) for c in counts.values()), math.log1p(len(lines)), len(set(lines)) / len(lines), math.log1p(len(data) / len(lines))]
    if not words:
        return out + [0.0] * 8
    lengths, n = [len(w) for w in words], len(words)
    mean = sum(lengths) / n
    pairs = list(zip(words, words[1:], strict=False))
    return out + [
        math.log1p(n), mean, math.sqrt(sum((x - mean) ** 2 for x in lengths) / n), len(set(words)) / n, len(set(words)) / math.sqrt(n), sum(a == b for a, b in pairs) / n, len(set(pairs)) / max(1, n - 1), sum(x <= 3 for x in lengths) / n,
    ]


def test_whole_query_equals_brute_force(spark):
    """On one machine, from whole matrices: statistics, features, ridge, pooled probabilities."""
    rows, labels = corpus()
    rng = random.Random(6)
    rows = [(d, t if rng.random() < 0.7 else t[: rng.randrange(len(t))] + "é\n\nx x 5") for d, t in rows] + [(900, ""), (901, "  \n"), (902, None)]
    labels = [(d, y if rng.random() < 0.9 else 1 - y) for d, y in labels]
    got = {r.doc_id: r.score for r in op.score_quality(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    stats = {d: np.array(plain_statistics(t or ""), dtype=np.float32).astype(float) for d, t in rows}
    learned = [(d, y) for d, y in labels if zlib.crc32(str(d).encode()) % 5]
    x, y = np.array([stats[d] for d, _ in learned]), np.array([float(y) for _, y in learned])
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-6] = 1
    draw = np.random.default_rng(op.SEED)
    w, b = draw.normal(size=(op.N_STATS, op.FEATURES)) / op.BANDWIDTH, draw.uniform(0, 2 * np.pi, op.FEATURES)
    features = lambda v: np.hstack([np.ones((len(v), 1)), np.sqrt(2 / op.FEATURES) * np.cos(np.clip((v - mean) / scale, -8, 8) @ w + b)])
    z, penalty = features(x), op.RIDGE * np.eye(op.FEATURES + 1)
    penalty[0, 0] = 0
    beta = np.linalg.solve(z.T @ z + penalty, z.T @ y)
    bins = np.clip(((z @ beta + 0.5) / 2 * op.BINS).round(), 0, op.BINS).astype(int)
    held = sorted(set(bins.tolist()))
    count, share = [(bins == k).sum() for k in held], [y[bins == k].mean() for k in held]
    # Isotonic by its min-max formula.
    level = [max(min(np.average(share[i : j + 1], weights=count[i : j + 1]) for j in range(k, len(held))) for i in range(k + 1)) for k in range(len(held))]
    ids = [d for d, _ in rows]
    want = np.interp(features(np.array([stats[d] for d in ids])) @ beta, [-0.5 + 2 * k / op.BINS for k in held], level)
    assert {d: got[d] for d in ids} == pytest.approx(dict(zip(ids, want.tolist(), strict=True)), abs=0.02)
    assert np.abs(np.array([got[d] for d in ids]) - want).mean() < 1e-3


def test_held_out_labels_are_not_read(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    results = []
    for flip in (0, 1):
        changed = [(d, y ^ flip if zlib.crc32(str(d).encode()) % 5 == 0 else y) for d, y in labels]
        results.append({r.doc_id: r.score for r in op.score_quality(docs, spark.createDataFrame(changed, "doc_id long, quality int")).collect()})
    assert results[0] == pytest.approx(results[1])


def test_empty_tables_and_one_label(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")
    assert op.score_quality(docs, labels).collect() == []
    some = spark.createDataFrame([(1, "x"), (2, "y")], docs.schema)
    assert [r.score for r in op.score_quality(some, labels).collect()] == [0.5, 0.5]
    ones = op.score_quality(some, spark.createDataFrame([(1, 1), (2, 1)], labels.schema)).collect()
    assert all(r.score > 0.5 for r in ones)


@pytest.mark.skipif(not os.path.exists(SF), reason="the driver's tables aren't here")
def test_held_out_accuracy(spark):
    """Figures on the given tables; the bound leaves room for chance in about 80 held-out labels."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = op.score_quality(spark.read.parquet(f"{SF}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").select("score", "quality").collect()
    assert auc([r.score for r in got], [r.quality for r in got]) > 0.8
