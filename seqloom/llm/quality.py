"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

cos(Wx + b) with Gaussian W approximates a Gaussian kernel over the standardised statistics; a ridge regression on it needs only sums over
rows (the normal equations), which each partition adds up on its own. The fitted value is made a probability by pooling adjacent violators over
BINS bins of it. Fitting reads only labelled training rows; statistics and scores cover every document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import crc32_mod, map_arrow, materialize, text_or_empty

FEATURES, BANDWIDTH, RIDGE, SEED, BINS = 256, 3.0, 1.0, 20, 1000
THRESHOLD = 0.3
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "stop": b".,;:?", "bang": b"!", "bar": b"|", "symbol": b"#$%&*+=<>/\\@^_~{}[]", "line": b"\n", "quote": b"\"'()-"}
_TABLE = np.stack([np.isin(np.arange(256), np.frombuffer(v, dtype=np.uint8)) for v in _CLASSES.values()] + [np.arange(256) >= 128, np.arange(256) < 33]).astype(np.float64)
N_STATS = len(_TABLE) + 13


def statistics(text: str) -> np.ndarray:
    """A text's statistics: shares of byte classes, lengths, repetition. An empty text has zeros."""
    out = np.zeros(N_STATS)
    data = text.encode()
    if not data:
        return out
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    share = counts / len(data)
    out[: len(_TABLE)] = _TABLE @ share
    words, lines = data.split(), text.split("\n")
    used = share[share > 0]
    rest = [np.log1p(len(data)), float(-(used * np.log2(used)).sum()), np.log1p(len(lines)), len(set(lines)) / len(lines), np.log1p(len(data) / len(lines))]
    if words:
        n, lengths, distinct = len(words), np.fromiter(map(len, words), dtype=np.float64, count=len(words)), set(words)
        same = sum(map(bytes.__eq__, words, words[1:]))
        pairs = len(set(zip(words, words[1:], strict=False)))
        rest += [np.log1p(n), lengths.mean(), lengths.std(), len(distinct) / n, len(distinct) / np.sqrt(n), same / n, pairs / max(1, n - 1), (lengths <= 3).mean()]
    else:
        rest += [0.0] * 8
    out[len(_TABLE) :] = rest
    return out


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<float>) for every row of docs; a null text counts as empty."""

    def work(batches):
        for batch in batches:
            x = np.stack([statistics(t) for t in batch.column("text").to_pylist()]).astype(np.float32)
            offsets = np.arange(0, x.size + 1, N_STATS, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, x.ravel())], ["doc_id", "x"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).alias("text")), work, "doc_id long, x array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS).astype(np.float64)


def partition_sums(df: DataFrame, sums) -> np.ndarray | None:
    """The sum of sums(batch), a vector, over all rows: each partition's is added to others' in 16 tasks, and those on the driver."""

    def add(parts):
        total = None
        for part in parts:
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    of = lambda v: np.frombuffer(v.as_py(), dtype=np.float64)
    parts = map_arrow(df, lambda batches: add(map(sums, batches)), "v binary")
    rows = parts.repartition(16).mapInArrow(lambda batches: add(of(v) for b in batches for v in b.column("v")), "v binary").collect()
    return sum(np.frombuffer(r.v, dtype=np.float64) for r in rows) if rows else None


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    edges: np.ndarray  # of the bins of fitted values
    levels: np.ndarray  # the probability in each bin

    def map(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.ones((len(x), 1)), np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b)])

    def fitted(self, x: np.ndarray) -> np.ndarray:
        return self.map(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.fitted(x), self.edges, self.levels), 0, 1) if len(x) else np.zeros(0)


def pool_adjacent(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The nondecreasing sequence with the least weighted squared error."""
    blocks: list[list[float]] = []
    for v, w in zip(y, weight, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v1, w1, n1 = blocks.pop()
            v0, w0, n0 = blocks.pop()
            blocks.append([(v0 * w0 + v1 * w1) / (w0 + w1), w0 + w1, n0 + n1])
    return np.concatenate([np.full(n, v) for v, _, n in blocks]) if blocks else np.zeros(0)


def fit(rows: DataFrame) -> Model:
    """A model from (x, y): y is 0 or 1. Without rows, or with one label only, scores are the smoothed share of label 1."""
    first = partition_sums(rows, lambda b: (lambda x: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0), [b.column("y").to_numpy(zero_copy_only=False).sum()]]))(_matrix(b.column("x"))))
    first = np.zeros(2 * N_STATS + 2) if first is None else first
    n, ones = max(first[0], 1.0), first[-1]
    mean = first[1 : N_STATS + 1] / n
    scale = np.sqrt(np.maximum(first[N_STATS + 1 : -1] / n - mean**2, 0))
    scale[scale < 1e-6] = 1.0
    rng = np.random.default_rng(SEED)
    w, b = rng.normal(size=(N_STATS, FEATURES)) / BANDWIDTH, rng.uniform(0, 2 * np.pi, FEATURES)
    share = (ones + 0.5) / (first[0] + 1)
    model = Model(mean, scale, w, b, np.zeros(FEATURES + 1), np.array([-1.0, 2.0]), np.array([share, share]))
    if not 0 < ones < first[0]:
        return model
    k = FEATURES + 1

    def normal(batch):
        z, y = model.map(_matrix(batch.column("x"))), batch.column("y").to_numpy(zero_copy_only=False)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    total = partition_sums(rows, normal)
    penalty = RIDGE * np.eye(k)
    penalty[0, 0] = 0
    model.beta = np.linalg.solve(total[: k * k].reshape(k, k) + penalty, total[k * k :])
    centres = np.linspace(-0.5, 1.5, BINS + 1)

    def binned(batch):
        at = np.clip(((model.fitted(_matrix(batch.column("x"))) + 0.5) / 2 * BINS).round().astype(int), 0, BINS)
        y = batch.column("y").to_numpy(zero_copy_only=False)
        return np.concatenate([np.bincount(at, minlength=BINS + 1), np.bincount(at, weights=y, minlength=BINS + 1)]).astype(np.float64)

    total = partition_sums(rows, binned)
    count, ones = total[: BINS + 1], total[BINS + 1 :]
    held = count > 0
    model.edges, model.levels = centres[held], pool_adjacent(ones[held] / count[held], count[held])
    return model


def score_quality(docs: DataFrame, labels: DataFrame, fold: int = 5, held: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of docs.

    labels: doc_id and quality; only rows whose crc32(doc_id) mod `fold` isn't `held` are learned from, null labels and ids are left out and a
    repeated doc_id counts with its largest label. Null and empty texts are scored like any other; a null doc_id is never held out.
    """
    stats = materialize(document_statistics(docs), "stats")
    known = labels.where("doc_id is not null and quality is not null").where(crc32_mod(F.col("doc_id"), fold) != held)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("double")).alias("y"))
    rows = materialize(stats.join(known, "doc_id").select("x", "y"), "train")
    model = docs.sparkSession.sparkContext.broadcast(fit(rows))

    def work(batches):
        for batch in batches:
            s = model.value.score(_matrix(batch.column("x")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    scored = map_arrow(stats, work, "doc_id long, score double")
    held_out = F.coalesce(crc32_mod(F.col("doc_id"), fold) == held, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
