"""Quality classifier: a factorisation machine over words, structure and metadata.

A text is a sparse vector: shares of its hashed words, statistics of its
structure, and metadata of its size.  The machine adds to a linear model the
product of every pair of features, weighted by the inner product of their
low-rank factors; the sum over all pairs is half of (square of sums minus sum
of squares) for each factor, so scoring is linear in the number of features.

It is fitted on at most ``sample_rows`` labelled rows, those of the lowest
hashes of doc_id.  Each whole text is then scored from its text alone, in one scan
without a shuffle.

Null text is empty and is scored like any other.  A null doc_id isn't held out.
Without labelled rows, or with one class only, the score is that class's share
(0.5 without rows).  Labels that are null, or of rows without a document, are
left out.  Columns other than doc_id, text and quality are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .measures import measure

BUCKETS = 1 << 11
FACTORS = 4
SAMPLE_ROWS = 4000
THRESHOLD = 0.7


def vectors(chunk: ts.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Word shares (a row of BUCKETS each) and structure features of each row."""
    hashes = chunk.hashes()
    bucket = (hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    edges = chunk.edges.tolist()
    words = np.zeros((chunk.rows, BUCKETS), np.float32)
    for r in range(chunk.rows):
        if edges[r + 1] > edges[r]:
            words[r] = np.bincount(bucket[edges[r] : edges[r + 1]], minlength=BUCKETS)
    distinct = np.minimum(1.0, (words > 0).sum(1) / np.maximum(1, chunk.counts))
    words /= np.maximum(1, chunk.counts)[:, None]
    m = measure(chunk, hashes).astype(np.float64)
    n, chars, symbols, dup, repeat, lines, upper, letters, digits, shouts = m.T
    per = lambda a, b: np.minimum(a / np.maximum(1, b), 3.0)
    stats = np.stack(
        [
            np.log1p(n), np.log1p(chars), np.log1p(lines), (n < 20).astype(float), (n < 5).astype(float),
            per(symbols, n), per(dup, lines), per(repeat, n), per(upper, letters), per(digits, chars), per(shouts, n),
            np.minimum(chars / np.maximum(1, n), 20.0), per(letters, chars), distinct, np.sqrt(words.max(1)),
            (100 * symbols > 20 * n).astype(float), (100 * repeat > 30 * n).astype(float), (100 * shouts > 40 * n).astype(float),
        ],
        1,
    )
    return words, stats.astype(np.float32)


@dataclass
class Machine:
    centre: np.ndarray
    spread: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def inputs(self, words: np.ndarray, stats: np.ndarray) -> np.ndarray:
        return np.concatenate([np.sqrt(words), np.clip((stats - self.centre) / self.spread, -4, 4)], 1, dtype=np.float32)

    def logits(self, x: np.ndarray) -> np.ndarray:
        sums = x @ self.factors
        squares = (x * x) @ (self.factors * self.factors)
        return self.bias + x @ self.weights + 0.5 * (sums * sums - squares).sum(1)

    def score(self, chunk: ts.Chunk) -> np.ndarray:
        return _logistic(self.logits(self.inputs(*vectors(chunk))))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))


def train(words: np.ndarray, stats: np.ndarray, y: np.ndarray, steps: int = 250, rate: float = 0.03, decay: float = 1e-3, seed: int = 5) -> Machine:
    """Logistic loss with both classes weighted alike, by Adam on all rows at once."""
    rng = np.random.default_rng(seed)
    width = words.shape[1] + stats.shape[1]
    m = Machine(stats.mean(0), stats.std(0) + 1e-3, 0.0, np.zeros(width, np.float32), rng.normal(0, 0.02, (width, FACTORS)).astype(np.float32))
    x = m.inputs(words, stats)
    x2 = x * x
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())).astype(np.float32)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (np.zeros(1, np.float32), m.weights, m.factors)]
    for k in range(1, steps + 1):
        sums = x @ m.factors
        g = ((_logistic(m.bias + x @ m.weights + 0.5 * (sums * sums - x2 @ (m.factors**2)).sum(1)) - y) * weight).astype(np.float32)
        grads = (np.array([g.sum()], np.float32), x.T @ g + decay * m.weights, x.T @ (g[:, None] * sums) - (x2.T @ g)[:, None] * m.factors + decay * m.factors)
        bias = np.array([m.bias], np.float32)
        for p, grad, (first, second) in zip((bias, m.weights, m.factors), grads, state, strict=True):
            first += 0.1 * (grad - first)
            second += 0.01 * (grad * grad - second)
            p -= rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
        m.bias = float(bias[0])
    return m


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in ts.scan(batch.column("text")):
            words, stats = vectors(chunk)
            found = [np.flatnonzero(w) for w in words]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("quality").slice(chunk.first, chunk.rows),
                    pa.array([b.astype(np.int32) for b in found], pa.list_(pa.int32())),
                    pa.array([w[b] for w, b in zip(words, found, strict=True)], pa.list_(pa.float32())),
                    pa.array(list(stats), pa.list_(pa.float32())),
                    batch.column("rank").slice(chunk.first, chunk.rows),
                    pa.array(ts.fingerprints(chunk.hashes(), chunk.edges)),
                ],
                ["quality", "buckets", "shares", "stats", "rank", "print"],
            )


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Machine | float:
    """Fit on at most sample_rows labelled documents; a plain share where there is nothing to tell apart."""
    marked = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    chosen = marked.select("doc_id", "quality", F.xxhash64("doc_id", F.lit(23)).alias("rank")).orderBy("rank", "doc_id").limit(sample_rows)
    # At most sample_rows ids with their labels.
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    features = texts.join(F.broadcast(chosen), "doc_id").select("quality", "text", "rank").mapInArrow(_vectors, "quality int, buckets array<int>, shares array<float>, stats array<float>, rank long, print long")
    picked = features.orderBy("rank", "print").limit(sample_rows).toPandas()
    y = (picked["quality"].to_numpy() > 0).astype(np.float32) if len(picked) else np.zeros(0, np.float32)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    words = np.zeros((len(picked), BUCKETS), np.float32)
    for i, (b, s) in enumerate(zip(picked["buckets"], picked["shares"], strict=True)):
        words[i, b] = s
    return train(words, np.array(picked["stats"].tolist(), np.float32), y)


def _score(model: Machine | float, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in ts.scan(batch.column("text")):
                score = np.full(chunk.rows, model) if isinstance(model, float) else model.score(chunk)
                ids = batch.column("doc_id").slice(chunk.first, chunk.rows)
                held = [i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in ids.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(held, pa.bool_()), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
                )

    return run


def score(docs: DataFrame, model: Machine | float, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_score(model, threshold), "doc_id long, held_out boolean, score double, predicted int")


def classify_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Fit on labels whose crc32(doc_id) mod 4 isn't 2, and score every document."""
    open_rows = labels.filter(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(4)) != 2)
    return score(docs, fit(docs, open_rows, sample_rows))
