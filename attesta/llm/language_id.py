"""Language identification in two levels of linear support vector machines.

A text is a distribution over hashed byte trigrams.  The first level decides
the language family, the second the language within it; both put one linear
support vector machine between each pair of classes, so closely related
languages meet in a machine of their own.  A pair's margin goes through a
logistic function, a class scores the mean of its pairs, and ``score`` is the
product of both levels.

The machines are fitted on at most ``sample_rows`` labelled rows, dealt evenly
to the languages and chosen by a hash of doc_id; each language has one at least,
so there are more rows only if there are more languages.  Every text is scored whole,
from its text alone, in one scan without a shuffle.

Null text, or text without a letter (Unicode category L), is ``und`` with score 0.  If no labelled
row exists, every row is ``und``.  With one language learned, that one is
predicted.  Columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textscan as ts

BUCKETS = 1 << 13
SAMPLE_ROWS = 2400
UNKNOWN = "und"

#: Language codes by family. A code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru pl cs sk uk be bg sr hr sl mk bs",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "turkic": "tr az kk uz",
    "indic": "hi bn mr ne gu pa ta te kn ml",
    "semitic": "ar he mt am",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def family(code: str) -> str:
    return _FAMILY.get(code.split("-")[0].lower(), code)


def trigrams(chunk: ts.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each byte trigram, and where each row's trigrams start; a row is padded by a space on both sides."""
    size = np.diff(chunk.bounds)
    edges = chunk.bounds + 2 * np.arange(chunk.rows + 1)
    padded = np.full(int(edges[-1]), 0x20, np.uint32)
    shift = np.repeat(np.arange(chunk.rows) * 2 + 1, size)
    padded[np.arange(len(chunk.data)) + shift] = ts._LOWER[chunk.data]
    key = padded[:-2] << 16 | padded[1:-1] << 8 | padded[2:] if len(padded) > 2 else padded[:0]
    return (key * np.uint32(2654435761) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32), edges


def row_sums(values: np.ndarray, edges: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sum over the trigrams of each row (the two that straddle rows are left out)."""
    out = np.zeros(len(size))
    full = np.flatnonzero(size > 0)
    if len(full):
        ends = np.stack([edges[:-1][full], edges[:-1][full] + size[full]], 1).ravel()
        out[full] = np.add.reduceat(np.append(values, np.float32(0)), np.minimum(ends, len(values)))[::2]
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in ts.scan(batch.column("text")):
            key, edges = trigrams(chunk)
            size = np.diff(chunk.bounds)
            buckets, counts = [], []
            for r in range(chunk.rows):
                b, c = np.unique(key[edges[r] : edges[r] + size[r]], return_counts=True)
                buckets.append(b)
                counts.append(c)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("lang").slice(chunk.first, chunk.rows),
                    pa.array(buckets, pa.list_(pa.int32())),
                    pa.array(counts, pa.list_(pa.int32())),
                    *(batch.column(c).slice(chunk.first, chunk.rows) for c in ("later", "place")),
                ],
                ["lang", "buckets", "counts", "later", "place"],
            )


def fit_pair(x: np.ndarray, y: np.ndarray, strength: float = 1e-4, steps: int = 120) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss between +1 and -1, by accelerated gradient; both classes weigh the same."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    v, c, rate = w.copy(), 0.0, 1.0 / (2 * (float((x * x).sum(1).max()) + 1) + strength)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v + c)) * y * weight
        grad, g0 = strength * v - 2 * (slack @ x), -2 * float(slack.sum())
        new, n0 = v - rate * grad, c - rate * g0
        pace = k / (k + 3)
        v, c = new + pace * (new - w), n0 + pace * (n0 - b)
        w, b = new, n0
    return w, b


@dataclass
class Level:
    """Machines between each pair of classes."""

    classes: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray  # a row for each pair
    bias: np.ndarray

    def score(self, margins: np.ndarray) -> np.ndarray:
        """Mean pair probability of each class, a column each."""
        if len(self.classes) == 1:
            return np.ones((len(margins), 1))
        out = np.zeros((len(margins), len(self.classes)))
        for k, (i, j) in enumerate(self.pairs):
            p = 1 / (1 + np.exp(-np.clip(3 * margins[:, k], -40, 40)))
            out[:, i] += p
            out[:, j] += 1 - p
        return out / (len(self.classes) - 1)


def fit_level(x: np.ndarray, labels: np.ndarray) -> Level:
    classes = sorted(set(labels.tolist()))
    pairs = list(combinations(range(len(classes)), 2))
    found = []
    for i, j in pairs:
        own = (labels == classes[i]) | (labels == classes[j])
        found.append(fit_pair(x[own], np.where(labels[own] == classes[i], 1, -1).astype(np.float32)))
    return Level(classes, pairs, np.array([w for w, _ in found], np.float32).reshape(-1, x.shape[1]), np.array([b for _, b in found], float))


@dataclass
class Model:
    families: Level
    within: dict[str, Level]
    scale: np.ndarray

    def predict(self, chunk: ts.Chunk) -> tuple[np.ndarray, np.ndarray]:
        key, edges = trigrams(chunk)
        size = np.diff(chunk.bounds)

        def margins(level: Level) -> np.ndarray:
            out = np.zeros((chunk.rows, len(level.pairs)))
            for k, w in enumerate(level.weights):
                out[:, k] = row_sums((w * self.scale)[key], edges, size) / np.maximum(size, 1) + level.bias[k]
            return out

        top = self.families.score(margins(self.families))
        best = top.argmax(1)
        lang, score = np.empty(chunk.rows, object), np.zeros(chunk.rows)
        for f, name in enumerate(self.families.classes):
            rows = np.flatnonzero(best == f)
            if len(rows):
                level = self.within[name]
                inner = level.score(margins(level))[rows]
                choice = inner.argmax(1)
                lang[rows] = np.array(level.classes, object)[choice]
                score[rows] = top[rows, f] * inner[np.arange(len(rows)), choice]
        return lang, score


def learnable(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(3)) != 1


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Fit on at most sample_rows rows that have a lang, evenly over the languages, or one of each where there are more languages."""
    rank = F.pmod(F.xxhash64("doc_id", "text", F.lit(17)), F.lit(1 << 30))
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", rank.alias("rank"))
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("rank").alias("least")).collect()  # one row a language
    if not found:
        return None
    share = max(1, sample_rows // len(found))
    # A language's bound lets in about its share, and its first row in any case.
    bounds = docs.sparkSession.createDataFrame([(r["lang"], r["least"], max(r["least"], int(min(1.0, 1.2 * share / r["n"]) * (1 << 30)))) for r in found], "lang string, least long, bound long")
    chosen = rows.join(F.broadcast(bounds), "lang").filter("rank <= bound")
    order = [(F.col("rank") > F.col("least")).alias("later"), (F.col("rank") / F.greatest(F.col("bound"), F.lit(1))).alias("place")]
    features = chosen.select("lang", "text", *order).mapInArrow(_features, "lang string, buckets array<int>, counts array<int>, later boolean, place double")
    picked = features.orderBy("later", "place", "lang").limit(max(sample_rows, len(found))).toPandas()
    if picked.empty:
        return None
    x = np.zeros((len(picked), BUCKETS), np.float32)
    for i, (b, c) in enumerate(zip(picked["buckets"], picked["counts"], strict=True)):
        if len(b):
            x[i, b] = np.asarray(c, np.float32) / np.sum(c)
    scale = 1 / (np.sqrt((x * x).mean(0)) + 1e-3)
    scale /= np.sqrt(((x * scale) ** 2).sum(1)).mean()
    x *= scale
    labels = picked["lang"].to_numpy(object)
    groups = np.array([family(v) for v in labels], object)
    return Model(fit_level(x, groups), {f: fit_level(x[groups == f], labels[groups == f]) for f in sorted(set(groups))}, scale.astype(np.float32))


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for chunk in ts.scan(text):
                lang, score = model.predict(chunk) if model else (np.full(chunk.rows, UNKNOWN, object), np.zeros(chunk.rows))
                ascii_letters = np.concatenate([[0], np.cumsum(_ASCII_LETTER[chunk.data])])
                for r in np.flatnonzero(ascii_letters[chunk.bounds[1:]] == ascii_letters[chunk.bounds[:-1]]):
                    if not _LETTER.search(text[chunk.first + int(r)].as_py() or ""):
                        lang[r], score[r] = UNKNOWN, 0.0
                ids = batch.column("doc_id").slice(chunk.first, chunk.rows)
                held = [i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i in ids.to_pylist()]
                yield pa.RecordBatch.from_arrays([ids, pa.array(held), pa.array(lang, pa.string()), pa.array(np.clip(score, 0.0, 1.0))], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Fit on the labelled rows whose crc32(doc_id) mod 3 isn't 1, and predict every row."""
    return identify(docs, fit(docs.filter(learnable(F.col("doc_id"))), sample_rows))
