"""Line dedup: lines that an earlier line repeats, exactly or with one word changed.

The order of lines is (doc_id, line number).  A line is removed if an earlier
line of the corpus is within its edit bound, an edit being a word put in, left out
or replaced.  The bound is part of what a repeated line is: one edit between lines
of ``min_words`` words or more, and none below, where one word is too large a part
of a line.  Lines are judged on the input, so a line that is itself removed still removes later ones.
Lines without a word are never removed.

Deletion neighbourhoods find the pairs: two lines are within one edit if leaving
one word out of the one gives the other, or leaving out the words at the same
place makes both equal.  So a line emits a hashed key for itself and one for each
word left out, and lines meet in equal keys.  A key's lines need no pairing: the
earliest of them answers for all, and that is a minimum, combined before it is
shuffled, so a template that a third of all lines follow is no larger work than
any other.

Equal lines count once.  And a line leaves out only words that can matter: it
must first share its first or its last half with another line (one edit leaves
one half as it was), which holds for few lines, and the text of the others isn't
read again; then all but one of its four segments, and only words of that
segment are left out.

A line is verified, word by word, against every line that answers for one of its
keys, and is removed if one of them is truly within the bound.

Null text has no lines.  A null doc_id comes after all others.  Rows that repeat
a doc_id don't count as earlier than each other at the same line number.  An
empty table gives an empty result.  Columns other than doc_id and text are kept
as they are by dedup_lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .store import doc_key, small, split_join, stored

MIN_WORDS = 8
SEGMENTS = 4
FIRST, LAST, SAME_PLACE, LEFT_OUT = (np.uint64(x) for x in (0x51ED270B, 0x2545F491, 0x9E3779B1, 0x85EBCA6B))


def by_line(chunk: ts.Chunk) -> tuple[ts.Chunk, np.ndarray]:
    """The same bytes with a row for each line, and where each document's lines begin."""
    breaks = np.flatnonzero(chunk.data == 10)
    bounds = np.sort(np.concatenate([chunk.bounds[:-1], breaks + 1, chunk.bounds[-1:]]))
    lines = np.searchsorted(breaks, chunk.bounds[1:]) - np.searchsorted(breaks, chunk.bounds[:-1]) + 1
    begin = np.concatenate([[0], np.cumsum(lines)])
    return ts.Chunk(chunk.first, len(bounds) - 1, chunk.data, bounds, chunk.starts, chunk.ends, np.searchsorted(chunk.starts, bounds)), begin


def _halves(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Keys of the first and last half of each line, for partners of the same length and one word less or more."""
    out = []
    for m in (b - a - 1, b - a):
        half, size = m // 2, m.astype(np.uint64)
        out.append(ts.mix(ts.range_hash(hashes, a, a + half) ^ FIRST * (size + FIRST)))
        out.append(ts.mix(ts.range_hash(hashes, b - half, b) ^ LAST * (size + LAST)))
    return [x.view(np.int64) for x in out]


def _lines(min_words: int):
    """Every line with a word: (key, line, print, halves or null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for chunk in ts.scan(batch.column("text")):
                lines, begin = by_line(chunk)
                hashes = lines.hashes()
                full = np.flatnonzero(lines.counts > 0)
                doc = np.repeat(np.arange(chunk.rows), np.diff(begin))[full]
                a, b = lines.edges[full], lines.edges[full + 1]
                long = b - a >= min_words
                halves = np.stack(_halves(hashes, a[long], b[long]), 1) if long.any() else np.zeros((0, 4), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[doc + chunk.first]),
                        pa.array((full - begin[doc]).astype(np.int32)),
                        pa.array(ts.range_hash(hashes, a, b).view(np.int64)),
                        ts.long_lists(halves.ravel(), 4 * long),
                    ],
                    ["key", "line", "print", "halves"],
                )

    return run


def cuts(m: int) -> list[int]:
    """Where the segments of a line of m words begin, and m."""
    return [i * m // SEGMENTS for i in range(SEGMENTS + 1)]


def signatures(words: np.ndarray) -> np.ndarray:
    """Keys of all but one segment, for each segment and partners as in _halves(); bit i stands for the i-th key."""
    n, a, b, tag = len(words), [], [], []
    for m in (n - 1, n):
        at = cuts(m)
        for i in range(SEGMENTS):
            a += [0, n - m + at[i + 1]]
            b += [at[i], n]
            tag.append(m * SEGMENTS + i)
    parts = ts.range_hash(words, np.array(a), np.array(b))
    return ts.mix(parts[::2] * FIRST ^ ts.mix(parts[1::2] + LAST) ^ ts.mix(np.array(tag, np.uint64) * SAME_PLACE + LEFT_OUT)).view(np.int64)


def neighbourhood(words: np.ndarray, whole: int, bits: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a line and the side each stands on: 0 the line itself, 1 with a word left out, 2 the same with its place.

    Words are left out in the segments that ``bits`` marks: the first SEGMENTS bits for side 1, the next for side 2.
    """
    n = len(words)
    up, down = ts._Tables.get(n + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:n])])
    rest = total[:-1] + (total[-1] - total[1:]) * down[1]  # what follows moves one place up
    rest = ts.mix(rest + np.uint64((n - 1) * 0xC2B2AE3D27D4EB4F % 2**64))
    place = np.arange(n, dtype=np.uint64) * LEFT_OUT + np.uint64(n)
    out, same = np.zeros(n, bool), np.zeros(n, bool)
    shorter, own = cuts(n - 1), cuts(n)
    for i in range(SEGMENTS):
        if bits >> i & 1:
            out[shorter[i] : shorter[i + 1] + 1] = True
        if bits >> SEGMENTS + i & 1:
            same[own[i] : own[i + 1]] = True
    keys = np.concatenate([np.array([whole], np.int64).view(np.uint64), rest[out], ts.mix(rest ^ ts.mix(place * SAME_PLACE + LEFT_OUT))[same]])
    return keys.view(np.int64), np.repeat(np.array([0, 1, 2], np.int8), [1, int(out.sum()), int(same.sum())])


def _candidates():
    """(print, key, line, words): the hashed words of the wanted lines of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, wanted = batch.column("key").to_numpy(), batch.column("wanted").to_pylist()
            for chunk in ts.scan(batch.column("text")):
                lines, begin = by_line(chunk)
                hashes = lines.hashes()
                prints = ts.range_hash(hashes, lines.edges[:-1], lines.edges[1:]).view(np.int64)
                out = {"print": [], "key": [], "line": [], "words": []}
                for r in range(chunk.rows):
                    for w in wanted[chunk.first + r]:
                        i = int(begin[r]) + w["line"]
                        if i < begin[r + 1] and prints[i] == w["print"]:
                            out["print"].append(w["print"])
                            out["key"].append(int(keys[chunk.first + r]))
                            out["line"].append(w["line"])
                            out["words"].append(hashes[lines.edges[i] : lines.edges[i + 1]].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["print"], pa.int64()), pa.array(out["key"], pa.int64()), pa.array(out["line"], pa.int32()), pa.array(out["words"], pa.list_(pa.int64()))],
                    list(out),
                )

    return run


def _word_lists(batch: pa.RecordBatch, name: str = "words") -> list[np.ndarray]:
    column = batch.column(name)
    values = column.values.to_numpy()
    return [values[a:b] for a, b in pairwise(column.offsets.to_numpy().tolist())]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [signatures(w.view(np.uint64)) for w in _word_lists(batch)]
        if found:
            bits = np.tile(np.arange(2 * SEGMENTS, dtype=np.int32), len(found))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.repeat(batch.column("print").to_numpy(), 2 * SEGMENTS)), pa.array(1 << bits)], ["signature", "print", "bit"])


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints, bits = batch.column("print").to_pylist(), batch.column("bits").to_pylist()
        found = [neighbourhood(w.view(np.uint64), p, b) for w, p, b in zip(_word_lists(batch), prints, bits, strict=True)]
        if not found:
            continue
        times = pa.array(np.repeat(np.arange(len(found)), [len(k) for k, _ in found]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([k for k, _ in found])), pa.array(np.concatenate([s for _, s in found])), *(batch.column(c).take(times) for c in ("print", "key", "line"))],
            ["variant", "side", "print", "key", "line"],
        )


def within_one_edit(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether one word put in, left out or replaced turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    differ = np.flatnonzero(a != b[: len(a)])
    if not len(differ):
        return True
    i = int(differ[0])
    return bool(np.array_equal(a[i + 1 :], b[i + 1 :]) if len(a) == len(b) else np.array_equal(a[i:], b[i + 1 :]))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = [within_one_edit(a, b) for a, b in zip(_word_lists(batch), _word_lists(batch, "witness_words"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("print")], ["print"]).filter(pa.array(good, pa.bool_()))


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(key, gone): for each document with removed lines, their numbers and fingerprints."""
    texts = docs.select(doc_key().alias("key"), F.col("text").cast("string").alias("text"))
    lines = stored(texts.mapInArrow(_lines(min_words), "key long, line int, print long, halves array<long>"), "lines")
    place = F.struct("key", "line")
    kinds = lines.groupBy("print").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.max("halves").alias("halves"))
    kinds = stored(kinds, "kinds")

    halves = kinds.filter("size(halves) > 0").select("print", F.explode("halves").alias("half"))
    met = halves.groupBy("half").agg(F.min("print").alias("lo"), F.max("print").alias("hi")).filter("lo < hi").select("half")
    half_met = halves.join(met, "half", "left_semi").select("print").distinct()
    wanted = kinds.join(half_met, "print", "left_semi").groupBy("first.key").agg(F.collect_list(F.struct("first.line", "print")).alias("wanted"))
    wanted = stored(wanted, "wanted")
    # Line numbers of few bytes go to all executors; more are joined by a shuffle.
    few = small(wanted, F.size("wanted") * 16 + 16)
    candidates = texts.join(F.broadcast(wanted) if few else wanted, "key").select("key", "text", "wanted")
    # Rows that repeat a doc_id may hold the same line: it counts once.
    candidates = stored(candidates.mapInArrow(_candidates(), "print long, key long, line int, words array<long>").dropDuplicates(["print"]), "candidates")

    signed = candidates.select("print", "words").mapInArrow(_signatures, "signature long, print long, bit int")
    met = signed.groupBy("signature").agg(F.min("print").alias("lo"), F.max("print").alias("hi")).filter("lo < hi").select("signature")
    bits = signed.join(met, "signature", "left_semi").groupBy("print").agg(F.bit_or("bit").alias("bits"))
    near = stored(candidates.join(bits, "print"), "near")
    variants = near.mapInArrow(_variants, "variant long, side byte, print long, key long, line int")
    own = F.struct("key", "line", "print")
    least = (
        variants.groupBy("variant")
        .agg(F.min(F.when(F.col("side") == 0, own)).alias("whole"), F.min(F.when(F.col("side") != 0, own)).alias("part"), F.min("print").alias("lo"), F.max("print").alias("hi"))
        .filter("lo < hi")
        .drop("lo", "hi")
    )
    witness = F.when(F.col("side") == 1, F.col("whole")).otherwise(F.col("part"))
    pairs = (
        variants.join(least, "variant")
        .withColumn("witness", witness)
        .filter((F.struct("witness.key", "witness.line") < F.struct("key", "line")) & (F.col("witness.print") != F.col("print")))
        .select("print", F.col("witness.print").alias("other"))
        .distinct()
    )
    other = near.select(F.col("print").alias("other"), F.col("words").alias("witness_words"))
    edited = pairs.join(near.select("print", "words"), "print").join(other, "other").select("print", "words", "witness_words").mapInArrow(_verify, "print long")
    edited = stored(edited.distinct().withColumn("edited", F.lit(True)), "edited", [near, candidates])

    ruled = stored(kinds.join(edited, "print", "left").filter("n > 1 or edited").select("print", "first", "edited", "n"), "ruled")
    gone = split_join(lines.select("key", "line", "print"), ruled, ["print"], "n", lines.count()).filter(F.coalesce("edited", F.lit(False)) | (F.struct("key", "line") > F.col("first")))
    return stored(gone.groupBy("key").agg(F.collect_set(F.struct("line", "print")).alias("gone")), "gone")


def _left(names: list[str], drop_emptied: bool):
    """What is left of each document, beside the columns ``names``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = batch.column("gone").to_pylist()
            texts = batch.column("text")
            out, n_lines, n_gone, keep = [], [], [], []
            for chunk in ts.scan(texts):
                lines = begin = prints = None
                if any(gone[chunk.first : chunk.first + chunk.rows]):
                    lines, begin = by_line(chunk)
                    prints = ts.range_hash(lines.hashes(), lines.edges[:-1], lines.edges[1:]).view(np.int64)
                for r in range(chunk.rows):
                    i = chunk.first + r
                    text = texts[i].as_py()
                    parts = text.split("\n") if text is not None else []
                    cut = {g["line"] for g in gone[i] or () if g["line"] < len(parts) and prints[begin[r] + g["line"]] == g["print"]}
                    left = [x for k, x in enumerate(parts) if k not in cut] if cut else parts
                    out.append("\n".join(left) if cut else text)
                    n_lines.append(len(parts))
                    n_gone.append(len(cut))
                    keep.append(not (drop_emptied and cut and not any(map(_has_word, left))))
            columns = [*(batch.column(n) for n in names), pa.array(out, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_gone, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "kept_text", "n_lines", "n_removed"]).filter(pa.array(keep, pa.bool_()))

    return run


def _has_word(line: str) -> bool:
    return bool(line.strip(" \t\n\v\f\r"))


def line_report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per row: doc_id, n_lines, n_removed, kept_sha256 of the lines that are left."""
    gone = removed_lines(docs, min_words)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc_key().alias("key"), F.col("text").cast("string").alias("text"))
    rows = texts.join(gone, "key", "left").select("doc_id", "text", "gone")
    full = rows.mapInArrow(_digest, "doc_id long, n_lines long, n_removed long, kept_sha256 string")
    return full


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _left(["doc_id"], False)(batches):
        sha = [hashlib.sha256((t or "").encode()).hexdigest() for t in batch.column("kept_text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "n_lines", "n_removed")] + [pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_removed", "kept_sha256"])


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, drop_emptied: bool = True) -> DataFrame:
    """The rows of docs with what is left of text; a document that had words and has none left is dropped unless drop_emptied is False."""
    gone = removed_lines(docs, min_words).withColumnRenamed("key", "__key")
    rows = docs.select(F.struct(*docs.columns).alias("row"), doc_key().alias("__key"), F.col("text").cast("string").alias("text"))
    joined = rows.join(gone, "__key", "left").select("row", "text", "gone")
    schema = joined.select("row").schema.add("kept_text", "string").add("n_lines", "long").add("n_removed", "long")
    left = joined.mapInArrow(_left(["row"], drop_emptied), schema)
    return left.select(*(F.col("kept_text").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
