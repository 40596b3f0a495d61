"""Substring dedup: word sequences that an earlier document has too.

A suffix tree over all word suffixes shows every repeated passage: an internal
node at depth d stands for a sequence of d words that starts at all leaves
below it.  The tree is built in parts.  Each suffix is put in the part of its
prefix, and the prefix is as long as it takes:

* The prefix of a suffix ends with the lowest-hashed 8-word sequence of the
  suffix's first 50 words.  It depends on those words alone, so suffixes that
  share a node at depth 50 are in one part; neighbouring suffixes of a document
  mostly end their prefixes at the same place and travel as one segment of
  text.
* Parts whose prefix occurs in one document only have no node of interest and
  are dropped before any text moves.
* Parts of more than ``part_words`` words (a passage that a third of a corpus
  may hold, or one that a document goes on repeating) get the longest prefix,
  all 50 words.  Such a part is one node; its smallest document is a
  map-side-combined minimum.
* All other parts are built in one task each, as a suffix tree with exact
  prefix lengths (``suffix_tree.py``).  Its internal nodes at depth 50 or more
  are the repeats; the left-maximal ones are cut out over their whole depth.
  A suffix ends where its segment ends, so a passage longer than a segment comes
  as maximal repeats of neighbouring parts that overlap and are merged.

Null text has no words.  A null doc_id comes after all other ids.  Rows that
repeat a doc_id don't count as earlier than each other.  An empty table gives
an empty result.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .store import doc_key, split_join, stored, width
from .suffix_tree import earlier_repeats

WINDOW = 50
ANCHOR = 8


def _minimizers(chunk: ts.Chunk, hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window that lies in one document: its first word, and its lowest anchor hash."""
    low = ts.sliding_min(ts.rolling(hashes, anchor), window - anchor + 1)
    at = np.flatnonzero(chunk.inside(window))
    return at, low[at]


def _runs(chunk: ts.Chunk, at: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Where a run of neighbouring windows with one anchor starts."""
    row = chunk.row_of[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1])
    return np.flatnonzero(fresh)


def _outline(window: int, anchor: int):
    """Per document: its key, words, fingerprint, distinct anchors, and the words of the segments around each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in ts.scan(batch.column("text")):
                hashes = chunk.hashes()
                at, low = _minimizers(chunk, hashes, window, anchor)
                runs = _runs(chunk, at, low)
                size = at[np.append(runs[1:], len(at))[: len(runs)] - 1] - at[runs] + window
                row, low = chunk.row_of[at[runs]], low[runs]
                order = np.lexsort((low, row))
                row, low = row[order], low[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (low[1:] != low[:-1])
                size = np.add.reduceat(size[order], np.flatnonzero(new)) if len(row) else size
                row, low = row[new], low[new]
                counts = np.bincount(row, minlength=chunk.rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").slice(chunk.first, chunk.rows),
                        pa.array(chunk.counts),
                        pa.array(ts.fingerprints(hashes, chunk.edges)),
                        ts.long_lists(low.view(np.int64), counts),
                        ts.long_lists(size, counts),
                    ],
                    ["key", "n_words", "print", "anchors", "sizes"],
                )

    return run


def _segments(window: int, anchor: int):
    """Segments of text around the anchors that several documents hold: (anchor, heavy, key, print, start, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, prints = batch.column("key").to_numpy(), batch.column("print").to_numpy()
            lists = batch.column("anchors")
            flat, ends = lists.flatten().to_numpy().view(np.uint64), lists.value_lengths().to_numpy().cumsum()
            flags = batch.column("heavy").flatten().to_numpy(zero_copy_only=False)
            for chunk in ts.scan(batch.column("text")):
                hashes = chunk.hashes()
                own = ts.fingerprints(hashes, chunk.edges) == prints[chunk.first : chunk.first + chunk.rows]
                at, low = _minimizers(chunk, hashes, window, anchor)
                runs = _runs(chunk, at, low)
                row = chunk.row_of[at[runs]] if len(runs) else np.zeros(0, np.int64)
                stop = np.append(runs[1:], len(at))
                key = low[runs]
                good, heavy = np.zeros(len(runs), bool), np.zeros(len(runs), bool)
                edges = np.searchsorted(row, np.arange(chunk.rows + 1))
                for r in np.flatnonzero(own & (np.diff(edges) > 0)):
                    a, b = edges[r], edges[r + 1]
                    i = chunk.first + r
                    part = slice(ends[i] - len(lists[i]), ends[i])
                    order = np.argsort(flat[part])
                    wanted = flat[part][order]
                    place = np.minimum(np.searchsorted(wanted, key[a:b]), len(wanted) - 1)
                    good[a:b] = wanted[place] == key[a:b]
                    heavy[a:b] = flags[part][order][place]
                picked = np.flatnonzero(good)
                first, last = at[runs[picked]], at[stop[picked] - 1] + window
                texts, words, done = [], [], -1
                for r, a, b in zip(row[picked].tolist(), first.tolist(), last.tolist(), strict=True):
                    if r != done:
                        words, base, done = chunk.words(r), int(chunk.edges[r]), r
                    texts.append(b" ".join(words[a - base : b - base]))
                rows = row[picked] + chunk.first
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key[picked].view(np.int64)),
                        pa.array(heavy[picked]),
                        pa.array(keys[rows]),
                        pa.array(prints[rows]),
                        pa.array(first - chunk.edges[row[picked]]),
                        pa.array(texts, pa.binary()).cast(pa.string()),
                    ],
                    ["anchor", "heavy", "key", "print", "start", "words"],
                )

    return run


def _merged(first: np.ndarray, last: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges that overlap in a row as one; they are sorted by their starts."""
    last = np.maximum.accumulate(last)
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] > last[:-1]) | (row[1:] != row[:-1])
    a = np.flatnonzero(new)
    return first[a], last[np.append(a[1:], len(first)) - 1], row[a]


def _tree(window: int):
    """Build the subtrees of sorted segments, and report the repeats that a smaller document has: (key, print, starts, ends)."""

    def build(table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys, prints, start = (table.column(x).to_numpy() for x in ("key", "print", "start"))
        for chunk in ts.scan(table.column("words"), limit=1 << 40):
            first, length = earlier_repeats(chunk.hashes(), chunk.edges, keys[chunk.first : chunk.first + chunk.rows], window)
            if not len(first):
                continue
            first, last, row = _merged(first, first + length, chunk.row_of[first])
            shift = start[row + chunk.first] - chunk.edges[row]
            rows, counts = np.unique(row, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[rows + chunk.first]), pa.array(prints[rows + chunk.first]), ts.long_lists(first + shift, counts), ts.long_lists(last + shift, counts)],
                ["key", "print", "starts", "ends"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last part may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            anchors = batch.column("anchor").to_numpy()
            whole = int(np.searchsorted(anchors, anchors[-1]))
            if whole:
                yield from build(pa.Table.from_batches([*held, batch.slice(0, whole)]))
                held = []
            elif held and held[-1].column("anchor")[-1].as_py() != anchors[-1]:
                yield from build(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(whole))
        if held:
            yield from build(pa.Table.from_batches(held))

    return run


def _full_prefixes(window: int):
    """Every window of the segments of heavy parts, by a hash of its whole word sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, prints, start = (batch.column(x).to_numpy() for x in ("key", "print", "start"))
            for chunk in ts.scan(batch.column("words")):
                hashes = chunk.hashes()
                at = np.flatnonzero(chunk.inside(window))
                row = chunk.row_of[at]
                both = ts.rolling(hashes, window)[at], ts.rolling(hashes * np.uint64(0x2545F4914F6CDD1D), window)[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(both[0].view(np.int64)), pa.array(both[1].view(np.int64)), pa.array(keys[row + chunk.first]), pa.array(prints[row + chunk.first]), pa.array(at - chunk.edges[row] + start[row + chunk.first])],
                    ["w0", "w1", "key", "print", "at"],
                )

    return run


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _apply(with_text: bool):
    """What is left of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts, whole = batch.column("cuts").to_pylist(), batch.column("copies").to_pylist()
            out = {"removed": [], "text": [], "sha": [], "n": []}
            for chunk in ts.scan(batch.column("text")):
                prints = ts.fingerprints(chunk.hashes(), chunk.edges)
                for r in range(chunk.rows):
                    i, n = chunk.first + r, int(chunk.edges[r + 1] - chunk.edges[r])
                    keep = np.ones(n, bool)
                    if whole[i] and int(prints[r]) in whole[i]:
                        keep[:] = False
                    for cut in cuts[i] or ():
                        if cut["print"] == prints[r]:
                            for a, b in zip(cut["starts"], cut["ends"], strict=True):
                                keep[a:b] = False
                    gone = n - int(keep.sum())
                    left = b" ".join(chunk.words(r, keep if gone else None))
                    out["n"].append(n)
                    out["removed"].append(gone)
                    out["sha"].append(hashlib.sha256(left).hexdigest())
                    out["text"].append(left if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["removed"], pa.int64()), pa.array(out["sha"], pa.string()), pa.array(out["text"], pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, part_words: int = 1 << 19, with_text: bool = True) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 and kept_text, without each word that lies in a window of ``window`` words that also starts in a document with a smaller doc_id.

    ``with_text=False`` leaves kept_text null.
    Shuffles: the anchors (about 5 % of the words, 8 bytes each), twice the text, and the segments around anchors that several documents hold.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", doc_key().alias("key"), "text")
    outline = stored(
        texts.select("key", "text").mapInArrow(_outline(window, anchor), "key long, n_words long, print long, anchors array<long>, sizes array<long>"),
        "outline",
    )
    # Copies of a whole document: the first of them stands for all.
    first = outline.groupBy("print", "n_words").agg(F.min("key").alias("first"), F.max("key").alias("final"), F.count("*").alias("n"))
    many = stored(first.filter((F.col("first") < F.col("final")) & (F.col("n_words") >= window)), "copies")
    copies = split_join(outline.select("key", "print", "n_words"), many, ["print", "n_words"], "n", outline.count()).filter("key > first").select("key", "print")
    unique = outline.join(copies, ["key", "print"], "left_anti")
    places = stored(unique.select("key", "print", F.explode(F.arrays_zip("anchors", "sizes")).alias("a")).select("key", "print", "a.*").distinct(), "places")
    shared = (
        places.withColumnRenamed("anchors", "anchor")
        .groupBy("anchor")
        .agg(F.min("key").alias("least"), F.max("key").alias("most"), F.count("*").alias("n"), F.sum("sizes").alias("size"))
        .filter("least < most")
        .select("anchor", "n", (F.col("size") > part_words).alias("heavy"))
    )
    met = split_join(places.select("key", "print", F.col("anchors").alias("anchor")), stored(shared, "anchors"), ["anchor"], "n", places.count())
    wanted = met.groupBy("key", "print").agg(F.collect_list(F.struct("anchor", "heavy")).alias("a")).select("key", "print", F.col("a.anchor").alias("anchors"), F.col("a.heavy").alias("heavy"))
    segments = stored(
        texts.select("key", "text").join(wanted, "key").mapInArrow(_segments(window, anchor), "anchor long, heavy boolean, key long, print long, start long, words string"),
        "segments",
    )
    light = (
        segments.filter("not heavy")
        .repartition(width(spark), "anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(_tree(window), "key long, print long, starts array<long>, ends array<long>")
    )
    windows = segments.filter("heavy").mapInArrow(_full_prefixes(window), "w0 long, w1 long, key long, print long, at long")
    least = windows.groupBy("w0", "w1").agg(F.min("key").alias("least"), F.max("key").alias("most"), F.count("*").alias("n")).filter("least < most")
    least = stored(least.select("w0", "w1", "least", "n"), "windows")
    total = least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    dense = (
        split_join(windows, least, ["w0", "w1"], "n", total)
        .filter("key > least")
        .groupBy("key", "print")
        .agg(F.sort_array(F.collect_set("at")).alias("starts"))
        .select("key", "print", "starts", F.transform("starts", lambda x: x + window).alias("ends"))
    )
    cuts = light.unionByName(dense).groupBy("key").agg(F.collect_list(F.struct("print", "starts", "ends")).alias("cuts"))
    gone = copies.groupBy("key").agg(F.collect_set("print").alias("copies"))
    changes = stored(cuts.join(gone, "key", "full"), "changes")
    return texts.join(changes, "key", "left").select("doc_id", "text", "cuts", "copies").mapInArrow(_apply(with_text), _RESULT)
