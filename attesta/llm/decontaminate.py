"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of all words come from a sketch of fixed size over the
   whole corpus, and give every word its inverse document frequency.
2. Every item has telling words: its rarest ones, as many as it takes for any
   text that passes the check of step 5 to hold ``NEED`` of them.  The corpus is
   scanned for them, and each document keeps where they stand.
3. Passages of 32 words, together with the benchmark's own passages, are the rows
   of a TF-IDF matrix.  Its leading right singular vectors come from a distributed
   randomised SVD: tasks multiply their rows with a random matrix and back, by
   counts of the pairs of words in a row, and only sums of the shape (words, rank)
   leave a task.
4. Windows of the texts, one from every 16th word on and as wide as the item asks
   for, and benchmark items are projected on these vectors (as one product: every
   telling word has the score of its projection with each item).  A window whose
   product with an item reaches the least that a text accepted by step 5 can have
   is a candidate.
5. Candidates are checked on the words themselves: the longest common
   subsequence of the item and the window must cover most of the item; for a
   paraphrase, less of it, but then the answer (the item's last words) nearly
   whole.

The benchmark is a fixed query set.  The texts are read three times however many
items it has (up to ``BOOK`` items at a time): for the frequencies, for the places
of all items' telling words, and for the check.  Steps 3 and 4 take the items in
blocks of at most ``ITEMS`` and read those places alone, so what is broadcast has
a fixed bound.  The latent
space has more directions than a block has items, so it holds each item nearly
whole; one that loses more than ``LOST`` is looked up on its words.

Null text has no passage; null or empty items match nothing.  Words are compared
in lower case (A-Z), stripped of punctuation at their ends.  Rows that repeat a doc_id are
reported once.  Empty tables give an empty result.  Other columns are ignored,
and kept by drop_contaminated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as ts
from .adders import schema, slices, summed
from .store import LAST_ID, doc_key, small, stored

CELLS = 1 << 17
NEED = 4  # telling words of an item that an accepted text holds at least, if the item is that long
RANK = 256
SPARE = 16
ITEMS = RANK - SPARE  # a block fits into the latent space
LOST = 1e-3  # share of an item's norm that the latent space may lack
BOOK = 20_000  # items looked up in one reading of the texts
EMPHASIS = 512  # times the weight at which items and passages count alike
BLOCK = 16
SIZES = (1, 2, 4)  # blocks in a passage
PIECE = 1024  # blocks multiplied at a time
PAIRS = 1 << 24  # counts of pairs of words in a task
LONG = 64  # bytes of a word
LCS_FULL = 0.8
LCS_PARAPHRASE = 0.6
ANSWER_WORDS = 8
ANSWER = 0.75

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?\"'()[]{}"
_LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
_IS_EDGE = np.zeros(256, bool)
_IS_EDGE[[ord(c) for c in _EDGE]] = True
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k of eight bytes


def words_of(text: str | None) -> list[str]:
    """Words in lower case without punctuation at their ends; a word of punctuation alone is empty, and keeps its place."""
    return [w.translate(_LOWER).strip(_EDGE) for w in _WORD.findall(text or "")]


def _trimmed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without punctuation at their ends."""
    starts, ends = starts.copy(), ends.copy()
    at = np.flatnonzero(_IS_EDGE[data[starts]])
    while len(at):  # as many turns as the longest run of punctuation
        starts[at] += 1
        at = at[starts[at] < ends[at]]
        at = at[_IS_EDGE[data[starts[at]]]]
    at = np.flatnonzero((starts < ends) & _IS_EDGE[data[ends - 1]])
    while len(at):
        ends[at] -= 1
        at = at[starts[at] < ends[at]]
        at = at[_IS_EDGE[data[ends[at] - 1]]]
    return starts, ends


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from its length and eight bytes at a time; of long words from all bytes at once."""
    raw = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", raw, 0, (1,))  # the bytes from each place on
    size = ends - starts
    out = ts.mix(size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) ^ eight[starts] & _FIRST[np.minimum(size, 8)])
    at = np.flatnonzero(size > LONG)
    if len(at):
        out[at] = ts.range_hash(ts._BYTE[data], starts[at], ends[at])
    at = np.flatnonzero((size > 8) & (size <= LONG))
    start = starts[at] + 8
    while len(at):
        left = ends[at] - start
        out[at] = ts.mix(out[at] * np.uint64(0x9E3779B97F4A7C15) + (eight[start] & _FIRST[np.minimum(left, 8)]))
        at, start = at[left > 8], start[left > 8] + 8
    return out


def word_hashes(chunk: ts.Chunk) -> np.ndarray:
    """Hashes of the words as words_of() has them, for a chunk scanned in lower case."""
    return _hashed(chunk.data, *_trimmed(chunk.data, chunk.starts, chunk.ends))


def hash_list(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8)
    edges = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    return _hashed(data, edges[:-1], edges[1:])


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(47)).astype(np.int64)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold a word of each cell, over a task; the last number is the number of documents."""
    total = np.zeros(CELLS + 1, np.int64)
    for batch in batches:
        for chunk in ts.scan(batch.column("text"), lower=True):
            cell = _cell(word_hashes(chunk))
            seen = np.sort(chunk.row_of * CELLS + cell)  # faster than np.unique
            total[:CELLS] += np.bincount(seen[np.append(True, seen[1:] != seen[:-1])[: len(seen)]] % CELLS, minlength=CELLS)
            total[CELLS] += chunk.rows
    yield from slices(total)


@dataclass
class Query:
    """A block of benchmark items as rows of the TF-IDF matrix."""

    ids: list
    words: list[list[str]]
    hashes: np.ndarray  # of telling words, sorted
    weights: np.ndarray  # roots, so a product of two rows weighs a word by its inverse document frequency
    rows: np.ndarray  # a row for each item
    bounds: np.ndarray  # the least product of an item's row and a window that judge() accepts
    least: int  # telling words in such a window
    counts: np.ndarray  # how often an item has each word
    answers: np.ndarray  # and its answer
    wide: np.ndarray  # blocks in an item's window

    def own(self, vocabulary: np.ndarray) -> np.ndarray:
        """The place of each word of a larger vocabulary among the block's, -1 where it isn't one."""
        out = np.full(len(vocabulary), -1)
        out[np.searchsorted(vocabulary, self.hashes)] = np.arange(len(self.hashes))
        return out


def missing(n: int, share: float = min(LCS_FULL, LCS_PARAPHRASE)) -> int:
    """How many words of an item of ``n`` words a text with this share of it may lack; without a share, a text that judge() accepts."""
    return n - next(k for k in range(n + 1) if k / n >= share)


def window(n: int) -> int:
    """Blocks in the windows judged for an item of ``n`` words: three of the passages nearest to it in length and a block more, or its own length and two passages."""
    size = min(SIZES, key=lambda s: abs(np.log(s * BLOCK / n)))
    return max(3 * size + 1, -(-n // BLOCK) + 2 * size)


def telling_words(words: list[str], frequency: np.ndarray) -> np.ndarray:
    """Hashes of an item's rarest words, in order, as many as any text that passes the check needs to hold NEED of them."""
    hashes = hash_list(words)
    rarest = np.argsort(frequency[_cell(hashes)], kind="stable")[: missing(len(words)) + NEED]
    return hashes[np.isin(hashes, hashes[rarest])]


def make_query(items: list[tuple[object, str]], frequency: np.ndarray) -> Query | None:
    n = max(1, int(frequency[CELLS]))
    ids, words, chosen, spare = [], [], [], []
    for item, text in items:
        own = words_of(text)
        if not any(own):
            continue
        telling = telling_words(own, frequency)
        ids.append(item)
        words.append(own)
        chosen.append(telling)
        spare.append(len(telling) - missing(len(own)))  # a text that lacks all it may still holds so many
    if not ids:
        return None
    vocabulary = np.unique(np.concatenate(chosen))
    weights = np.sqrt(np.log((1 + n) / (1 + np.minimum(n, frequency[_cell(vocabulary)]))) + 0.1).astype(np.float32)
    rows = np.zeros((len(ids), len(vocabulary)), np.float32)
    bounds = np.zeros(len(ids))
    for r, hashes in enumerate(chosen):
        at = np.searchsorted(vocabulary, hashes)
        rows[r, at] = weights[at]
        bounds[r] = np.sort(weights[at].astype(np.float64) ** 2)[: spare[r]].sum()
    counts, answers = (np.zeros(rows.shape, np.int16) for _ in range(2))
    for r, (own, hashes) in enumerate(zip(words, chosen, strict=True)):
        np.add.at(counts[r], np.searchsorted(vocabulary, hashes), 1)
        answer = hash_list(own[-ANSWER_WORDS:])
        np.add.at(answers[r], np.searchsorted(vocabulary, answer[np.isin(answer, hashes)]), 1)
    return Query(ids, words, vocabulary, weights, rows, bounds, min(spare), counts, answers, np.array([window(len(w)) for w in words]))


def _find(vocabulary: np.ndarray, least: int):
    """Where telling words stand: (key, places, terms) of each document that has ``least`` of them."""
    table = np.zeros(1 << 16, bool)
    table[(vocabulary >> np.uint64(48)).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for chunk in ts.scan(batch.column("text"), lower=True):
                hashes = word_hashes(chunk)
                at = np.flatnonzero(table[(hashes >> np.uint64(48)).astype(np.int64)])
                term = np.minimum(np.searchsorted(vocabulary, hashes[at]), len(vocabulary) - 1)
                own = vocabulary[term] == hashes[at]
                at, term = at[own], term[own]
                row = chunk.row_of[at]
                counts = np.bincount(row, minlength=chunk.rows)
                own = np.flatnonzero(counts >= least)
                good = counts[row] >= least
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[own + chunk.first]), ts.long_lists((at - chunk.edges[row])[good].astype(np.int32), counts[own]), ts.long_lists(term[good].astype(np.int32), counts[own])],
                    ["key", "places", "terms"],
                )

    return run


HITS = "key long, places array<int>, terms array<int>"


def _multiply(block: np.ndarray, term: np.ndarray, dense: np.ndarray, n: int) -> np.ndarray:
    """Rows of the TF-IDF matrix, of a block each, times a dense matrix that has the words' weights in it; blocks are in order."""
    out = np.zeros((n, dense.shape[1]), np.float32)
    place = np.arange(len(block)) - np.searchsorted(block, block)
    for k in range(int(place.max(initial=-1)) + 1):  # the k-th entries of all blocks, BLOCK turns at most
        at = np.flatnonzero(place == k)
        out[block[at]] += dense[term[at]]
    return out


def _running(x: np.ndarray, step: int = 32) -> np.ndarray:
    """Sums of the first 0, 1, ... rows, in double precision; by steps, as np.cumsum is slow along columns."""
    n, wide = x.shape
    out = np.zeros((1 + -(-n // step) * step, wide))
    out[1 : n + 1] = x
    steps = out[1:].reshape(-1, step, wide)
    for k in range(1, step):
        steps[:, k] += steps[:, k - 1]
    for k in range(1, len(steps)):
        steps[k] += steps[k - 1, -1]
    return out


def _blocks(batch: pa.RecordBatch, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The documents' blocks up to their last telling word, one document after another: where each document begins, entries' block, entries' term.

    ``own`` is Query.own() of the vocabulary the batch was made with.
    """
    counts = batch.column("places").value_lengths().to_numpy().astype(np.int64)
    block = batch.column("places").flatten().to_numpy().astype(np.int64) // BLOCK
    term = own[batch.column("terms").flatten().to_numpy()]
    good = term >= 0
    if not good.all():
        row = np.repeat(np.arange(len(counts)), counts)[good]
        counts, block, term = np.bincount(row, minlength=len(counts)), block[good], term[good]
    n = np.zeros(len(counts), np.int64)
    n[counts > 0] = block[np.cumsum(counts)[counts > 0] - 1] + 1
    base = np.concatenate([[0], np.cumsum(n)])
    return base, np.repeat(base[:-1], counts) + block, term


def _by_pairs(batches: Iterator[pa.RecordBatch], weighed: np.ndarray, own_terms: np.ndarray) -> np.ndarray:
    """The rows, of two blocks each, times ``weighed`` and back, from a task's counts of words that stand in one row.

    The counts are the lower half of a square, exact, and multiplied with ``weighed`` once (or whenever they may overflow).
    """
    n = len(weighed)
    total = np.zeros(weighed.shape, np.float64)
    pairs, alone, done = np.zeros(n * (n + 1) // 2, np.int32), np.zeros(n), 0

    def multiplied() -> None:
        for a in range(0, n, 512):
            b = min(a + 512, n)
            part = np.zeros((b - a, b), np.float32)
            for r in range(a, b):
                part[r - a, : r + 1] = pairs[r * (r + 1) // 2 : (r + 1) * (r + 2) // 2]
            own = np.arange(a, b)
            twice = 2.0 * part[own - a, own] + alone[a:b]
            part[own - a, own] = 0
            total[a:b] += part @ weighed[:b] + twice[:, None] * weighed[a:b]
            total[:b] += part.T @ weighed[a:b]
        pairs[:], alone[:] = 0, 0

    for batch in batches:
        base, at, term = _blocks(batch, own_terms)
        head = np.zeros(base[-1] + 1, bool)  # whether a block is the first of its document, and so in one row only
        head[base] = True
        last = np.searchsorted(at, np.arange(1, base[-1] + 1))  # entries up to the end of each block
        after = np.where(head[1:], last, np.append(last[1:], len(at)))  # and of its row
        for a in range(0, len(at), 1 << 14):
            entry = np.arange(a, min(a + (1 << 14), len(at)))
            again = entry[~head[at[entry]]]
            alone += np.bincount(term[entry], minlength=n) + np.bincount(term[again], minlength=n)
            first = np.concatenate([entry, again])  # each entry with those after it in its row, and in the row that ends with its block
            size = np.concatenate([after[at[entry]], last[at[again]]]) - first - 1
            x = np.repeat(term[first], size)
            y = term[np.arange(size.sum()) + np.repeat(first + 1 - (np.cumsum(size) - size), size)]
            high = np.maximum(x, y)
            done += len(x)
            if done >= 2**31:
                multiplied()
                done = len(x)
            np.add.at(pairs, high * (high + 1) // 2 + np.minimum(x, y), np.int32(1))
    multiplied()
    return total


def _by_rows(batches: Iterator[pa.RecordBatch], weighed: np.ndarray, own_terms: np.ndarray) -> np.ndarray:
    """The same row by row, for so many words that their pairs can't be counted."""
    total = np.zeros(weighed.shape, np.float64)
    for batch in batches:
        base, at, term = _blocks(batch, own_terms)
        inner = np.ones(base[-1] + 1, np.float32)  # whether the block before is of the same document
        inner[base] = 0
        for a in range(0, base[-1], PIECE):
            b = min(a + PIECE, base[-1])
            lo, hi = np.searchsorted(at, [a, b + 1])
            y = _multiply(at[lo:hi] - a, term[lo:hi], weighed, b - a + 1)
            y[:-1] += y[1:] * inner[a + 1 : b + 1, None]
            y[-1] = 0  # the row of the next piece
            y[1:] += y[:-1] * inner[a + 1 : b + 1, None]
            order = np.argsort(term[lo:hi], kind="stable")
            t = term[lo:hi][order]
            starts = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else []
            for s in range(0, len(starts), 256):
                x, z = starts[s], starts[s + 256] if s + 256 < len(starts) else len(t)
                total[t[starts[s : s + 256]]] += np.add.reduceat(y[at[lo:hi][order[x:z]] - a], starts[s : s + 256] - x, axis=0)
    return total


def _gram(query: Query, dense: np.ndarray, own_terms: np.ndarray):
    """The task's rows, of two blocks each, times ``dense`` and back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(dense)
        form = _by_pairs if n * (n + 1) // 2 <= PAIRS else _by_rows
        total = form(batches, dense * query.weights[:, None], own_terms)
        yield from slices((total * query.weights[:, None]).ravel())

    return run


def latent(hits: DataFrame, query: Query, own_terms: np.ndarray | None = None, seed: int = 11, turns: int = 2) -> np.ndarray:
    """Leading right singular vectors (words, rank) of the passages of corpus and benchmark together."""
    own_terms = query.own(query.hashes) if own_terms is None else own_terms
    wide = min(len(query.hashes), len(query.ids) + SPARE)
    basis = np.random.default_rng(seed).normal(size=(len(query.hashes), wide)).astype(np.float32)
    emphasis = np.float32(EMPHASIS * max(1.0, np.sqrt(hits.count() / len(query.ids))))  # the few items weigh more than the many passages, so that they lie in the space whole
    own = query.rows * emphasis
    for turn in range(turns):
        total = summed(hits.mapInArrow(_gram(query, basis, own_terms), schema("double")), basis.size, np.float64, "double")
        image = own.T @ (own @ basis) + (0 if total is None else total.reshape(basis.shape))
        if turn + 1 < turns:
            basis = np.linalg.qr(image)[0].astype(np.float32)
    u, _, _ = np.linalg.svd(image, full_matrices=False)
    return u.astype(np.float32)


def _enough(query: Query):
    """Whether windows, as runs of entries, hold so many of an item's telling words, and of its answer's, that judge() may accept them."""
    n = np.array([len(w) for w in query.words])
    telling, known = query.counts.sum(1), query.answers.sum(1)
    full = telling - [missing(k, LCS_FULL) for k in n]
    part = telling - [missing(k, LCS_PARAPHRASE) for k in n]
    answer = known - [missing(min(k, ANSWER_WORDS), ANSWER) for k in n]

    def test(item: np.ndarray, lo: np.ndarray, hi: np.ndarray, term: np.ndarray) -> np.ndarray:
        size = hi - lo
        window = np.repeat(np.arange(len(item)), size)
        own = term[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + lo[window]]
        good = query.counts[item[window], own] > 0
        key, times = np.unique(window[good] * len(query.hashes) + own[good], return_counts=True)
        window, own = key // len(query.hashes), key % len(query.hashes)
        held = np.bincount(window, np.minimum(times, query.counts[item[window], own]), len(item))
        told = np.bincount(window, np.minimum(times, query.answers[item[window], own]), len(item))
        return (held >= full[item]) | ((held >= part[item]) & (told >= answer[item]))

    return test


def _search(query: Query, vectors: np.ndarray, own_terms: np.ndarray):
    """Candidates: (key, items, first and last block from which a window begins)."""
    target = query.rows @ vectors
    lost = np.linalg.norm(query.rows - target @ vectors.T, axis=1)
    # Items that lose more are looked up on their words: each is a direction of its own.
    direct = np.flatnonzero(lost > LOST * np.linalg.norm(query.rows, axis=1))
    own = np.zeros((len(target), len(direct)), np.float32)
    target[direct], lost[direct], own[direct, np.arange(len(direct))] = 0, 0, 1
    target = np.concatenate([target, own], axis=1)
    # What an item loses in the latent space may be in the window, at most as much as the window's length.
    # A window's projection times an item is one product of three matrices: the words' projections meet the items first.
    order = np.argsort(query.wide, kind="stable")
    score = (np.concatenate([vectors, query.rows[direct].T], axis=1) @ target[order].T + lost[order].astype(np.float32)) * query.weights[:, None]
    wides, firsts = np.unique(query.wide[order], return_index=True)
    groups = [(int(w), slice(a, b)) for w, a, b in zip(wides, firsts, [*firsts[1:], len(order)], strict=True)]
    least = query.bounds[order] * 0.999
    enough = _enough(query)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            base, at, term = _blocks(batch, own_terms)
            owner = np.repeat(np.arange(len(keys)), np.diff(base))
            out = []
            for a in range(0, base[-1], PIECE):
                starts = np.arange(a, min(a + PIECE, base[-1]))
                b = min(starts[-1] + int(query.wide.max()), base[-1])
                lo, hi = np.searchsorted(at, [a, b])
                sums = _running(_multiply(at[lo:hi] - a, term[lo:hi], score, b - a))
                for wide, own in groups:
                    items = order[own]
                    ends = np.minimum(starts + wide, base[owner[starts] + 1])
                    i, j = np.nonzero(sums[ends - a, own] - sums[: len(starts), own] >= least[own])
                    ranked = np.lexsort((i, j))
                    i, j = i[ranked], j[ranked]
                    good = enough(items[j], *np.searchsorted(at, [starts[i], ends[i]]), term)
                    j, i = j[good], i[good]
                    if len(i):  # windows that begin in neighbouring blocks are one candidate
                        doc = owner[starts[i]]
                        first = np.append(True, (j[1:] != j[:-1]) | (doc[1:] != doc[:-1]) | (i[1:] != i[:-1] + 1))
                        last = np.append(first[1:], True)
                        out.append((keys[doc[first]], items[j[first]], starts[i[first]] - base[doc[first]], starts[i[last]] - base[doc[last]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out]).astype(np.int64)) for k in range(4)], ["key", "item", "lo", "hi"])

    return run


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bits of one long integer."""
    masks: dict = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        m = masks.get(w, 0)
        if m:
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def judge(item: list, text: list) -> tuple[bool, float, float]:
    """Whether the text holds the item: verdict, share of the item in common, share of its answer."""
    share = lcs(item, text) / len(item)
    answer = item[-min(ANSWER_WORDS, len(item)) :]
    known = lcs(answer, text) / len(answer)
    return share >= LCS_FULL or (share >= LCS_PARAPHRASE and known >= ANSWER), share, known


def _check(items: dict[int, tuple[str, list[str], int]]):
    """(key, item, share, answer) of the items that a document's windows hold."""
    items = {k: (item, [w.encode() for w in words], wide) for k, (item, words, wide) in items.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"key": [], "item": [], "share": [], "answer": []}
            for key, text, spans in zip(batch.column("key").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                ranges, best = {(s["lo"] * BLOCK, (s["hi"] + items[s["item"]][2]) * BLOCK) for s in spans}, {}
                raw = (text or b"").split(None, max(hi for _, hi in ranges))  # bytes are split where _WORD splits
                words = [b""] * len(raw)  # only those of candidates are looked at
                for lo, hi in ranges:
                    words[lo:hi] = [w.lower().strip(_EDGE.encode()) for w in raw[lo:hi]]
                for s in spans:
                    _, item, wide = items[s["item"]]
                    if lcs(item, words[s["lo"] * BLOCK : (s["hi"] + wide) * BLOCK]) / len(item) < min(LCS_FULL, LCS_PARAPHRASE):
                        continue  # then no window in it has more
                    for b in range(s["lo"], s["hi"] + 1):
                        good, share, known = judge(item, words[b * BLOCK : (b + wide) * BLOCK])
                        if good and share > best.get(s["item"], (0, 0))[0]:
                            best[s["item"]] = (share, known)
                for number, (share, known) in best.items():
                    out["key"].append(key)
                    out["item"].append(items[number][0])
                    out["share"].append(share)
                    out["answer"].append(known)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["key"], pa.int64()), pa.array(out["item"], pa.string()), pa.array(out["share"], pa.float64()), pa.array(out["answer"], pa.float64())], list(out)
            )

    return run


_FOUND = "key long, item string, share double, answer double"


def _one_book(texts: DataFrame, items: list[tuple[object, str]], frequency: np.ndarray) -> DataFrame | None:
    """Matches of up to BOOK items."""
    queries = [items[a : a + ITEMS] for a in range(0, len(items), ITEMS)]
    kept, least = [], 0
    for block in queries:
        query = make_query(block, frequency)
        if query is not None:
            kept.append((block, query.hashes))
            least = min(least or query.least, query.least)
    if not kept:
        return None
    vocabulary = np.unique(np.concatenate([h for _, h in kept]))
    hits = stored(texts.mapInArrow(_find(vocabulary, least), HITS), "hits")
    spans, known = None, {}
    for number, (block, _) in enumerate(kept):
        query = make_query(block, frequency)
        own = query.own(vocabulary)
        found = hits.mapInArrow(_search(query, latent(hits, query, own), own), "key long, item long, lo long, hi long")
        found = found.withColumn("item", F.col("item") + number * ITEMS)
        known |= {number * ITEMS + k: (str(i), w, int(b)) for k, (i, w, b) in enumerate(zip(query.ids, query.words, query.wide, strict=True))}
        spans = stored(found, "found") if spans is None else spans.unionByName(stored(found, "found"))
    spans = stored(spans.groupBy("key").agg(F.collect_set(F.struct("item", "lo", "hi")).alias("spans")), "spans", [hits])
    # Spans of few bytes go to all executors; more are joined by a shuffle.
    few = small(spans, F.size("spans") * 24 + 16)
    checked = texts.join(F.broadcast(spans) if few else spans, "key").select("key", "text", "spans")
    return stored(checked.mapInArrow(_check(known), _FOUND), "matches")


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, item, share, answer): which documents hold which benchmark items."""
    spark: SparkSession = docs.sparkSession
    texts = docs.select(doc_key().alias("key"), F.col("text").cast("string").alias("text"))
    frequency = summed(texts.select("text").mapInArrow(_frequencies, schema("bigint")), CELLS + 1, np.int64, "bigint")
    frequency = np.zeros(CELLS + 1, np.int64) if frequency is None else frequency
    items = benchmark.filter("text is not null").select(F.col("item_id").alias("item"), F.col("text").cast("string").alias("text")).orderBy("item", "text")
    found, book = [], []
    for row in items.toLocalIterator():  # never more than a book at a time
        book.append((row["item"], row["text"]))
        if len(book) == BOOK:
            found.append(_one_book(texts, book, frequency))
            book = []
    found = [f for f in (*found, _one_book(texts, book, frequency)) if f is not None]
    if not found:
        return spark.createDataFrame([], _FOUND)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document that holds a benchmark item: doc_id, n_items, items, share of the item it holds most of.

    Rows that repeat a doc_id, null among them, give one row together.
    """
    per = matches(docs, benchmark).groupBy("key").agg(F.countDistinct("item").alias("n_items"), F.sort_array(F.collect_set("item")).alias("items"), F.max("share").alias("share"))
    return per.select(F.when(F.col("key") != LAST_ID, F.col("key")).alias("doc_id"), "n_items", F.array_join("items", ",").alias("items"), "share")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns."""
    bad = stored(matches(docs, benchmark).select(F.col("key").alias("__key")).distinct(), "contaminated")
    return docs.withColumn("__key", doc_key()).join(F.broadcast(bad) if small(bad, F.lit(16)) else bad, "__key", "left_anti").select(*docs.columns)
