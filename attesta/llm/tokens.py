"""Byte-level BPE ids of whole texts, as arrays of unsigned 32-bit integers.

The tokenizer cuts a text into pieces by a fixed pattern and encodes each piece
on its own.  Pieces recur, so some hundred KB of texts are cut together, equal
pieces are found by their hashes, and each piece is encoded once by the
tokenizers library; the ids of pieces that a Python worker has met before come
from a table of bounded size.  The pattern is applied here, on arrays of
code points, for texts whose characters all lie below U+0250; any other text
goes to the library whole, as does a text that holds the string of an added
token, which the library cuts out first.  So the ids are always those of the
tokenizer file as the library loads it.  Tests hold both ways against each other.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np

from . import textscan as ts

CACHE_PIECES = 600_000
PLAIN_BELOW = 0x250
LETTER, NUMBER, SPACE, REST = range(4)

_loaded: dict[str, Encoder] = {}


def _classes() -> np.ndarray:
    """Class of each plain character, as the pattern's \\p{L}, \\p{N} and \\s see it."""
    import regex

    out = np.full(PLAIN_BELOW, REST, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        match = regex.compile(pattern).fullmatch
        out[[c for c in range(PLAIN_BELOW) if match(chr(c))]] = kind
    return out


class Encoder:
    """Encodes texts with the tokenizer file at ``path``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.path = path
        self.classes = _classes()
        self.single = Tokenizer.from_file(path)
        # The library's own byte mapping without its pattern, for pieces that are cut already.
        self.single.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        self.rare = re.compile(f"[^\\u0000-\\u{PLAIN_BELOW - 1:04x}]")
        added = [re.escape(token.content) for token in self.single.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)) if added else None
        self.values = ts.mix(np.arange(PLAIN_BELOW, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        self.known = np.zeros(0, np.uint64)  # sorted hashes of pieces met before
        self.offset = np.zeros(0, np.int64)  # of their ids in self.flat
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    @cached_property
    def tokenizer(self):
        """The tokenizer as it is in the file; loaded for the first text that needs it."""
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.no_padding()
        out.no_truncation()
        return out

    def whole(self, texts: list[str]) -> list[array]:
        return [array("I", x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        """Encode new pieces, whose hashes are sorted."""
        ids = [x.ids for x in self.single.encode_batch_fast(pieces, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        offset = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))])
        at = np.searchsorted(self.known, hashes)
        self.known, self.offset, self.size = (np.insert(x, at, y) for x, y in ((self.known, hashes), (self.offset, offset), (self.size, size)))

    def forget(self) -> None:
        """Keep the pieces met first, which are the frequent ones."""
        keep = self.offset < np.partition(self.offset, CACHE_PIECES // 2)[CACHE_PIECES // 2]
        self.known, self.offset, self.size = self.known[keep], self.offset[keep], self.size[keep]
        self.flat = self.flat[: int((self.offset + self.size).max())]

    def cut(self, points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where pieces start, for texts that lie end to end in ``points`` (text i is bounds[i]:bounds[i + 1]).

        Letters, numbers and other characters form runs, and one blank before a run belongs to it.  Of a longer white
        space before a run, the last character stands alone (or is that blank), unless nothing follows it in its text.
        An apostrophe with s, t, m, d, re, ve or ll is a piece.
        """
        n = len(points)
        kind = self.classes[points]
        first = np.zeros(n + 3, bool)  # of a text
        first[bounds[bounds < n]] = True
        first[n:] = True
        start = first[:n].copy()
        start[1:] |= kind[1:] != kind[:-1]
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:n])  # white space right before a run
        start[last] = True
        start[last[points[last] == 0x20] + 1] = False
        quote = np.flatnonzero((points == 0x27) & start)
        if len(quote):
            ahead = np.concatenate([points, np.zeros(2, points.dtype)])
            one, two = ahead[quote + 1], ahead[quote + 2]
            near = ~first[quote + 1]
            short = near & np.isin(one, [ord(c) for c in "stmd"])
            pair = near & ~first[quote + 2] & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
            for hit, size in ((short, 1), (pair, 2)):
                at = quote[hit]
                start[at + 1] = False
                after = at + 1 + size
                after = after[after < n]
                start[after] = True
        return np.flatnonzero(start)

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        if not len(points):
            return [np.zeros(0, np.uint32)] * len(texts)
        if len(self.known) > CACHE_PIECES:
            self.forget()
        starts = self.cut(points, bounds)
        ends = np.append(starts[1:], len(points))
        hashes = ts.range_hash(self.values[points], starts, ends)
        distinct, where, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))
        new = np.flatnonzero(self.known[at] != distinct) if len(self.known) else np.arange(len(distinct))
        if len(new):
            a, b = starts[where[new]].tolist(), ends[where[new]].tolist()
            self.learn(distinct[new], list(map(joined.__getitem__, map(slice, a, b))))
            at = np.searchsorted(self.known, distinct)
        offset, size = self.offset[at], self.size[at]
        own = size[which]
        end = np.cumsum(own)
        ids = self.flat[np.arange(end[-1]) + np.repeat(offset[which] - (end - own), own)]
        edges = np.append(0, end)[np.searchsorted(starts, bounds)]
        return [ids[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]

    def _whole(self, text: str) -> bool:
        """Whether the library must cut the text."""
        return (not text.isascii() and self.rare.search(text) is not None) or (self.added is not None and self.added.search(text) is not None)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; give it some hundred KB of texts at a time."""
        rare = [self._whole(t) for t in texts]
        simple = iter(self.plain([t for t, r in zip(texts, rare, strict=True) if not r]))
        return [np.array(self.whole([t])[0], np.uint32) if r else next(simple) for t, r in zip(texts, rare, strict=True)]


def little(ids: np.ndarray) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return (ids if sys.byteorder == "little" else ids.byteswap()).tobytes()


def groups(texts: list[str | None], limit: int = 600_000) -> Iterator[list[str]]:
    """Consecutive texts, about ``limit`` characters at a time; null is empty."""
    held, size = [], 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size > limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file, made once."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
