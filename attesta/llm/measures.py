"""Measurements of whole texts, made in one scan."""

from __future__ import annotations

import numpy as np

from . import textscan as ts

REPEAT_WORDS = 8

#: Kinds of bytes. A code point is counted at its first byte, so continuation bytes are a kind of their own.
INNER, OTHER, LOWER, UPPER, DIGIT, SYMBOL, SHOUT, PIPE, WIDE, SPACE, LINE = range(11)
KINDS = 11

_KIND = np.full(256, OTHER, np.uint8)
_KIND[0x80:0xC0] = INNER
_KIND[0xC0:] = WIDE
_KIND[ord("a") : ord("z") + 1] = LOWER
_KIND[ord("A") : ord("Z") + 1] = UPPER
_KIND[ord("0") : ord("9") + 1] = DIGIT
_KIND[[ord(c) for c in "#*$%&<>"]] = SYMBOL
_KIND[ord("|")] = PIPE
_KIND[ord("!")] = SHOUT
_KIND[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = SPACE
_KIND[0x0A] = LINE

NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_shouts"]


def kinds(chunk: ts.Chunk) -> np.ndarray:
    """Bytes of each kind in each row."""
    kind = _KIND[chunk.data]
    bounds = chunk.bounds.tolist()
    return np.array([np.bincount(kind[a:b], minlength=KINDS) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]).reshape(-1, KINDS)


def lines(chunk: ts.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them that equal an earlier line, in each row."""
    n, dup = np.zeros(chunk.rows, np.int64), np.zeros(chunk.rows, np.int64)
    raw, bounds = chunk.data.tobytes(), chunk.bounds.tolist()
    for r in range(chunk.rows):
        own = [x for x in raw[bounds[r] : bounds[r + 1]].split(b"\n") if x.strip()]
        n[r], dup[r] = len(own), len(own) - len(set(own))
    return n, dup


def repeated(chunk: ts.Chunk, hashes: np.ndarray, width: int = REPEAT_WORDS) -> np.ndarray:
    """Words in windows of ``width`` words that stand in the row twice or more."""
    marks = np.zeros(len(hashes) + 1, np.int64)
    inside = chunk.inside(width)
    at = np.flatnonzero(inside)
    if len(at):
        key = ts.mix(ts.rolling(hashes, width)[at] + chunk.row_of[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        starts = at[twice]
        np.add.at(marks, starts, 1)
        np.add.at(marks, starts + width, -1)
    covered = np.zeros(len(hashes) + 1, np.int64)
    np.cumsum(np.cumsum(marks[:-1]) > 0, out=covered[1:])
    return covered[chunk.edges[1:]] - covered[chunk.edges[:-1]]


def measure(chunk: ts.Chunk, hashes: np.ndarray) -> np.ndarray:
    """The measurements in NAMES, a row each."""
    k = kinds(chunk)
    n_lines, dup = lines(chunk)
    chars = k.sum(1) - k[:, INNER] - k[:, SPACE] - k[:, LINE]
    return np.stack(
        [chunk.counts, chars, k[:, SYMBOL] + k[:, PIPE], dup, repeated(chunk, hashes), n_lines, k[:, UPPER], k[:, LOWER] + k[:, UPPER] + k[:, WIDE], k[:, DIGIT], k[:, SHOUT]],
        1,
    ).astype(np.int64)
