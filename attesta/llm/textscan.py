"""Vectorised scanning of text columns: words, word hashes and rolling hashes.

A word is a maximal run of bytes other than space and 0x09-0x0D, which for
UTF-8 is the same as the regular expression ``[^\\x20\\x09-\\x0D]+``.  Arrow
string columns are scanned as one byte array, in chunks of a few MB, so a
worker's memory doesn't depend on the size of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_NONSPACE = ~_SPACE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:  # doubling: base**(done..2*done) from base**(0..done)
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 2**64))
        done += step
    return out


class _Tables:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    up = _powers(_BASE, 1 << 12)
    down = _powers(_INVERSE, 1 << 12)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            size = 1 << (n - 1).bit_length()
            cls.up, cls.down = _powers(_BASE, size), _powers(_INVERSE, size)
        return cls.up, cls.down


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order-dependent hash of values[start:end] for each range; equal ranges hash equally wherever they stand."""
    up, down = _Tables.get(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    out = (total[ends] - total[starts]) * down[starts]
    out += (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mix(out)


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    starts = np.arange(n)
    return range_hash(values, starts, starts + width)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[:n], values[width - have : width - have + n])


@dataclass
class Chunk:
    """Words of the rows ``first`` to ``first + rows`` of a batch."""

    first: int
    rows: int
    data: np.ndarray  # bytes of the rows
    bounds: np.ndarray  # row i has bytes bounds[i]:bounds[i + 1]
    starts: np.ndarray  # of words, in data
    ends: np.ndarray
    edges: np.ndarray  # row i has words edges[i]:edges[i + 1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.edges)

    @property
    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return range_hash(_BYTE[self.data], self.starts, self.ends)

    def inside(self, width: int) -> np.ndarray:
        """Whether the run of ``width`` words from each word on ends in the same row."""
        n = max(0, len(self.starts) - width + 1)
        last = np.repeat(self.edges[1:], self.counts)
        return np.arange(n) + width <= last[:n]

    def words(self, row: int, keep: np.ndarray | None = None) -> list[bytes]:
        """The words of a row as bytes, or those that ``keep`` marks."""
        a, b = self.edges[row], self.edges[row + 1]
        s, e = self.starts[a:b], self.ends[a:b]
        if keep is not None:
            s, e = s[keep], e[keep]
        if not len(s):
            return []
        base = int(s[0])
        raw = self.data[base : int(e[-1])].tobytes()
        return [raw[i:j] for i, j in zip((s - base).tolist(), (e - base).tolist(), strict=True)]


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row bounds of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, bounds


def split_rows(bounds: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes; a longer row stands alone."""
    at, n = 0, len(bounds) - 1
    while at < n:
        to = int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to
        at = to


def scan(column: pa.Array, lower: bool = False, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The words of a string column; ``lower`` turns A-Z into a-z first."""
    raw, bounds = strings(column)
    for at, to in split_rows(bounds, limit):
        data = raw[bounds[at] : bounds[to]]
        data = _LOWER[data] if lower else data
        own = bounds[at : to + 1] - bounds[at]
        yield Chunk(at, to - at, data, own, *_words(data, own))


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(bounds), np.int64)
    full = _NONSPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, full[:-1]
    cut = bounds[1:-1]
    before[cut[cut < n]] = False
    starts = np.flatnonzero(full & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, full[1:]
    after[cut[cut > 0] - 1] = False
    ends = np.flatnonzero(full & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def fingerprints(hashes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One hash of each row's whole sequence of word hashes, as a signed long."""
    return range_hash(hashes, edges[:-1], edges[1:]).view(np.int64)


def long_lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive values as an Arrow list column with ``counts`` values a row."""
    edges = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=edges[1:])
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(values))
