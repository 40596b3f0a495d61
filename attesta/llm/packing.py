"""Packing: token sequences of bounded length, with little padding.

Every document is encoded and closed with an end id.  While it has a full
window of ids left, that window becomes a sequence of its own (a piece with no
padding at all); what remains, a piece shorter than a window, is packed by
best-fit decreasing: pieces in falling order of length, each into the open
sequence with the least room that still holds it.  The tightest open sequence
is found in a segment tree over remaining capacities, whose leaf c counts the
open sequences with room for c ids: the first non-empty leaf at or after the
length of the piece is one walk up and one down.

Ids never move: a task that reads text returns only (document, start, length,
checksum) of pieces, which are written once, and the packing works on those.
Full windows need no packing and stay where they are.  The others are dealt by a
hash of their document to groups of about ``group_pieces``, each packed in one
task, so a group's memory doesn't depend on the size of the corpus, nor on the
length of its documents.  The hash spreads copies and hot sources evenly.

Null text is empty: one piece with the end id alone.  Rows that repeat a doc_id
are packed as separate documents with that id.  An empty table gives an empty
result.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import doc_key, stored
from .tokens import encoder, groups, little

SEQUENCE = 2048
END_ID = 1
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
FULL = 1 << 62  # sequences of one full window are numbered from here, those of a group below


class RoomTree:
    """Segment tree over the capacities 0..size: how many open sequences have exactly that room."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, by: int) -> None:
        i = self.leaves + room
        while i:
            self.count[i] += by
            i >>= 1

    def tightest(self, need: int) -> int | None:
        """The least room of at least ``need`` that an open sequence has."""
        i, count = self.leaves + need, self.count
        if not count[i]:
            while i and (i & 1 or not count[i + 1]):  # up, until a subtree to the right has something
                i >>= 1
                if i <= 1:
                    return None
            i += 1
            while i < self.leaves:  # down to its first leaf
                i = 2 * i if count[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit_decreasing(lengths: list[int], capacity: int = SEQUENCE) -> tuple[list[int], list[int]]:
    """For each length, in falling order: the number of its sequence, and its offset there."""
    tree, open_at, sequence, offset, made = RoomTree(capacity), {}, [], [], 0
    for length in lengths:
        room = tree.tightest(length)
        if room is None:
            here, room, made = made, capacity, made + 1
        else:
            here = open_at[room].pop()
            tree.add(room, -1)
        sequence.append(here)
        offset.append(capacity - room)
        if room > length:
            open_at.setdefault(room - length, []).append(here)
            tree.add(room - length, 1)
    return sequence, offset


def _pieces(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            at, start, length, crc, total = [], [], [], [], []
            for i, ids in enumerate(x for part in groups(batch.column("text").to_pylist()) for x in encode(part)):
                raw = memoryview(little(ids) + end)
                n = len(raw) // 4
                for a in range(0, n, capacity):
                    b = min(n, a + capacity)
                    at.append(i)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(raw[4 * a : 4 * b]))
                    total.append(n)
            long = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(long(at)), batch.column("key").take(long(at)), long(start), long(length), long(crc), long(total)],
                ["doc_id", "key", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return run


def _fill(capacity: int):
    """Pack the groups of a partition, which come one after another."""

    def group(table: pa.Table) -> pa.RecordBatch:
        length = table.column("length").to_numpy()
        order = np.lexsort((table.column("ids_crc32").to_numpy(), table.column("start").to_numpy(), table.column("key").to_numpy(), -length))
        table = table.take(pa.array(order))
        lengths = length[order].tolist()
        sequence, offset = best_fit_decreasing(lengths, capacity)
        ids = table.column("part").to_numpy().astype(np.int64) << 32 | np.array(sequence, np.int64)
        out = table.select(COLUMNS).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset, pa.int64()))
        return out.combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            part = table.column("part").to_numpy()
            cuts = np.flatnonzero(np.diff(part)) + 1
            for a, b in zip([0, *cuts[:-1]], cuts, strict=False):
                yield group(table.slice(a, b - a))
            if len(cuts):
                held = table.slice(cuts[-1]).combine_chunks().to_batches()
        if held:
            yield group(pa.Table.from_batches(held))

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = SEQUENCE, end_id: int = END_ID, group_pieces: int = 50_000) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc_key().alias("key"), F.col("text").cast("string").alias("text"))
    pieces = stored(texts.mapInArrow(_pieces(tokenizer, capacity, end_id), "doc_id long, key long, start long, length long, ids_crc32 long, doc_tokens long"), "pieces")
    full = pieces.filter(F.col("length") == capacity).select(*COLUMNS, (F.lit(FULL) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group_pieces))
    part = F.pmod(F.xxhash64("key", "doc_tokens", "start"), F.lit(groups)).cast("int")
    dealt = rest.withColumn("part", part).repartition(groups, "part").sortWithinPartitions("part")
    return full.unionByName(dealt.mapInArrow(_fill(capacity), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"))
