"""Sharding: a reproducible shuffle of all rows into shards, by DataFrame functions alone.

Every row gets a global row number, and a keyed permutation of the numbers
0..N-1 gives its place in the shuffle; ``place % shards`` is the shard and
``place div shards`` the slot in it.  So shard sizes differ by one row at most,
slots have no gaps, and the shard and slot of any row number can be computed
without looking at another row.

The permutation is a Feistel network on pairs (left, right) with left in
0..a-1 and right in 0..b-1, where a = ceil(sqrt(N)) and b = ceil(N / a).  Each
round adds a hash of one half to the other, modulo its own size, so the network
permutes the a*b pairs; a place of N or more (fewer than a of them exist) is
put through the network again until it is below N, which is cycle walking.

Row numbers come without a global sort: rows are dealt to buckets by a hash of
doc_id, numbered inside their bucket by (doc_id, size, checksum), and shifted
by the number of rows in the buckets before.  Neither the layout of the files
nor the number of tasks has any influence.

Null text has no bytes; null doc_ids are numbered first within one bucket;
equal rows get neighbouring numbers, and it makes no difference which gets
which.  An empty table gives an empty result.  All other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUNDS = 6
WALKS = 64
BUCKET_ROWS = 50_000
MAX_BUCKETS = 1 << 16


def permuted(number: Column, n: int, seed: int = 0) -> Column:
    """The place of row ``number`` (0..n-1) in the shuffle ``seed`` of n rows."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    b = max(1, -(-n // a))

    def network(x: Column) -> Column:
        right = F.pmod(x, F.lit(b).cast("long"))
        pair = F.struct(F.expr("0L").alias("l"), right.alias("r")).withField("l", ((x - right) / F.lit(b)).cast("long"))

        def turn(acc: Column, k: Column) -> Column:
            left, right = acc["l"], acc["r"]
            even = k % 2 == 0
            add_left = F.pmod(left + F.pmod(F.xxhash64(F.lit(seed), k, right), F.lit(a)), F.lit(a))
            add_right = F.pmod(right + F.pmod(F.xxhash64(F.lit(seed), k, left), F.lit(b)), F.lit(b))
            return F.struct(F.when(even, add_left).otherwise(left).alias("l"), F.when(even, right).otherwise(add_right).alias("r"))

        return F.aggregate(F.array(*(F.lit(k) for k in range(ROUNDS))), pair, turn, lambda p: p["l"] * F.lit(b) + p["r"])

    def walk(x: Column) -> Column:
        again = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), x, lambda acc, _: F.when(acc < n, acc).otherwise(network(acc)))
        return F.when(again < n, again).otherwise(F.raise_error(F.lit("the permutation did not come back into range")).cast("long"))

    once = network(number.cast("long"))
    return F.when(once < n, once).otherwise(walk(once))


def numbered(rows: DataFrame, key: str, ties: list[str], n: int) -> DataFrame:
    """Add row_number: 0..n-1, each once, the same in every run; nothing is sorted beyond a bucket."""
    buckets = min(MAX_BUCKETS, max(16, n // BUCKET_ROWS))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(F.coalesce(F.col(key), F.lit(0))), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("rows"))
    # One row for each of at most MAX_BUCKETS buckets.
    before = sizes.select("bucket", (F.sum("rows").over(Window.orderBy("bucket")) - F.col("rows")).alias("before"))
    inside = dealt.withColumn("inside", F.row_number().over(Window.partitionBy("bucket").orderBy(key, *ties)))
    return inside.join(F.broadcast(before), "bucket").withColumn("row_number", F.col("before") + F.col("inside") - 1).drop("bucket", "before", "inside")


def shard(docs: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """Per row of docs: doc_id, size, text_crc32, law 'rows', shard, slot, grown_shard (null), row_number.

    Only ids, sizes and checksums are shuffled, never texts.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    n = docs.count()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    placed = numbered(slim, "doc_id", ["size", "text_crc32"], n).withColumn("place", permuted(F.col("row_number"), max(1, n), seed))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("place", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("place") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )
