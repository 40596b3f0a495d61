"""Token-ID output: ORC files of token ids in document order.

The files hold one row a document: doc_id, n_tokens and the ids as an integer
array, which ORC packs by run-length encoding.  Row indexes and Bloom filters on
doc_id let a reader skip stripes and row groups by their metadata, and large
files can be read stripe by stripe in parallel.  Rows are range-partitioned and
sorted by doc_id before they are encoded, so file k holds smaller ids than file
k + 1, and min/max statistics of doc_id prune well.  How many files there are
follows from the bytes of text.

Null text is empty: a document with the end id alone.  A null doc_id comes after
all others.  Rows that repeat a doc_id stay separate rows, ordered by text.  An
empty table gives files without rows.  Columns other than doc_id and text are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import doc_key, place
from .tokens import encoder, groups, little

END_ID = 0
FILE_BYTES = 32 << 20
FEW_BYTES = 4 << 20
ORC = {
    "compression": "lz4",
    "orc.stripe.size": str(16 << 20),
    "orc.row.index.stride": "10000",
    "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
SCHEMA = "doc_id long, n_tokens long, ids array<int>"


def _encode(path: str, end_id: int, limit: int = 600_000):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            first = 0
            for part in groups(batch.column("text").to_pylist(), limit):
                raw = [little(ids) + end for ids in encode(part)]
                counts = np.array([len(x) // 4 for x in raw], np.int64)
                edges = np.concatenate([[0], counts.cumsum()]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.frombuffer(b"".join(raw), "<i4")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(raw)), pa.array(counts), ids], ["doc_id", "n_tokens", "ids"])
                first += len(raw)

    return run


def file_count(texts: DataFrame, file_bytes: int) -> int:
    """Files of about ``file_bytes`` of text; smaller ones, down to FEW_BYTES, where cores would be idle otherwise."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    return max(1, -(-size // file_bytes), min(texts.sparkSession.sparkContext.defaultParallelism * 2, -(-size // FEW_BYTES)))


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, files: int | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Write the ids of every document as ORC files under ``path``, in ascending doc_id order."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = texts.repartitionByRange(files or file_count(texts, file_bytes), F.col("doc_id").asc_nulls_last()).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "text")
    ordered.mapInArrow(_encode(tokenizer, end_id), SCHEMA).write.options(**ORC).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files as (doc_id, n_tokens, ids); filters on doc_id reach the files' indexes."""
    return spark.read.schema(SCHEMA).orc(path)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        edges = ids.offsets.to_numpy().astype(np.int64)
        raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False))).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(edges)), pa.array(crc, pa.int64()), batch.column("file"), batch.column("block"), batch.column("row")],
            ["doc_id", "n_tokens", "ids_crc32", "file", "block", "row"],
        )


def summary(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The running sum is taken file by file; only one total a file is summed in one place.
    """
    rows = spark.read.schema(SCHEMA).orc(path).select(
        "doc_id",
        "ids",
        # part-00012-...: the number is the file's rank by doc_id
        F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("int").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = rows.mapInArrow(_sums, "doc_id long, n_tokens long, ids_crc32 long, file int, block long, row long")
    totals = spark.read.schema(SCHEMA).orc(path).groupBy(F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("int").alias("file")).agg(F.sum("n_tokens").alias("total"))
    before = totals.select("file", (F.sum("total").over(Window.orderBy("file")) - F.col("total")).alias("before"))
    running = F.sum("n_tokens").over(Window.partitionBy("file").orderBy(doc_key(), "block", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        rows.withColumn("running", running)
        .join(F.broadcast(before), "file")  # one row a file
        .select("doc_id", (F.col("before") + F.col("running") - F.col("n_tokens")).cast("long").alias("start"), "n_tokens", "ids_crc32")
    )


def token_summary(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write the token files to the shared folder, and summarise them as read back."""
    path = place(docs.sparkSession, "tokens")
    write_token_files(docs, tokenizer, path, end_id)
    return summary(docs.sparkSession, path)
