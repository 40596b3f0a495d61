"""Sessions as streams: trust carried between documents, expiry by idle time, and sinks that write a batch once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EDGES = "session_id long, case_id long, prior_id long"


def _carry(idle_ms: int | None):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        prior = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["created_at", "case_id"])
        out = []
        for case, verified in zip(rows["case_id"], rows["verified"], strict=True):
            if prior is not None:
                out.append((key[0], case, prior))
            if verified:
                prior = int(case)
        if prior is not None:
            state.update((prior,))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["session_id", "case_id", "prior_id"]).astype("int64")

    return run


def session_edges(stream: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Edges from each document to the latest verified one before it in its session, as documents arrive.

    stream: (session_id, case_id, created_at, verified). The state of a session is one id; it
    goes once the session has been idle for ``idle_ms`` of processing time.  A late prior is never applied to documents already seen.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return stream.groupBy("session_id").applyInPandasWithState(_carry(idle_ms), EDGES, "prior long", "append", timeout)


def sessions(stream: DataFrame, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Activity of each user in sessions that end after a gap, on event time with a watermark."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is available and stop; each batch is written to its own folder, so a repeated batch replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    conf, name = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")  # a state that can time out would ask for one batch after the other
    try:
        query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        conf.set(name, before)


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table (file or folder) as a stream of its files."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")  # a stream watches a folder: this one for the one name
    return reader.option("pathGlobFilter", name).parquet(folder)


def alive(items: DataFrame, now: F.Column, ttl_seconds: int) -> DataFrame:
    """Pending items with a flag; an item is gone once it is older than the limit, strictly."""
    age = F.unix_micros(now) - F.unix_micros(F.col("created_at").cast("timestamp"))
    return items.withColumn("alive", age <= F.lit(ttl_seconds * 1_000_000))


def fold(messages: DataFrame) -> DataFrame:
    """What a client shows of a case's messages: signals in order, the last findings and the last verdict."""
    kind = F.col("type")
    signals = F.array_sort(F.collect_list(F.when(kind == "signal", F.struct("seq", "payload"))))
    last = lambda k: F.max_by(F.when(kind == k, F.col("payload")), F.when(kind == k, F.col("seq")))
    return messages.groupBy("case_id").agg(F.size(signals).alias("n_signals"), last("findings").alias("findings"), last("verdict").alias("verdict"))
