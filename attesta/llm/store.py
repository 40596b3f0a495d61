"""Intermediate tables in the folder that all executors share, and joins that stand hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.session import new_place as place

#: Stands for a null doc_id inside operators: such a row comes after all others.
LAST_ID = 2**63 - 1
#: A key is hot if it holds more than this share of all rows, so there are never more hot keys than HOT_KEYS.
HOT_KEYS = 10_000
#: Bytes that may be sent to every executor.
BROADCAST_BYTES = 32 << 20


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Python workers of this session get at most ``rows`` texts at a time, as texts may be long."""
    have = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if have <= 0 or have > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def stored(df: DataFrame, name: str, done: list[DataFrame] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: later jobs start from there, and a lost executor costs only its own tasks.

    ``done`` names tables of this function that only ``df`` still needed; they are deleted.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = place(spark, name)
    df.write.parquet(path)
    for table in done or ():
        drop(spark, table)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by stored()."""
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def doc_key(name: str = "doc_id") -> Column:
    """doc_id as a non-null long."""
    return F.coalesce(F.col(name).cast("long"), F.lit(LAST_ID))


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, size: Column, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a stored table's rows of ``size`` bytes each are ``limit`` bytes at most together."""
    return (df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] or 0) <= limit


def split_join(rows: DataFrame, table: DataFrame, on: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with a table of one row a key, whose column ``count`` is the number of rows of that key (inner or left join).

    Keys with more than 1 / HOT_KEYS of the ``total`` rows are HOT_KEYS at most and go to the rows by broadcast;
    the others are joined by a shuffle, where none of them is large.  ``rows`` is read twice and should be a stored table.
    """
    bound = total // HOT_KEYS
    marked = rows.join(F.broadcast(table.filter(F.col(count) > bound).withColumn("__hot", F.lit(True))), on, "left")
    hot = marked.filter("__hot").drop("__hot")
    cold = marked.filter("__hot is null").select(*rows.columns).join(table.filter(F.col(count) <= bound), on, how)
    return hot.unionByName(cold.select(*hot.columns))
