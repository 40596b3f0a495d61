"""The corpus pipeline: stages over documents, each written to storage before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attesta.llm.decontaminate import drop_contaminated
from attesta.llm.line_dedup import dedup_lines
from attesta.llm.ngram_join import keep_first
from attesta.llm.packing import pack
from attesta.llm.quality_rules import apply_policy
from attesta.llm.queries import table, tokenizer_path
from attesta.llm.store import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current quality policy."""
    return apply_policy(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line repeats; those left without a word go."""
    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group whose sets of five-word shingles are at least 80 % alike."""
    return keep_first(docs, shingle=5, threshold=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences of 2048 tokens."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_join", near_duplicates),
    ("decontamination", decontaminate),
    ("packing", packing),
]

#: SQL can't express the tokenizer of the last stage; the pipeline is tested against a plain Python version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage wrote goes once the next one has written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name, before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
