"""Quality rules: a ledger of failure bits, and policies over it.

The ledger is made once and stored: one scan measures each whole text, and every
rule is evaluated on the measurements and leaves one bit in ``failed``.  A policy is a
version name and a mask of the rules that reject; applying one, or comparing
many, is integer arithmetic on the ledger and never reads a text again.
Ablations come from one bitwise aggregation: for each rule, how many documents
it fails, how many it alone fails, and how many a policy without it would keep.

Null text has no words and fails the rule on length.  Rows that repeat are
judged alike.  An empty table gives an empty ledger.  All columns but doc_id and
text are ignored by the ledger; apply_policy keeps every column of its input.  It
evaluates the same bits on the rows as they pass, because looking texts up in a
stored ledger would shuffle them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textscan as ts
from .measures import NAMES, measure
from .store import stored

#: (rule, SQL condition of failure over the measurements). The position is the bit; rules are only ever appended.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 20 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("shouting", "100 * n_upper > 60 * n_letters and n_letters > 0"),
    ("exclamations", "100 * n_shouts > 40 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 30 * n_words"),
    ("digits", "100 * n_digits > 50 * word_chars"),
]
BIT = {name: i for i, (name, _) in enumerate(RULES)}


def mask(*rules: str) -> int:
    return sum(1 << BIT[r] for r in rules)


BASE = mask("few_words", "repeated_windows")
#: Versions stay as they are once published.
POLICIES: dict[str, int] = {
    "base": BASE,
    "v1": BASE | mask("symbols", "repeated_lines", "shouting", "exclamations"),
    "v2": (1 << len(RULES)) - 1,
}
CURRENT = "v2"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in ts.scan(batch.column("text")):
            found = measure(chunk, chunk.hashes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(chunk.first, chunk.rows), *(pa.array(found[:, i]) for i in range(len(NAMES)))],
                ["doc_id", *NAMES],
            )


def failure_bits() -> Column:
    """All rules as one long; bit i is set if rule i fails."""
    total = F.lit(0).cast("long")
    for i, (_, condition) in enumerate(RULES):
        total = total.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return total


def ledger(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, the measurements, and failed (bits)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"{n} long" for n in ["doc_id", *NAMES])
    return texts.mapInArrow(_scan, schema).withColumn("failed", failure_bits())


def kept(policy: str = CURRENT) -> Column:
    """Whether a row of the ledger passes a policy."""
    return F.col("failed").bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablation(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of a policy: documents it fails, documents no other rule of the policy fails, and documents kept without it."""
    chosen = POLICIES[policy]
    bits = [(name, i) for name, i in BIT.items() if chosen >> i & 1]
    hit = F.col("failed").bitwiseAND(F.lit(chosen))
    sums = [F.count_if(hit == 0).alias("kept")]
    for name, i in bits:
        sums += [F.count_if(hit.bitwiseAND(F.lit(1 << i)) != 0).alias(f"fails_{name}"), F.count_if(hit == (1 << i)).alias(f"alone_{name}")]
    cells = ", ".join(f"'{name}', fails_{name}, alone_{name}, kept + alone_{name}" for name, _ in bits)
    return rows.agg(*sums).selectExpr(f"stack({len(bits)}, {cells}) as (rule, n_failed, n_failed_alone, n_kept_without)")


def _mark(names: list[str]):
    """The same scan, in place: adds the measurements to whole rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in ts.scan(batch.column("text").cast(pa.string())):
                found = measure(chunk, chunk.hashes())
                part = batch.slice(chunk.first, chunk.rows)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(found[:, i]) for i in range(len(names)))], [*part.schema.names, *names])

    return run


def apply_policy(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows of docs that pass a policy, with all their columns."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, T.LongType()) for n in NAMES)])
    marked = rows.mapInArrow(_mark(NAMES), schema).withColumn("failed", failure_bits())
    return marked.filter(kept(policy)).select("row.*")


def sole_failure(policy: str = CURRENT) -> Column:
    """The bit of the one rule that rejects a row of the ledger under a policy; 0 if none or several do.

    A policy without that rule would keep the row, so counts of this column are the policy's ablation.
    """
    hit = F.col("failed").bitwiseAND(F.lit(POLICIES[policy]))
    return F.when(F.bit_count(hit) == 1, hit).otherwise(F.lit(0)).cast("long")


def quality_rules(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed, kept_<version> of the other policies, sole_failure; read from the stored ledger."""
    book = stored(ledger(docs), "ledger")
    others = [kept(p).alias(f"kept_{p}") for p in POLICIES if p != policy]
    return book.select("doc_id", *NAMES[:5], (~kept("base")).alias("base_failed"), kept(policy).alias("kept"), "failed", *others, sole_failure(policy).alias("sole_failure"))
