import json

import corpus_pipeline
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from attesta.llm import decontaminate, queries
from attesta.llm.quality_rules import CURRENT, POLICIES, ledger
from attesta.llm.tokens import Encoder

from . import brute
from .test_dedup import corpus


def test_stages_against_plain_versions(spark, tmp_path):
    spell = str.maketrans("0123456789", "abcdefghij")
    rows = [(i, t and t.translate(spell)) for i, t in corpus(11, n=80, vocabulary=5000)]
    item = " ".join(f"b{k}" for k in range(30)).translate(spell)
    rows += [(500, " ".join(f"u{k}" for k in range(40)).translate(spell) + " " + item), (501, " ".join(f"z{k}" for k in range(45)).translate(spell))]
    pq.write_table(pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "lang": ["en"] * len(rows), "source": ["s"] * len(rows), "n_chars": [0] * len(rows)}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": [1], "text": [item]}), tmp_path / "benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    failed = {r["doc_id"]: r["failed"] for r in ledger(docs).collect()}
    left = [(i, t) for i, t in rows if not failed[i] & POLICIES[CURRENT]]
    before = dict(left)
    left = [(i, t) for i, t in brute.lines(left) if t == before[i] or brute.words(t)]
    left = [(i, t) for (i, t), (_, _, c) in zip(left, brute.components(left, 5, 80), strict=True) if i == c]
    target = decontaminate.words_of(item)
    left = [(i, t) for i, t in left if not decontaminate.judge(target, decontaminate.words_of(t))[0]]
    encoder = Encoder(queries.tokenizer_path())
    want = {i: len(encoder.tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in left}
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want
    assert 501 in got and 500 not in got


def test_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_join", "decontamination", "packing"]
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_on_small_tables(spark, name):
    frame = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert json.dumps(frame.columns) and frame.count() > 0
