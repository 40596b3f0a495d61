import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attesta.llm import packing, sharding, token_output
from attesta.llm.queries import tokenizer_path
from attesta.llm.tokens import PLAIN_BELOW, Encoder

ROWS = [
    (4, "Hello, it's a test of 123 things.\n\nNew  line "), (2, None), (9, ""), (1, "naïve café ÷ ½ µ"), (7, "中文 mixed \U0001f600 text"), (None, "no id"),
    (3, "hello <|endoftext|> x"), (8, " word" * 5000), (4, "Hello again"), (4, "Hello again"),
]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(tokenizer_path())


@pytest.fixture(scope="module")
def library():
    """The tokenizer as the library loads it, nothing set."""
    return Tokenizer.from_file(tokenizer_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pieces_equal_the_library(encoder, library):
    """Cutting here and cutting in the library give the same ids, for all plain characters and their neighbours."""
    rng = random.Random(3)
    parts = [" ", " ", "\n", "\t", "'", "s", "t", "re", "ve", "ll", "d", "m", "B", "é", "12", "²", "!", ".", "\x85", "\x1c", "\xa0", "'s", "'ll", "中"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    texts += [f"a{chr(c)}b {chr(c)}{chr(c)} 'x{chr(c)}" for c in range(PLAIN_BELOW)]
    for token in library.get_added_tokens_decoder().values():
        texts += [x + token.content + y for x in ("", "hello ", "a", "中") for y in ("", " x", "b", token.content, token.content[:-1])]
        texts += [token.content.upper(), token.content[1:], f"é {token.content}é"]
    for a in range(0, len(texts), 50):
        for got, text in zip(encoder(texts[a : a + 50]), texts[a : a + 50], strict=True):
            assert got.tolist() == ids_of(library, text), repr(text)


def test_forgetting(library, monkeypatch):
    monkeypatch.setattr("attesta.llm.tokens.CACHE_PIECES", 50)
    fresh = Encoder(tokenizer_path())
    rng = random.Random(5)
    for _ in range(30):
        texts = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(40)) for _ in range(3)]
        assert [x.tolist() for x in fresh(texts)] == [ids_of(library, t) for t in texts]


def test_packing(docs, library):
    rows = packing.pack(docs(ROWS), tokenizer_path(), group_pieces=3).collect()
    full = defaultdict(list)
    for i, t in ROWS:
        full[i].append([*ids_of(library, t), 1])
    assert sum(r["length"] for r in rows) == sum(len(x) for v in full.values() for x in v)
    sequences = defaultdict(list)
    for r in rows:
        wanted = [crc(x[r["start"] : r["start"] + r["length"]]) for x in full[r["doc_id"]] if len(x) == r["doc_tokens"]]
        assert r["ids_crc32"] in wanted
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(docs([]), tokenizer_path()).count() == 0


def test_best_fit_decreasing():
    rng = random.Random(0)
    lengths = sorted((rng.randint(1, 2048) for _ in range(400)), reverse=True)
    sequence, offset = packing.best_fit_decreasing(lengths)
    room, plain = [], []
    for n in lengths:  # the tightest open sequence, found by looking at all
        best = min((x for x in range(len(room)) if room[x] >= n), key=lambda x: room[x], default=None)
        if best is None:
            room.append(2048)
            best = len(room) - 1
        plain.append(2048 - room[best])
        room[best] -= n
    assert offset == plain and max(sequence) + 1 == len(room)


def test_token_files(spark, docs, library):
    rows = token_output.token_summary(docs(ROWS), tokenizer_path()).collect()
    at, want = 0, []
    for i, t in sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        ids = [*ids_of(library, t), 0]
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))
    assert token_output.token_summary(docs([]), tokenizer_path()).count() == 0


def test_token_files_prune(spark, docs, tmp_path):
    path = f"file://{tmp_path}/tokens"
    token_output.write_token_files(docs([(k, f"text {k}") for k in range(300)]), tokenizer_path(), path, files=3)
    frame = token_output.read_token_files(spark, path).filter("doc_id = 17")
    assert "EqualTo(doc_id,17)" in frame._jdf.queryExecution().toString()
    assert frame.count() == 1 and frame.first()["n_tokens"] == len(frame.first()["ids"])


def test_sharding(docs):
    rows = [(k % 50, "x" * (k % 7)) for k in range(333)] + [(None, None), (None, None), (5, "é")]
    got = sharding.shard(docs(rows)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots[k]) for k in range(16)]
    assert max(sizes) - min(sizes) <= 1
    assert {tuple(r) for r in got} == {tuple(r) for r in sharding.shard(docs(rows[::-1]).repartition(5)).collect()}
    assert sharding.shard(docs([])).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 4097])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 4)).collect()]
    assert sorted(got) == list(range(n)) and (n < 10 or got != list(range(n)))
