import random
import time

import numpy as np
import pyarrow as pa
import pytest

from attesta.llm import line_dedup, ngram_join, prefix_trie, store, substring_dedup, suffix_tree
from attesta.llm import textscan as ts
from attesta.llm.components import components
from attesta.llm.prefix_trie import Forest, search

from . import brute


def corpus(seed, n=60, vocabulary=400):
    """Texts with copies, near copies, shared passages, repeated lines, nulls and odd white space."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, vocabulary)}é" if rng.random() < 0.2 else f"w{rng.randint(0, vocabulary)}"
    shared = [[word() for _ in range(70)] for _ in range(3)]
    boiler = [" ".join(word() for _ in range(12)) for _ in range(4)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.2 and texts:
            texts.append(rng.choice(texts))
        elif kind < 0.5 and texts:
            w = (rng.choice(texts) or "x").split(" ")
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
        else:
            w = [word() for _ in range(rng.choice([0, 1, 2, 30, 49, 50, 51, 160]))]
            if rng.random() < 0.5:
                at = rng.randint(0, len(w))
                w[at:at] = rng.choice(shared)
            t = " ".join(x + ("\n" if rng.random() < 0.08 else "") for x in w)
            if rng.random() < 0.5:
                t += "\n" + rng.choice(boiler)
            texts.append(t)
    texts += [None, "", "  \t \n", "one", "A\x0bB\x0cC\rD", "   x", " ".join(["again"] * 300), shared[0][0] + "\n" * 5]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("limit", [1 << 19, 400, 1])
def test_substrings(spark, docs, limit):
    rows = corpus(1) + [(None, "last " * 60), (None, "last " * 60), (3, "same id " * 40), (3, "same id " * 40)]
    got = substring_dedup.dedup_substrings(docs(rows), part_words=limit).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute.substrings(rows)))


def test_substrings_empty(docs):
    assert substring_dedup.dedup_substrings(docs([])).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_earlier_repeats(seed):
    """Small alphabets give deep and periodic trees; what the repeats cover is what equal windows of lesser owners cover."""
    rng = random.Random(seed)
    rows = [[rng.randint(0, seed % 3) for _ in range(rng.randint(0, 30))] for _ in range(rng.randint(0, 9))]
    rows += [rng.choice(rows) for _ in range(2)] if rows else []
    owner = np.array([rng.randint(0, 5) for _ in rows], np.int64)
    edges = np.cumsum([0, *map(len, rows)])
    floor = rng.randint(1, 6)
    values = np.array([v for r in rows for v in r], np.uint64)
    at, length = suffix_tree.earlier_repeats(values, edges, owner, floor)
    got = set()
    for a, n in zip(at.tolist(), length.tolist(), strict=True):
        r = int(np.searchsorted(edges, a, "right")) - 1
        piece = rows[r][a - edges[r] : a - edges[r] + n]
        # a real repeat of a lesser owner, and of whole depth: no lesser owner agrees for one value more
        longer = rows[r][a - edges[r] : a - edges[r] + n + 1]
        holds = lambda p: any(o < owner[r] and any(x[k : k + len(p)] == p for k in range(len(x) - len(p) + 1)) for x, o in zip(rows, owner, strict=True))  # noqa: B023, E731
        assert n >= floor and len(piece) == n and holds(piece) and (len(longer) == n or not holds(longer))
        got |= set(range(a, a + n))
    first = {}
    for x, o in zip(rows, owner, strict=True):
        for k in range(len(x) - floor + 1):
            first[tuple(x[k : k + floor])] = min(o, first.get(tuple(x[k : k + floor]), 99))
    want = {int(edges[r]) + k + j for r, x in enumerate(rows) for k in range(len(x) - floor + 1) if first[tuple(x[k : k + floor])] < owner[r] for j in range(floor)}
    assert got == want


def test_common_prefixes():
    values, edges = np.array([7, 8, 9, 7, 8, 7, 8, 9, 9], np.uint64), np.array([0, 3, 5, 9])
    ends = np.repeat(edges[1:], np.diff(edges))
    levels = suffix_tree.ranks(values, ends)
    assert suffix_tree.common_prefixes(levels, ends, np.array([3, 1, 2, 0]), np.array([5, 7, 7, 4])).tolist() == [2, 0, 1, 0]


@pytest.mark.parametrize("seed", [2, 3])
def test_lines(docs, seed):
    rows = corpus(seed)
    got = line_dedup.dedup_lines(docs(rows), drop_emptied=False).select("doc_id", "text").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute.lines(rows)))


def test_lines_template(docs):
    """Many lines that differ in one word only: the first stays."""
    body = "order number {} was shipped on the third of may to you"
    rows = [(i, f"{body.format(i)}\nline {i} {i * 7} of its own with words enough {i}") for i in range(40)]
    left = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(rows)).collect()}
    assert left[0] == rows[0][1] and all(body.format(i) not in left[i] for i in range(1, 40))


def test_lines_keep_columns(docs):
    frame = docs([(1, "a b"), (2, "a b"), (3, None), (4, "")])
    out = line_dedup.dedup_lines(frame)
    assert out.columns == frame.columns
    assert {(r["doc_id"], r["text"]) for r in out.collect()} == {(1, "a b"), (3, None), (4, "")}
    assert line_dedup.dedup_lines(docs([])).count() == 0


@pytest.mark.parametrize(("a", "b"), [("abc", "abc"), ("abc", "abd"), ("abc", "ab"), ("abc", "xabc"), ("abc", "axbc"), ("abc", "acb"), ("", "a"), ("abcd", "ab"), ("aab", "ab")])
def test_neighbourhood(a, b):
    """Lines within one edit meet in a key, and in the segment that may differ."""
    left, right = (np.array([ord(c) for c in x], np.uint64) for x in (a, b))
    assert line_dedup.within_one_edit(left, right) == brute.edits(list(a), list(b))
    if len(a) > 2 and len(b) > 2 and a != b:
        met = bool(set(line_dedup.signatures(left).tolist()) & set(line_dedup.signatures(right).tolist()))
        assert met or not brute.edits(list(a), list(b))


@pytest.mark.parametrize(("width", "threshold", "seed"), [(3, 90, 4), (5, 80, 5), (3, 60, 6)])
def test_components(docs, width, threshold, seed):
    rows = corpus(seed, n=90, vocabulary=60) + [(None, "null id here"), (7, "twice the same id"), (7, "twice the same id")]
    got = ngram_join.ngram_components(docs(rows), width, threshold).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute.components(rows, width, threshold)))


def test_components_of_near_copies(docs, monkeypatch):
    """One large group of near copies, in blocks, is tied along a tree."""
    monkeypatch.setattr(ngram_join, "BLOCK", 20 * 128)
    rng = random.Random(8)
    base = [f"v{k}" for k in range(200)]
    rows = []
    for i in range(120):
        w = list(base)
        w[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(w)))
    assert sorted(map(tuple, ngram_join.ngram_components(docs(rows)).collect())) == sorted(brute.components(rows))


def test_keep_first(docs):
    frame = docs([(5, "a b c d e f"), (2, "a b c d e f"), (9, None), (1, "q r s t u v w"), (None, "a b c d e f")])
    out = ngram_join.keep_first(frame)
    assert out.columns == frame.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 2, 9]
    assert ngram_join.ngram_components(docs([])).count() == 0


def paths_of(sets, threshold):
    order = {t: k for k, t in enumerate(sorted({t for x in sets for t in x}))}
    size = np.array([len(x) for x in sets])
    take = ngram_join.prefix_size(size, threshold)
    return [np.array(sorted(order[t] for t in x)[:k], np.int32) for x, k in zip(sets, take, strict=True)], size


@pytest.mark.parametrize("threshold", [60, 80, 90])
def test_tree_search(threshold):
    """Every link is named; a forest ties what links tie; subtrees of the own component are left."""
    rng = np.random.default_rng(threshold)
    for _ in range(20):
        base = [rng.integers(0, 400, rng.integers(1, 60)) for _ in range(6)]
        sets = [set(np.where(rng.random(len(b)) < 0.08, rng.integers(0, 400, len(b)), b).tolist()) for b in base for _ in range(rng.integers(1, 12))]
        paths, size = paths_of(sets, threshold)
        links = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])}
        every = np.ones(len(sets), bool)
        label = np.arange(len(sets))
        i, j = search(paths, size, label, every, every, threshold, False)
        named = {(max(a, b), min(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
        assert links <= named
        left = rng.random(len(sets)) < 0.5
        i, j = search(paths, size, label, left, ~left, threshold, False)
        assert {(max(a, b), min(a, b)) for a, b in links if left[a] != left[b]} <= {(max(a, b), min(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
        i, j = search(paths, size, label, every, every, threshold, True)
        assert len(i) < len(sets)
        parent = Forest(label)
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            parent.tie(a, np.array([b]))
        assert all(parent.label[a] == parent.label[b] for a, b in links)
        i, j = search(paths, size, parent.label, every, every, threshold, False)
        assert not any((max(a, b), min(a, b)) in links for a, b in zip(i.tolist(), j.tolist(), strict=True))


def test_tree_of_many_near_copies():
    """Thousands of near copies are tied without depth of the stack and without comparing all pairs."""
    rng = np.random.default_rng(3)
    base = np.arange(1000, 3000)
    sets = []
    for k in range(5000):
        x = base.copy()
        x[rng.integers(0, 2000, 3)] = 10_000 + 3 * k + np.arange(3)
        sets.append(np.unique(x))
    size = np.array([len(x) for x in sets])
    rare = [np.concatenate([x[x >= 10_000] - 10_000, x[x < 10_000] + 100_000]).astype(np.int32) for x in sets]
    paths = [x[:k] for x, k in zip(rare, ngram_join.prefix_size(size, 90), strict=True)]
    every = np.ones(len(sets), bool)
    began = time.time()
    i, _ = search(paths, size, np.arange(len(sets)), every, every, 90, True)
    assert len(i) == 4999 and time.time() - began < 60


def test_parity_never_overstates():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 300), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, 5, dtype=np.uint64)]))
        may = ngram_join.near_parity(np.array([len(a), len(b)]), [ngram_join.parity(a), ngram_join.parity(b)], 80)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            assert may(np.array([0]), 1).all() and may(np.array([1]), 0).all()


def test_large_groups_with_stragglers(docs, monkeypatch):
    """Groups above the block size: a large component in blocks of its own, and others that share its n-grams."""
    monkeypatch.setattr(ngram_join, "BLOCK", 128 * 9)
    rng = random.Random(12)
    base = [f"v{k}" for k in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        if i % 3:
            w[rng.randrange(60)] = f"x{i}"
        else:  # half of the text is the group's, too little for a link
            w[rng.randrange(20) :] = [f"y{rng.randrange(12)}z{k}" for k in range(40)]
        rows.append((i, " ".join(w)))
    assert sorted(map(tuple, ngram_join.ngram_components(docs(rows), 3, 60).collect())) == sorted(brute.components(rows, 3, 60))


def test_pairs_named_grow_with_the_sets(docs, monkeypatch):
    """Near copies about the bound: the searches name fewer pairs than there are sets, not one for each two sets or n-grams."""
    rng = random.Random(31)
    base = [f"v{k}" for k in range(400)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in rng.sample(range(400), rng.randrange(3, 9)):
            w[k] = f"x{rng.randrange(300)}"
        rows.append((i, " ".join(w)))
    named, verified = [], ngram_join._verified
    monkeypatch.setattr(ngram_join, "HOMES", 1)
    monkeypatch.setattr(ngram_join, "_verified", lambda pairs, *more: (named.append(pairs.count()), verified(pairs, *more))[1])
    assert sorted(map(tuple, ngram_join.ngram_components(docs(rows)).collect())) == sorted(brute.components(rows))
    assert len(named) > 1 and sum(named) < 2 * len(rows)


def test_each_pair_in_its_first_group():
    path = np.arange(12, dtype=np.int32)
    sketch = ngram_join.parity(np.arange(40, dtype=np.uint64)).tolist()

    def named(token, groups):
        table = pa.table({"print": [5, 9], "n": [40, 40], "component": [5, 9], "side": pa.array([2, 2], pa.int32()), "token": [token] * 2, "path": [path.tolist()] * 2, "sketch": [sketch] * 2, "groups": pa.array(groups, pa.list_(pa.int64()))})
        return ngram_join._search(90, False)(table).to_pylist()

    assert named(3, [[1, 7, 3], [3, 7, 2]]) == [{"token": 3, "leader": 5, "print": 9}]
    assert named(7, [[1, 7, 3], [3, 7, 2]]) == []


@pytest.mark.parametrize("most", [1, 1 << 18])
def test_forest_ties_nearest_of_the_doubtful(monkeypatch, most):
    """Sure pairs tie at once; of the others those with the most room, whatever their order."""
    monkeypatch.setattr(prefix_trie, "MOST_WAITING", most)
    rng = np.random.default_rng(5)
    space = rng.integers(-2, 30, (12, 12))
    space = np.maximum(space, space.T)
    paths, size, every = [np.arange(5, dtype=np.int32)] * 12, np.full(12, 5), np.ones(12, bool)
    i, j = search(paths, size, np.arange(12), every, every, 90, True, lambda others, one: (space[others, one], space[others, one] > 25))
    got = sorted(int(x) for x in space[i, j] if x <= 25)
    tree, want = Forest(np.arange(12)), []
    for x, y in sorted(((x, y) for x in range(12) for y in range(x)), key=lambda p: -space[p]):
        if space[x, y] >= 0 and len(tree.tie(x, np.array([y]))) and space[x, y] <= 25:
            want.append(int(space[x, y]))
    assert got == sorted(want) and len(i) == 11


@pytest.mark.parametrize("how", ["inner", "left"])
def test_split_join(spark, monkeypatch, how):
    monkeypatch.setattr(store, "HOT_KEYS", 4)
    rows = spark.createDataFrame([(0 if k % 2 else k, k) for k in range(40)], "k long, v long")
    table = spark.createDataFrame([(k, 20 if k == 0 else 1, k * 10) for k in range(30)], "k long, c long, w long")
    got = store.split_join(rows, table, ["k"], "c", 40, how).select("k", "v", "w")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, rows.join(table, "k", how).select("k", "v", "w").collect()))


def test_components_of_chains(spark):
    links = [(k, k + 1) for k in range(30)] + [(100, 101), (103, 101), (200, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 31)}, 101: 100, 103: 100}


def test_scan():
    texts = ["a  b", None, "", " cé\td e ", "\u000b", "last"]
    found = [chunk.words(r) for chunk in ts.scan(pa.array(texts), limit=4) for r in range(chunk.rows)]
    assert [[w.decode() for w in f] for f in found] == [brute.words(t) for t in texts]
    sliced = pa.array(["zz", *texts])[1:]
    (chunk,) = ts.scan(sliced)
    hashes = chunk.hashes()
    assert len(set(hashes.tolist())) == len({w for t in texts for w in brute.words(t)})
    assert ts.sliding_min(np.array([5, 3, 4, 1, 9]), 3).tolist() == [3, 1, 1]


def test_groups_of_equal_sums(spark):
    """Two groups of two whose hashes have the same sum: both are looked at."""
    hashes = np.array([r[0] for r in spark.range(6000).selectExpr("xxhash64(id) % (1L << 40)").collect()])
    i, j = np.triu_indices(len(hashes), 1)
    total = hashes[i] + hashes[j]
    order = np.argsort(total)
    k = int(np.flatnonzero(total[order][1:] == total[order][:-1])[0])
    pairs = [(int(i[x]), int(j[x])) for x in order[k : k + 2]]
    members = spark.createDataFrame([(t, p, 50) for t, pair in enumerate(pairs) for p in pair], "token long, print long, n int")
    assert sorted(map(tuple, ngram_join._open(members, None, 4).select("token", "print").collect())) == sorted((t, p) for t, pair in enumerate(pairs) for p in pair)
