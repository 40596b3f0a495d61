"""N-gram Jaccard join: documents whose sets of word n-grams are nearly equal.

Sets are ordered globally, rarer n-grams first, and joined in prefix trees: the
beginnings of a group's sets are the paths of a tree, all sets of the group walk
it together, so that a stretch shared by many paths is compared once for all of
them, and a set leaves a subtree as soon as the n-grams that remain can't lift
the overlap to the bound, or if the subtree lies in its own component
(prefix_trie.search).

How sets meet:

1. Equal sets are one class from the start; only classes go on.
2. Sets of n and m n-grams with Jaccard similarity t or more share at least
   ``surplus`` n-grams within their ordered beginnings of n - ceil(t n) + surplus.
   A class with fewer shared n-grams there has no link and is dropped, by counts
   alone.
3. Classes meet in groups by an n-gram they share.  First every class goes to
   ``HOMES`` groups only, those of its lowest-hashed shared n-grams, where near
   copies meet with near certainty.  Large groups are cut into blocks, each block
   names the pairs that tie its components together, and only one class of each
   component goes on to the next round; so any number of copies of a document
   costs work in proportion to their number.
4. Then all groups that still hold several components are searched, whole.  Each
   class leaves out its ``surplus - 1`` largest groups, as a linked pair has one
   more n-gram in common than that.  Groups with the same members are looked at
   once.  In a group above the block size, members of a component that fills
   blocks of its own never meet one another.
   A pair that a tree names must also pass by its parity sketches (each n-gram
   flips one bit), which bound the difference of two sets from below.
   A search names the pairs that would tie its components together, so it gives
   fewer rows than it has sets.
5. Every pair named is checked on the whole sets.  Where all ties of a group are
   links, the group is settled.  The others are searched once more, and name all
   pairs of different components, each in the first of the pair's groups.

The global order needs frequencies, and these come from a sketch of fixed size
over all documents: it only decides the order, so any error in it costs time and
no link.  The sketch also tells which n-grams may be held by very many sets;
these are dealt over many tasks.

Null text, or text without a word, has an empty set, and is linked with nothing.
Text with fewer words than n has one n-gram, its whole sequence.  A null doc_id
comes after all others, and is given back as null.  Rows that repeat are
documents of their own with equal sets.  An empty table gives an empty result.
Columns other than doc_id and text are ignored, and kept by keep_first.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textscan as ts
from .adders import schema, slices, summed
from .components import components
from .prefix_trie import required, search
from .store import LAST_ID, doc_key, small, split_join, stored, width

SHINGLE = 3
THRESHOLD = 90  # per cent
CELLS = 1 << 16
HOMES = 2
BLOCK = 1 << 18  # n-grams of beginnings in a block
LEAST = 128  # that a set counts for at least, so a block holds at most BLOCK / LEAST sets
ROUNDS = 20


def sets(chunk: ts.Chunk, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each row, sorted within the row, and where each row's begin."""
    hashes = chunk.hashes()
    at = np.flatnonzero(chunk.inside(shingle))
    row, gram = chunk.row_of[at], ts.rolling(hashes, shingle)[at]
    short = np.flatnonzero((chunk.counts > 0) & (chunk.counts < shingle))
    if len(short):
        whole = ts.mix(ts.range_hash(hashes, chunk.edges[short], chunk.edges[short + 1]) + np.uint64(shingle))
        row, gram = np.append(row, short), np.append(gram, whole)
        order = np.argsort(row, kind="stable")
        row, gram = row[order], gram[order]
    sort_rows(gram, np.searchsorted(row, np.arange(chunk.rows + 1)))
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
    row, gram = row[new], gram[new]
    return gram, np.searchsorted(row, np.arange(chunk.rows + 1))


def sort_rows(values: np.ndarray, edges: np.ndarray) -> None:
    """Sort the values of each row in place: many short sorts, as rows lie together already."""
    for a, b in pairwise(edges.tolist()):
        if b - a > 1:
            values[a:b].sort()


def _print(gram: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return ts.range_hash(gram, edges[:-1], edges[1:]).view(np.int64)


def _outline(shingle: int):
    """Per document: key, size of its set, and the set's fingerprint; then the task's counts, in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            for chunk in ts.scan(batch.column("text"), lower=True):
                gram, edges = sets(chunk, shingle)
                counts += np.bincount((gram >> np.uint64(48)).astype(np.int64), minlength=CELLS)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").slice(chunk.first, chunk.rows),
                        pa.array(np.diff(edges)),
                        pa.array(_print(gram, edges)),
                        pa.nulls(chunk.rows, pa.int32()),
                        pa.nulls(chunk.rows, pa.list_(pa.int64())),
                    ],
                    ["key", "n", "print", "part", "total"],
                )
        if counts.any():
            none = pa.array([0], pa.int64())
            for part in slices(counts):
                yield pa.RecordBatch.from_arrays([none, none, none, *part.columns], ["key", "n", "print", "part", "total"])

    return run


def order_levels(counts: np.ndarray) -> np.ndarray:
    """A level from 0 to 15 for each cell of the sketch; cells far above the mean come later in the global order."""
    mean = max(1.0, counts.mean())
    return np.clip(np.log2(np.maximum(counts, 1) / mean), 0, 15).astype(np.uint64) * (counts > 4 * mean)


def _ordered(gram: np.ndarray, edges: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The n-grams as longs whose natural order is the global order, sorted within each row."""
    key = levels[(gram >> np.uint64(48)).astype(np.int64)] << np.uint64(59) | gram >> np.uint64(5)
    if levels.any():
        sort_rows(key, edges)
    return key.view(np.int64)


def hot_cells(counts: np.ndarray) -> np.ndarray:
    """Cells whose n-grams may be held by very many sets; they are at most 1/64 of all."""
    return counts > 64 * max(1.0, counts.mean())


def surplus(n: np.ndarray | int, threshold: int) -> np.ndarray | int:
    return 1 + n * (100 - threshold) // 200


def prefix_size(size: np.ndarray, threshold: int) -> np.ndarray:
    return np.minimum(size, size - -(-threshold * size // 100) + surplus(size, threshold))


def _prefixes(shingle: int, threshold: int, levels: np.ndarray, hot: np.ndarray, memory: int = 100_000):
    """(token, print, hot) for the ordered beginning of each set; a task gives each equal set once, as far as it remembers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for chunk in ts.scan(batch.column("text"), lower=True):
                gram, edges = sets(chunk, shingle)
                prints = _print(gram, edges)
                key = _ordered(gram, edges, levels)
                take = prefix_size(np.diff(edges), threshold)
                for r, p in enumerate(prints.tolist()):
                    if p in seen:
                        take[r] = 0
                    seen.add(p)
                if len(seen) > memory:
                    seen.clear()
                total = int(take.sum())
                inner = np.arange(total) - np.repeat(np.cumsum(take) - take, take)
                token = key[np.repeat(edges[:-1], take) + inner]
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.repeat(prints, take)), pa.array(hot[token >> 43 & CELLS - 1])], ["token", "print", "hot"])

    return run


def parity(gram: np.ndarray) -> np.ndarray:
    """A bit field of about six bits an n-gram; each n-gram flips one."""
    words = 1 << max(0, (len(gram) - 1) // 16).bit_length()
    bits = np.bincount((gram & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")


def parity_room(n: np.ndarray, sketches: list[np.ndarray], threshold: int):
    """How many more n-grams of a set and others may differ for a link, as the bits that differ in their parity fields are a part
    of the n-grams that differ; and whether that is well above what n-grams that flip the same bits can hide."""
    width = np.array([len(x) for x in sketches])
    stacks = {w: np.stack([sketches[i] for i in np.flatnonzero(width == w)]) for w in np.unique(width)}
    place = np.zeros(len(sketches), np.int64)
    for w in stacks:
        place[width == w] = np.arange((width == w).sum())

    def folded(x: np.ndarray, to: int) -> np.ndarray:
        while x.shape[-1] > to:
            half = x.shape[-1] // 2
            x = x[..., :half] ^ x[..., half:]
        return x

    def room(others: np.ndarray, one: int) -> tuple[np.ndarray, np.ndarray]:
        out, sure = np.zeros(len(others), np.int64), np.zeros(len(others), bool)
        for w in np.unique(width[others]):
            at = np.flatnonzero(width[others] == w)
            to = min(w, width[one])
            gap = np.bitwise_count((folded(stacks[w][place[others[at]]], to) ^ folded(sketches[one], to)).view(np.uint64)).sum(1, dtype=np.int64)
            both = n[others[at]] + n[one]
            out[at] = both - 2 * required(both, 0, threshold) - gap
            sure[at] = out[at] >= 2 + gap * gap // (32 * to)
        return out, sure

    return room


def near_parity(n: np.ndarray, sketches: list[np.ndarray], threshold: int):
    """A test of which sets may link with a set."""
    room = parity_room(n, sketches, threshold)
    return lambda others, one: room(others, one)[0] >= 0


def _whole(shingle: int, threshold: int, levels: np.ndarray):
    """(print, n, tokens, path, sketch): the ordered sets, the tree's path of each, which is its beginning by the tokens' upper 31 bits, and its parity field."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("print").to_numpy()
            for chunk in ts.scan(batch.column("text"), lower=True):
                gram, edges = sets(chunk, shingle)
                prints = _print(gram, edges)
                key = _ordered(gram, edges, levels)
                size = np.diff(edges)
                take = prefix_size(size, threshold)
                inner = np.arange(int(take.sum())) - np.repeat(np.cumsum(take) - take, take)
                path = (key[np.repeat(edges[:-1], take) + inner] >> 32).astype(np.int32)
                sketch = pa.array([parity(gram[a:b]) for a, b in pairwise(edges.tolist())], pa.list_(pa.int64()))
                out = pa.RecordBatch.from_arrays([pa.array(prints), pa.array(size), ts.long_lists(key, size), ts.long_lists(path, take), sketch], ["print", "n", "tokens", "path", "sketch"])
                yield out.filter(pa.array(prints == wanted[chunk.first : chunk.first + chunk.rows]))

    return run


def _lists(batch: pa.RecordBatch | pa.Table, name: str) -> list[np.ndarray]:
    column = batch.column(name)
    values, edges = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[a:b] for a, b in pairwise(edges.tolist())]


def _search(threshold: int, forest: bool):
    """Pairs (token, leader, print) of a block, or of two blocks of a group: those that tie components, or else each pair in the first of its groups."""

    def run(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0]
        own, side, label, n = (batch.column(c).to_numpy() for c in ("print", "side", "component", "n"))
        token = batch.column("token")[0].as_py()
        i, j = search(_lists(batch, "path"), n, label, side != 1, side != 0, threshold, forest, parity_room(n, _lists(batch, "sketch"), threshold))
        a, b = np.minimum(own[i], own[j]), np.maximum(own[i], own[j])
        if not forest:
            before = [frozenset(x[x < token].tolist()) for x in _lists(batch, "groups")]
            first = np.array([before[x].isdisjoint(before[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)], bool)
            a, b = np.unique(np.stack([a[first], b[first]]), axis=1)
        return pa.table({"token": pa.array(np.full(len(a), token)), "leader": pa.array(a), "print": pa.array(b)})

    return run


def _check(threshold: int):
    """The pairs that link, by their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [
                len(np.intersect1d(x, y, assume_unique=True)) >= required(len(x), len(y), threshold)
                for x, y in zip(_lists(batch, "leader_tokens"), _lists(batch, "tokens"), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("leader"), batch.column("print")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _verified(pairs: DataFrame, whole: DataFrame, threshold: int) -> DataFrame:
    partners = pairs.join(whole.select("print", "tokens"), "print").select("leader", "print", "tokens")
    leaders = whole.select(F.col("print").alias("leader"), F.col("tokens").alias("leader_tokens"))
    rows = partners.join(leaders, "leader").select("leader", "print", "leader_tokens", "tokens")
    return stored(rows.mapInArrow(_check(threshold), "a long, b long"), "links")


def _weight(n: str = "n") -> Column:
    """What a set of n tokens counts for in a block: about the length of its path."""
    return F.greatest(F.lit(LEAST), F.ceil(F.col(n) / 5)).cast("long")


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """rows with the component of their print; its own print where it has none."""
    if labels is None:
        return rows.withColumn("component", F.col("print"))
    return rows.join(labels.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))


_SEARCHED = "token long, leader long, print long"


def _tied(homes: DataFrame, whole: DataFrame, threshold: int) -> DataFrame | None:
    """Links that tie classes within their home groups, block by block and round by round."""
    links = None
    for _ in range(ROUNDS):
        sizes = homes.groupBy("token").agg(F.sum(_weight()).alias("w"), F.count("*").alias("c")).filter("c > 1").withColumn("cells", F.ceil(F.col("w") / BLOCK).cast("int"))
        sizes = stored(sizes, "homes")
        state = sizes.agg(F.sum("c").alias("c"), F.max("cells").alias("cells")).first()
        if not state["c"]:
            break
        dealt = split_join(homes, sizes, ["token"], "c", state["c"]).withColumn("cell", F.pmod(F.xxhash64("print"), F.col("cells")))
        rows = dealt.select("token", "cell", "print", "component", F.lit(2).alias("side")).join(whole.select("print", "n", "path", "sketch"), "print")
        rows = rows.repartition(width(whole.sparkSession), "token", "cell")  # small rows, much work: not to be put together by size
        pairs = stored(rows.groupBy("token", "cell").applyInArrow(_search(threshold, True), _SEARCHED).select("leader", "print").distinct(), "pairs")
        more = _verified(pairs, whole, threshold)
        links = more if links is None else stored(links.unionByName(more), "links", [links, more])
        if state["cells"] == 1:
            break
        labels = components(links) if not links.isEmpty() else None
        before = homes
        homes = stored(_labelled(homes.drop("component"), labels).dropDuplicates(["token", "component"]), "firsts")
        if homes.count() == before.count():  # nothing was tied: the search of all groups is left to find what there is
            break
    return links


def _cells(members: DataFrame) -> DataFrame:
    """Members dealt to searches: (token, i, j, side, print, component).

    A group within the block size is one search.  In a larger one, a component
    that is as large as a block gets blocks of its own, the others share blocks,
    and every two blocks are searched but those of one component.
    """
    whole = members.groupBy("token").agg(F.sum(_weight()).alias("w"), F.count("*").alias("c"))
    whole = stored(whole.withColumn("large", F.col("w") > BLOCK), "sizes")
    total = members.count()
    marked = split_join(members, whole.select("token", "large", "c"), ["token"], "c", total).drop("c")
    plain = marked.filter("not large").select("token", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side"), "print", "component")
    if not whole.filter("large").limit(1).count():
        return plain
    large = stored(marked.filter("large"), "large")
    parts = large.groupBy("token", "component").agg(F.sum(_weight()).alias("w"), F.count("*").alias("c")).withColumn("pure", F.col("w") > BLOCK)
    parts = stored(parts.withColumn("owner", F.when(F.col("pure"), F.col("component"))), "parts")
    cells = parts.groupBy("token", "owner").agg(F.ceil(F.sum("w") / BLOCK).cast("int").alias("cells"))
    cells = cells.withColumn("first", F.sum("cells").over(Window.partitionBy("token").orderBy("owner")) - F.col("cells"))  # one row a component that fills a block
    cells = stored(cells.withColumn("first", F.col("first").cast("int")), "cells")
    single = cells.select("token", "owner", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("cells") - 1)).alias("cell"))
    other = single.select("token", F.col("owner").alias("other_owner"), F.col("cell").alias("other"))
    met = single.join(other, "token").filter("owner is null or not (owner <=> other_owner)")
    met = stored(met.groupBy("token", "cell").agg(F.collect_list("other").alias("others")), "met")
    keyed = split_join(large, parts.select("token", "component", "owner", "c"), ["token", "component"], "c", total).drop("c")
    numbered = keyed.withColumn("owner_key", F.coalesce("owner", F.lit(-1))).join(cells.select("token", F.coalesce("owner", F.lit(-1)).alias("owner_key"), "cells", "first"), ["token", "owner_key"])
    placed = numbered.withColumn("cell", F.col("first") + F.pmod(F.xxhash64("print"), F.col("cells")).cast("int"))
    dealt = placed.join(met, ["token", "cell"]).select("token", "print", "component", F.col("cell").alias("own"), F.explode("others").alias("other"))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return plain.unionByName(dealt.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "print", "component"))


def _open(members: DataFrame, labels: DataFrame | None, total: int, only: DataFrame | None = None) -> DataFrame:
    """Members of groups (all, or those of the tokens in ``only``) that hold several components; of groups with the same members one."""
    named = stored(_labelled(members, labels), "named")
    who = named.groupBy("token").agg(
        F.count("*").alias("c"), F.sum(F.xxhash64("print") % (1 << 40)).alias("who"), F.min("print").alias("lo"), F.max("print").alias("hi"), F.bit_xor(F.xxhash64(F.lit(1), "print")).alias("mixed"),
        F.min("component").alias("one"), F.max("component").alias("other"),
    )
    who = who.filter("one < other")
    who = who if only is None else who.join(only, "token", "left_semi")
    once = who.groupBy("c", "who", "lo", "hi", "mixed").agg(F.min("token").alias("token")).select("token", "c")
    return stored(split_join(named, stored(once, "groups"), ["token"], "c", total).drop("c"), "open")


def _components(links: DataFrame | None) -> DataFrame | None:
    return components(links) if links is not None and not links.isEmpty() else None


def _named(members: DataFrame, labels: DataFrame | None, whole: DataFrame, threshold: int, forest: bool, only: DataFrame | None = None) -> DataFrame:
    """Pairs (token, leader, print) that the searches of open groups name."""
    dealt, held = _cells(_open(members, labels, members.count(), only)), whole.select("print", "n", "path", "sketch")
    if not forest:
        dealt = stored(dealt, "dealt")
        held = held.join(dealt.groupBy("print").agg(F.collect_set("token").alias("groups")), "print")
    rows = dealt.join(held, "print").repartition(width(whole.sparkSession), "token", "i", "j")  # small rows, much work: not to be put together by size
    return stored(rows.groupBy("token", "i", "j").applyInArrow(_search(threshold, forest), _SEARCHED), "pairs")


def _linked(members: DataFrame, whole: DataFrame, threshold: int) -> DataFrame | None:
    """(node, component) of the classes that links tie, or None without links."""
    ranked = F.array_sort(F.collect_set(F.struct(F.xxhash64("token").alias("h"), "token")))
    homes = members.groupBy("print", "n").agg(F.slice(ranked, 1, HOMES).alias("homes")).select("print", "n", F.explode("homes.token").alias("token"))
    links = _tied(stored(homes.withColumn("component", F.col("print")), "homes"), whole, threshold)
    labels = _components(links)
    ties = _named(members, labels, whole, threshold, True)
    more = _verified(ties.select("leader", "print").distinct(), whole, threshold)
    links = more if links is None else links.unionByName(more)
    # A group whose ties are links all has nothing more to tell; one with another may have left out a link for it.
    unsettled = stored(ties.join(more.select(F.col("a").alias("leader"), F.col("b").alias("print")), ["leader", "print"], "left_anti").select("token").distinct(), "unsettled")
    labels = _components(links)
    if unsettled.isEmpty():
        return labels
    pairs = _named(members, labels, whole, threshold, False, unsettled).select("leader", "print")
    rest = _verified(pairs, whole, threshold)
    return labels if rest.isEmpty() else components(links.unionByName(rest))


def _classes(spark: SparkSession, counts: np.ndarray, classes: DataFrame, texts: DataFrame, shingle: int, threshold: int) -> DataFrame | None:
    levels, hot = order_levels(counts), hot_cells(counts)
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("print"), F.lit(width(spark)))).otherwise(F.lit(0)).alias("salt")
    group = Window.partitionBy("token", "salt")
    rows = texts.mapInArrow(_prefixes(shingle, threshold, levels, hot), "token long, print long, hot boolean").select("token", "print", "hot", salt).repartition(width(spark), "token", "salt")
    # An n-gram that may be held by very many sets counts as shared without a look.
    met = rows.withColumn("lo", F.min("print").over(group)).withColumn("hi", F.max("print").over(group)).filter("hot or lo < hi")
    shared = stored(met.select("token", "salt", "print").distinct().drop("salt"), "shared")
    least = F.expr(f"1 + (({threshold} * n + 99) div 100) * {100 - threshold} div 200")  # surplus of the smallest set that can link

    def enough(rows: DataFrame) -> DataFrame:
        found = rows.groupBy("print").agg(F.count("*").alias("found"))
        return found.join(classes, "print").filter(F.col("found") >= least).select("print", "n", "key", least.cast("int").alias("least"))

    def in_groups(rows: DataFrame) -> DataFrame:
        """Rows of tokens with two sets or more, and how many these have."""
        rows = stored(rows, "rows")
        sizes = stored(rows.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1"), "sizes")
        return split_join(rows, sizes, ["token"], "c", rows.count())

    first = stored(enough(shared), "first")
    again = stored(in_groups(shared.join(first.select("print"), "print")), "again", [shared])
    alive = stored(enough(again.drop("c")), "alive")
    if alive.isEmpty():
        return None
    # A linked pair shares ``least`` n-grams of these: without the largest least - 1 groups of each set it still shares one.
    by_size = Window.partitionBy("print").orderBy(F.desc("c"), F.desc("token"))
    ranked = again.join(alive.select("print", "n", "least"), "print").withColumn("place", F.row_number().over(by_size)).filter("place >= least").select("token", "print", "n")
    members = stored(in_groups(ranked).drop("c"), "members", [again])
    ids = alive.select("key", "print")
    picked = texts.join(F.broadcast(ids) if small(ids, F.lit(32)) else ids, "key").select("print", "text")
    whole = stored(picked.mapInArrow(_whole(shingle, threshold, levels), "print long, n long, tokens array<long>, path array<int>, sketch array<long>").dropDuplicates(["print"]), "sets")
    return _linked(members, whole, threshold)


def ngram_components(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    if not 50 <= threshold <= 100:
        raise ValueError("threshold is a percentage from 50 to 100")
    spark = docs.sparkSession
    texts = docs.select(doc_key().alias("key"), F.col("text").cast("string").alias("text"))
    outline = stored(texts.mapInArrow(_outline(shingle), f"key long, n long, print long, {schema('bigint')}"), "outline")
    rows = outline.filter("part is null").select("key", "n", "print")
    classes = stored(rows.filter("n > 0").groupBy("print").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.count("*").alias("c")), "classes")
    counts = summed(outline.filter("part is not null").select("part", "total"), CELLS, np.int64, "bigint")
    labels = _classes(spark, counts, classes.select("print", "key", "n"), texts, shingle, threshold) if counts is not None else None
    firsts = classes.select("print", "key", "c")
    if labels is not None:
        tied = labels.withColumnRenamed("node", "print").unionByName(labels.select(F.col("component").alias("print"), "component").distinct())
        own = stored(firsts.join(tied, "print").select("print", "component", "key", "c"), "tied")
        per = stored(own.groupBy("component").agg(F.min("key").alias("first"), F.count("*").alias("n_classes")), "per")
        moved = split_join(own, per, ["component"], "n_classes", own.count()).select("print", "first")
        firsts = stored(firsts.join(moved, "print", "left").select("print", F.coalesce("first", "key").alias("key"), "c"), "firsts")
    # Only rows whose first document is another one need to be told.
    total = rows.count()
    known = split_join(rows.filter("n > 0"), firsts.withColumnRenamed("key", "first"), ["print"], "c", total).select("key", "n", "first")
    known = known.unionByName(rows.filter("n = 0").select("key", "n", F.col("key").alias("first")))
    known_id = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    return known.select(known_id("key").alias("doc_id"), F.col("n").alias("n_shingles"), known_id("first").alias("component_id"))


def keep_first(docs: DataFrame, shingle: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the smallest doc_id stays.

    Rows that repeat a doc_id share their fate, and stay if one of them is the first of its component.
    """
    found = ngram_components(docs.select("doc_id", "text"), shingle, threshold)
    key = F.coalesce("doc_id", F.lit(LAST_ID)).alias("__key")
    later = found.groupBy(key).agg(F.min(F.coalesce("component_id", F.lit(LAST_ID)) < F.coalesce("doc_id", F.lit(LAST_ID))).alias("later")).filter("later").select("__key")
    later = stored(later, "later")
    return docs.withColumn("__key", doc_key()).join(F.broadcast(later) if small(later, F.lit(16)) else later, "__key", "left_anti").select(*docs.columns)
