"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored

ROUNDS = 60


def _hook(edges: DataFrame, both: bool) -> DataFrame:
    """Tie the neighbours of each node to the smallest of them (and the node): larger neighbours, or smaller ones."""
    if both:
        sides = edges.union(edges.select("b", "a"))
        least = sides.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
        return sides.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a > b").distinct()
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    tied = edges.join(least, "a")
    return tied.select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select("a", F.col("least").alias("b"))).filter("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of links (a, b) but those that are the smallest of theirs; component is that smallest node.

    Nodes may be of any type with an order.  Each contraction is written to the
    shared folder, so plans stay short, and replaces the one before; a hot node's
    links are aggregated before they are joined, and no group is collected.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    before = None
    for _ in range(ROUNDS):
        edges = stored(_hook(_hook(edges, True), False), "edges", [edges])
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = state
    raise RuntimeError("components did not converge")
