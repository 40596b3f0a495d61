"""Calibration statistics: robust spread, error curves, recall and latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def median_mad(rows: DataFrame, keys: list[str], values: list[str], floor: float = 0.01, source: str | None = None) -> DataFrame:
    """Per key: median and 1.4826 x median absolute deviation (at least ``floor``) of each value, rounded to 4; n distinct sources, boxes rows.

    Two passes of exact percentiles; the medians come back by a join on the keys.
    """
    middles = rows.groupBy(*keys).agg(
        *(F.percentile(v, F.lit(0.5)).alias(f"m_{v}") for v in values), F.count_distinct(source).alias("n") if source else F.count("*").alias("n"), F.count("*").alias("boxes")
    )
    spread = rows.join(middles, keys).groupBy(*keys).agg(*(F.percentile(F.abs(F.col(v) - F.col(f"m_{v}")), F.lit(0.5)).alias(f"d_{v}") for v in values))
    shown = [c for v in values for c in (F.round(F.col(f"m_{v}") + 1e-9, 4).alias(v), F.greatest(F.lit(floor), F.round(1.4826 * F.col(f"d_{v}") + 1e-9, 4)).alias(f"mad_{v}"))]
    return middles.join(spread, keys).select(*keys, *shown, "n", "boxes")


def robust_z(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(value - median) / (1.4826 MAD) within the key; zero where the spread is nil."""
    middle = rows.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("m"))
    near = rows.join(middle, keys)
    spread = near.groupBy(*keys).agg((1.4826 * F.percentile(F.abs(F.col(value) - F.col("m")), F.lit(0.5))).alias("s"))
    z = F.when(F.col("s") > 1e-9, (F.col(value) - F.col("m")) / F.when(F.col("s") > 1e-9, F.col("s"))).otherwise(F.lit(0.0))
    return near.join(spread, keys).withColumn("z", z).drop("m", "s")


def error_curve(scores: DataFrame, first: int = 10, last: int = 74) -> DataFrame:
    """False accepts and false rejects at thresholds 0.10, 0.11, ...: one histogram of hundredths, then sums along it."""
    at = F.least(F.greatest(F.floor(F.round(F.col("score") * 100, 9)), F.lit(first - 1)), F.lit(last)).cast("int")
    cells = scores.groupBy(at.alias("c")).agg(F.count_if(F.col("genuine")).alias("g"), F.count_if(~F.col("genuine")).alias("i"))
    grid = scores.sparkSession.range(first - 1, last + 1).select(F.col("id").cast("int").alias("c"))
    along = Window.orderBy("c")  # at most a few dozen cells
    full = grid.join(F.broadcast(cells), "c", "left").fillna(0, ["g", "i"])
    sums = full.select(
        "c",
        F.sum("i").over(along.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("accepted"),
        F.sum("g").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("rejected"),
        F.sum("i").over(Window.partitionBy()).alias("all_i"),
        F.sum("g").over(Window.partitionBy()).alias("all_g"),
    )
    rate = lambda a, b: F.when(F.col(b) > 0, F.coalesce(F.col(a), F.lit(0)) / F.when(F.col(b) > 0, F.col(b)))
    return sums.filter(F.col("c") >= first).select((F.col("c") / 100).alias("threshold"), rate("accepted", "all_i").alias("far"), rate("rejected", "all_g").alias("frr"))


def operating_point(curve: DataFrame, target: float) -> DataFrame:
    """The lowest threshold whose false accepts don't exceed the target."""
    return curve.filter(F.col("far") <= target).agg(F.min("threshold").alias("threshold"), F.min_by("far", "threshold").alias("far"), F.min_by("frr", "threshold").alias("frr"))


def group_errors(scores: DataFrame, cut: float, least: int) -> DataFrame:
    """False matches and non-matches by group with at least ``least`` scores."""
    hit = F.col("score") >= cut
    return (
        scores.groupBy("label")
        .agg(F.count("*").alias("n"), F.avg(F.when(~F.col("genuine"), hit.cast("double"))).alias("fmr"), F.avg(F.when(F.col("genuine"), (~hit).cast("double"))).alias("fnmr"))
        .filter(F.col("n") >= least)
    )


def nearest_rank(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles by nearest rank: the value at place round-half-even(q (n - 1))."""
    order = Window.partitionBy(*keys).orderBy(value)
    placed = rows.withColumn("rn", F.row_number().over(order) - 1).withColumn("size", F.count("*").over(Window.partitionBy(*keys)))
    at = lambda q: F.max(F.when(F.col("rn") == F.bround(q * (F.col("size") - 1), 0), F.col(value)))
    return placed.groupBy(*keys).agg(*(at(q).alias(n) for n, q in shares.items()), F.max(value).alias("max"), F.count("*").alias("n"))


def clean_cut(rows: DataFrame, value: str, family: str, clean: str, share: float = 0.95) -> DataFrame:
    """The quantile of the clean family, and the share of each family above it."""
    cut = rows.filter(F.col(family) == clean).agg(F.percentile(value, F.lit(share)).alias("cut"))
    return rows.join(F.broadcast(cut), F.lit(True)).groupBy(family).agg(F.first("cut").alias("cut"), F.avg((F.col(value) > F.col("cut")).cast("double")).alias("rate"))


def bisect_equal_error(first: Column, last: Column, gap, turns: int = 60) -> Column:
    """Where a rising function of the threshold crosses zero, by halving."""
    start = F.struct(first.alias("a"), last.alias("b"))

    def step(acc: Column, _: Column) -> Column:
        middle = (acc["a"] + acc["b"]) / 2
        up = gap(middle) > 0
        return F.struct(F.when(up, acc["a"]).otherwise(middle).alias("a"), F.when(up, middle).otherwise(acc["b"]).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(turns)), start, step, lambda acc: (acc["a"] + acc["b"]) / 2)


def capped_pairs(rows: DataFrame, group: str, key: str, identity: str, cap: int) -> DataFrame:
    """(group, a, b): pairs a < b of different identity within a group, in order, by an even stride at most ``cap`` of them a group.

    Pairs are counted by ranks and only the chosen ones are made, so the work is at most cap times the group.
    """
    order, same = Window.partitionBy(group).orderBy(key), Window.partitionBy(group, identity).orderBy(key)
    n, own = F.count("*").over(Window.partitionBy(group)), F.count("*").over(Window.partitionBy(group, identity))
    ranked = rows.select(group, key, identity, F.row_number().over(order).alias("place"), ((n - F.row_number().over(order)) - (own - F.row_number().over(same))).alias("c"))
    placed = ranked.withColumn("before", F.sum("c").over(order) - F.col("c")).withColumn("step", F.greatest(F.lit(1), F.floor(F.sum("c").over(Window.partitionBy(group)) / cap)).cast("long"))
    first = (F.ceil(F.col("before") / F.col("step")) * F.col("step")).cast("long")
    last = F.least(F.col("before") + F.col("c") - 1, F.col("step") * cap - 1)
    chosen = placed.filter(first <= last).select(group, F.col(key).alias("a"), F.col(identity).alias("__who"), F.col("place").alias("__place"), F.transform(F.sequence(first, last, F.col("step")), lambda k: k - F.col("before") + 1).alias("__wanted"))
    later = chosen.join(ranked.select(group, F.col(key).alias("b"), identity, "place"), group).filter((F.col("place") > F.col("__place")) & (F.col(identity) != F.col("__who")))
    nth = F.row_number().over(Window.partitionBy(group, "a").orderBy("place")).cast("long")
    return later.withColumn("__nth", nth).filter(F.array_contains("__wanted", F.col("__nth"))).select(group, "a", "b")
