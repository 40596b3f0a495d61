"""Statistics over derived boxes, scores and latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions import scalars as S
from attesta.operators import joins as J
from attesta.operators import stats as X

from .q_joins import scores
from .registry import query
from .views import Tables

_CENTRE = "SELECT doc_type, class, image_id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM boxes"


def centres(t: Tables) -> DataFrame:
    return t.boxes.select("box_id", "doc_type", "class", "image_id", ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"))


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n) + 1e-9, 6) for n in names})


@query(
    "A19_layout_mad",
    f"""WITH c AS ({_CENTRE}), m AS (SELECT doc_type, class, quantile_cont(cx, 0.5) AS mx, quantile_cont(cy, 0.5) AS my, count(DISTINCT image_id) AS n, count(*) AS boxes FROM c GROUP BY ALL),
d AS (SELECT doc_type, class, quantile_cont(abs(cx - mx), 0.5) AS dx, quantile_cont(abs(cy - my), 0.5) AS dy FROM c JOIN m USING (doc_type, class) GROUP BY ALL)
SELECT doc_type, class, round(mx + 1e-9, 4) AS cx, greatest(0.01, round(1.4826 * dx + 1e-9, 4)) AS mad_cx, round(my + 1e-9, 4) AS cy, greatest(0.01, round(1.4826 * dy + 1e-9, 4)) AS mad_cy, n, boxes FROM m JOIN d USING (doc_type, class)""",
)
def a19(t: Tables) -> DataFrame:
    """Layout reference: median centre and spread of each class."""
    return X.median_mad(centres(t), ["doc_type", "class"], ["cx", "cy"], source="image_id")


@query(
    "P43_layout_outlier",
    f"""WITH c AS (SELECT box_id, doc_type, class, (x1 + x2) / 2 AS cx FROM boxes), m AS (SELECT doc_type, class, quantile_cont(cx, 0.5) AS mx FROM c GROUP BY ALL), s AS (SELECT doc_type, class, 1.4826 * quantile_cont(abs(cx - mx), 0.5) AS s FROM c JOIN m USING (doc_type, class) GROUP BY ALL)
SELECT box_id, round((cx - mx) / s + 1e-9, 6) AS z FROM c JOIN m USING (doc_type, class) JOIN s USING (doc_type, class) WHERE s > 1e-9""",
)
def p43(t: Tables) -> DataFrame:
    """Robust z of each field's place."""
    return r6(X.robust_z(centres(t), ["doc_type", "class"], "cx").select("box_id", "z"), "z")


_U = "u AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM vectors), s AS (SELECT a.label, a.label = b.label AS genuine, round(list_cosine_similarity(a.e, b.e), 9) AS score FROM u a, u b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)"


def scored(t: Tables) -> DataFrame:
    return scores(t).withColumn("score", F.round("score", 9))


_CURVE = f"{_U}, c AS (SELECT k / 100.0::DOUBLE AS threshold, avg(CASE WHEN NOT genuine THEN CAST(round(score * 100, 9) >= k AS INT)::DOUBLE END) AS far, avg(CASE WHEN genuine THEN CAST(round(score * 100, 9) < k AS INT)::DOUBLE END) AS frr FROM s, range(10, 75) r(k) GROUP BY k)"


@query("A20_error_curve", f"WITH {_CURVE} SELECT threshold, round(far + 1e-9, 6) AS far, round(frr + 1e-9, 6) AS frr FROM c")
def a20(t: Tables) -> DataFrame:
    """False accepts and rejects along the thresholds."""
    return r6(X.error_curve(scored(t)), "far", "frr")


@query("A21_operating_point", f"WITH {_CURVE} SELECT min(threshold) AS threshold, round(arg_min(far, threshold) + 1e-9, 6) AS far, round(arg_min(frr, threshold) + 1e-9, 6) AS frr FROM c WHERE far <= 0.1")
def a21(t: Tables) -> DataFrame:
    return r6(X.operating_point(X.error_curve(scored(t)), 0.1), "far", "frr")


#: As _U, with every vector as probe.
_ALL = "u AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM vectors), s AS (SELECT a.label = b.label AS genuine, round(list_cosine_similarity(a.e, b.e), 9) AS score FROM u a, u b WHERE a.vec_id <> b.vec_id)"


@query("A22_score_quantiles", f"WITH {_ALL} SELECT genuine, round(quantile_cont(score, 0.05) + 1e-9, 6) AS p05, round(quantile_cont(score, 0.5) + 1e-9, 6) AS median, round(quantile_cont(score, 0.95) + 1e-9, 6) AS p95 FROM s GROUP BY genuine")
def a22(t: Tables) -> DataFrame:
    """Interpolated quantiles of the genuine and the impostor scores of all pairs of vectors."""
    vectors = t.vectors
    return r6(J.score_quantiles(vectors, vectors, {"p05": 0.05, "median": 0.5, "p95": 0.95}), "p05", "median", "p95")


@query("A23_group_errors", f"WITH {_U} SELECT label, count(*) AS n, round(avg(CASE WHEN NOT genuine THEN CAST(score >= 0.1 AS INT)::DOUBLE END) + 1e-9, 6) AS fmr, round(avg(CASE WHEN genuine THEN CAST(score < 0.1 AS INT)::DOUBLE END) + 1e-9, 6) AS fnmr FROM s GROUP BY label HAVING count(*) >= 60")
def a23(t: Tables) -> DataFrame:
    """Errors by group of at least sixty scores."""
    return r6(X.group_errors(scored(t), 0.1, 60), "fmr", "fnmr")


@query("A25_tamper_rates", "WITH c AS (SELECT quantile_cont(value, 0.95) AS cut FROM events WHERE event_type = 'click') SELECT event_type, round(cut + 1e-9, 6) AS cut, round(avg(CAST(value > cut AS INT)::DOUBLE) + 1e-9, 6) AS rate FROM events, c GROUP BY event_type, cut")
def a25(t: Tables) -> DataFrame:
    """A cut from the clean family, and every family's share above it."""
    return r6(X.clean_cut(t.events.select("event_type", "value"), "value", "event_type", "click"), "cut", "rate")


@query("A26_latency", "WITH o AS (SELECT doc_type, latency_ms, row_number() OVER (PARTITION BY doc_type ORDER BY latency_ms) - 1 AS rn, count(*) OVER (PARTITION BY doc_type) AS n FROM signals) SELECT doc_type, max(latency_ms) FILTER (rn = round_even(0.5 * (n - 1), 0)) AS p50, max(latency_ms) FILTER (rn = round_even(0.95 * (n - 1), 0)) AS p95, max(latency_ms) AS max, count(*) AS n FROM o GROUP BY doc_type")
def a26(t: Tables) -> DataFrame:
    """Nearest-rank latencies."""
    return X.nearest_rank(t.signals.select("doc_type", "latency_ms"), ["doc_type"], "latency_ms", {"p50": 0.5, "p95": 0.95})


@query("A24_recall_sets", "SELECT class, doc_type, count(*) AS n, count(*) FILTER (confidence >= 0.25) AS found FROM boxes GROUP BY GROUPING SETS ((class), (doc_type), ())")
def a24(t: Tables) -> DataFrame:
    """Recall by class, by type and overall in one pass."""
    return t.boxes.groupingSets([["class"], ["doc_type"], []], "class", "doc_type").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") >= 0.25).alias("found"))


@query("A28_class_counts", "SELECT o.class, count(b.box_id) AS n FROM (VALUES ('dob'), ('name'), ('id_number'), ('photo'), ('mrz')) o(class) LEFT JOIN boxes b USING (class) GROUP BY 1")
def a28(t: Tables) -> DataFrame:
    """Boxes of every class of the ontology, zeros included."""
    ontology = t.spark.createDataFrame([(c,) for c in ("dob", "name", "id_number", "photo", "mrz")], "class string")
    counts = t.boxes.groupBy("class").agg(F.count("*").alias("n"))
    return ontology.join(counts, "class", "left").select("class", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("A29_best_box", "SELECT image_id, class, arg_max(box_id, (confidence, -box_id)) AS box_id FROM boxes GROUP BY ALL")
def a29(t: Tables) -> DataFrame:
    return t.boxes.groupBy("image_id", "class").agg(F.max_by("box_id", F.struct(F.col("confidence"), (-F.col("box_id")).alias("o"))).alias("box_id"))


@query("A30_largest_box", "SELECT image_id, arg_max(box_id, ((x2 - x1) * (y2 - y1), -box_id)) AS box_id FROM boxes GROUP BY image_id")
def a30(t: Tables) -> DataFrame:
    area = ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area")
    return t.boxes.groupBy("image_id").agg(F.max_by("box_id", F.struct(area, (-F.col("box_id")).alias("o"))).alias("box_id"))


@query("A31_phonetic_buckets")
def a31(t: Tables) -> DataFrame:
    """Sizes of phonetic buckets; Soundex has no DuckDB function."""
    return t.listed.groupBy(S.phonetic_key(S.watchlist_key(F.col("name"))).alias("sound")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("A33_equal_error")
def a33(t: Tables) -> DataFrame:
    """Threshold of equal errors under normal models of both score sets, by bisection in one expression."""
    parts = scored(t).groupBy().agg(
        F.avg(F.when(F.col("genuine"), F.col("score"))).alias("gm"), F.stddev_pop(F.when(F.col("genuine"), F.col("score"))).alias("gs"),
        F.avg(F.when(~F.col("genuine"), F.col("score"))).alias("im"), F.stddev_pop(F.when(~F.col("genuine"), F.col("score"))).alias("is_"),
    )
    cdf = lambda x, m, s: (1 + S.erf((x - m) / (s * 2**0.5))) / 2
    gap = lambda x: cdf(x, F.col("gm"), F.col("gs")) - (1 - cdf(x, F.col("im"), F.col("is_")))
    return parts.select(F.round(X.bisect_equal_error(F.lit(-1.0), F.lit(1.0), gap), 6).alias("threshold"))


@query("A18_counts", "SELECT (SELECT count(*) FROM cases) AS n_events, (SELECT count(*) FROM listed) AS n_listed")
def a18(t: Tables) -> DataFrame:
    return t.cases.agg(F.count("*").alias("n_events")).join(t.listed.agg(F.count("*").alias("n_listed")), F.lit(True))


@query("T10_hash_sample", "SELECT vec_id FROM vectors ORDER BY sha256(CAST(vec_id AS STRING)) LIMIT 40")
def t10(t: Tables) -> DataFrame:
    """A sample by the order of hashes: the sample is the feature."""
    return t.vectors.select("vec_id").orderBy(F.sha2(F.col("vec_id").cast("string"), 256)).limit(40)
