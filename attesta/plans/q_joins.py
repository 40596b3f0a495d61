"""Joins, windows, top-k and paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import scalars as S
from attesta.operators import joins as J
from attesta.operators.fusion import iou

from . import rules as R
from .q_checks import _KM, _POSTS
from .registry import query
from .views import Tables

_IOU = """(CASE WHEN least(a.x2, b.x2) > greatest(a.x1, b.x1) AND least(a.y2, b.y2) > greatest(a.y1, b.y1) THEN (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1))
 / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1))) ELSE 0 END)"""


@query("F21_iou", f"SELECT a.box_id AS a_id, b.box_id AS b_id, round({_IOU} + 1e-9, 6) AS iou FROM boxes a JOIN boxes b ON b.box_id = a.box_id + 50")
def f21(t: Tables) -> DataFrame:
    a, b = t.boxes.alias("a"), t.boxes.withColumn("box_id", F.col("box_id") - 50).alias("b")
    score = iou(J.box("a."), J.box("b."))
    return a.join(b, F.col("a.box_id") == F.col("b.box_id")).select(F.col("a.box_id").alias("a_id"), (F.col("b.box_id") + 50).alias("b_id"), F.round(score + 1e-9, 6).alias("iou"))


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    shown = ["image_id", "box_id", "class", "ordinal", "x1", "y1", "x2", "y2"]
    return t.boxes.filter("box_id % 2 = 0").select(shown), t.boxes.filter("box_id % 2 = 1").select(shown)


@query("J4_region_to_field", f"SELECT a.box_id AS region_id, arg_max(b.class, (round({_IOU}, 9), -b.ordinal, -b.box_id)) AS field FROM boxes a JOIN boxes b ON a.image_id = b.image_id WHERE a.box_id <> b.box_id AND {_IOU} > 0.3 GROUP BY a.box_id")
def j4(t: Tables) -> DataFrame:
    """Spatial join: the field whose box a region overlaps most, above 0.30."""
    own = t.boxes.select("image_id", "box_id", "class", "ordinal", "x1", "y1", "x2", "y2")
    return J.best_partners(own, ["image_id"], 0.30, True).select(F.col("box_id").alias("region_id"), F.col("other_class").alias("field"))


@query("J6_detector_recall", f"SELECT a.class, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM boxes b WHERE b.image_id % 10 = a.image_id % 10 AND b.class = a.class AND b.box_id % 2 = 1 AND {_IOU} >= 0.5)) AS found FROM boxes a WHERE a.box_id % 2 = 0 GROUP BY a.class")
def j6(t: Tables) -> DataFrame:
    """Recall of predicted boxes by class: a true box is found if one of its class overlaps it by half."""
    truth, found = (d.withColumn("g", F.col("image_id") % 10) for d in _sides(t))
    hit = J.overlaps(truth.drop("image_id"), found.drop("image_id"), ["g", "class"], 0.5, strict=False).select(F.col("a_box_id").alias("box_id")).distinct()
    marked = truth.join(hit.withColumn("hit", F.lit(1)), "box_id", "left")
    return marked.groupBy("class").agg(F.count("*").alias("n"), F.count("hit").alias("found"))


@query("J7_signed_payload", "SELECT person_id, 'dob' AS field, CASE WHEN person_id % 9 = 0 THEN 'inconclusive' WHEN person_id % 10 = 0 THEN 'fail' ELSE 'pass' END AS verdict FROM people UNION ALL SELECT person_id, 'name', 'pass' FROM people")
def j7(t: Tables) -> DataFrame:
    """A signed payload against what is printed on its own card; a value the fallback reader gave stays open."""
    k = F.col("person_id")
    payload = F.create_map(F.lit("dob"), F.col("dob"), F.lit("name"), F.concat_ws(" ", "given", "surname"))
    proven = t.people.select("person_id", F.explode(payload).alias("field", "proven"))
    printed = t.people.select(
        "person_id",
        F.explode(
            F.array(
                F.struct(F.lit("dob").alias("field"), F.when(k % 10 == 0, "01/01/1900").otherwise(F.col("dob")).alias("value"), F.when(k % 9 == 0, "vlm").otherwise("ocr").alias("source")),
                F.struct(F.lit("name").alias("field"), F.lower(F.concat_ws(" ", "given", "surname")).alias("value"), F.lit("mrz").alias("source")),
            )
        ).alias("p"),
    ).select("person_id", "p.field", "p.value", "p.source")
    norm = lambda c: F.when(F.col("field") == "dob", S.iso_date(F.col(c))).otherwise(S.name(F.col(c)))
    both = proven.join(printed, ["person_id", "field"], "left")
    verdict = F.when(F.col("value").isNull() | (F.col("source") == "vlm"), "inconclusive").when(norm("proven") == norm("value"), "pass").otherwise("fail")
    return both.select("person_id", "field", verdict.alias("verdict"))


@query("J8_cross_document", "SELECT c.case_id, p.case_id AS prior_id, 'doc_type' AS field, CASE WHEN c.doc_type = p.doc_type THEN 'pass' ELSE 'fail' END AS verdict FROM cases c JOIN cases p ON c.session_id = p.session_id AND p.seq < c.seq WHERE p.status = 'F' UNION ALL SELECT c.case_id, p.case_id, 'status', CASE WHEN c.status = p.status THEN 'pass' ELSE 'fail' END FROM cases c JOIN cases p ON c.session_id = p.session_id AND p.seq < c.seq WHERE p.status = 'F'")
def j8(t: Tables) -> DataFrame:
    """Every verified earlier document of the session against each later one, field by field."""
    fields = F.create_map(F.lit("doc_type"), F.col("doc_type"), F.lit("status"), F.col("status"))
    return J.signed_priors(t.cases.select("session_id", "seq", "case_id", (F.col("status") == "F").alias("verified"), fields.alias("fields")))


@query("J9_session_edges", "SELECT case_id, prior_id FROM (SELECT case_id, last_value(CASE WHEN status = 'F' THEN case_id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY created_at, case_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_id FROM cases) WHERE prior_id IS NOT NULL")
def j9(t: Tables) -> DataFrame:
    """Session edges: the latest verified document before each."""
    verified = F.when(F.col("status") == "F", F.col("case_id"))
    return J.latest_before(t.cases, "session_id", ["created_at", "case_id"], verified, "prior_id").filter("prior_id is not null").select("case_id", "prior_id")


@query("W8_session_position", "SELECT case_id, row_number() OVER (PARTITION BY session_id ORDER BY created_at, case_id) AS place FROM cases")
def w8(t: Tables) -> DataFrame:
    return t.cases.select("case_id", F.row_number().over(Window.partitionBy("session_id").orderBy("created_at", "case_id")).cast("long").alias("place"))


_DOCS = "docs AS (SELECT person_id AS doc_id, doc_number AS number, given || ' ' || surname AS name, dob FROM people)"


def documents(t: Tables) -> DataFrame:
    number = F.when(F.col("person_id") % 3 == 0, F.lower("doc_number")).otherwise(F.concat(F.lit("Q"), F.col("person_id").cast("string")))
    return t.people.select(F.col("person_id").alias("doc_id"), number.alias("number"), F.concat_ws(" ", "given", "surname").alias("name"), "dob")


_CHAIN = """WITH docs AS (SELECT person_id AS doc_id, CASE WHEN person_id % 3 = 0 THEN doc_number ELSE 'Q' || CAST(person_id AS STRING) END AS number, array_to_string(list_sort([given, surname]), ' ') AS key, dob FROM people),
l AS (SELECT *, array_to_string(list_sort(string_split(name, ' ')), ' ') AS lkey FROM listed), n AS (SELECT upper(doc_number) AS number, min(id) AS nid FROM l GROUP BY 1), k AS (SELECT lkey AS key, min(id) AS kid, arg_min(dob, id) AS kdob FROM l GROUP BY 1),
m AS (SELECT d.doc_id, nid, kid, kdob, d.dob FROM docs d LEFT JOIN n USING (number) LEFT JOIN k USING (key))"""


@query("J10_watchlist_number", _CHAIN + " SELECT doc_id, nid AS listed_id FROM m WHERE nid IS NOT NULL")
def j10(t: Tables) -> DataFrame:
    return J.watchlist(documents(t), t.listed).filter("how = 'number'").select("doc_id", "listed_id")


@query("J11_watchlist_name", _CHAIN + " SELECT doc_id, kid AS listed_id, CASE WHEN dob <> kdob THEN 'inconclusive' ELSE 'fail' END AS verdict FROM m WHERE nid IS NULL AND kid IS NOT NULL")
def j11(t: Tables) -> DataFrame:
    return J.watchlist(documents(t), t.listed).filter("how = 'name'").select("doc_id", "listed_id", "verdict")


@query("J13_watchlist_chain")
def j13(t: Tables) -> DataFrame:
    """The whole chain, near names included (J12, J13, F16, F17): difflib has no SQL."""
    return J.watchlist(documents(t), t.listed)


@query(
    "J15_impossible_transit",
    f"""WITH p AS (SELECT * FROM {_POSTS} x(post_id, name, lat, lon)), c AS (SELECT *, lag(post_id) OVER w AS bp, lag(ts) OVER w AS bt FROM crossings WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT event_id, user_id, ts, post_id, last_value(CASE WHEN bp <> post_id THEN bp END IGNORE NULLS) OVER w AS tp, last_value(CASE WHEN bp <> post_id THEN bt END IGNORE NULLS) OVER w AS tt FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
d AS (SELECT s.*, {_KM} AS km, (epoch_us(ts) - epoch_us(tt)) / 3.6e9 AS hours FROM s JOIN p a ON a.post_id = s.post_id JOIN p b ON b.post_id = tp)
SELECT event_id, user_id, post_id, tp AS there_id, round(km + 1e-9, 6) AS km, round(hours + 1e-9, 6) AS hours, CASE WHEN hours > 0 AND km > 60 * hours THEN 'fail' ELSE 'pass' END AS verdict FROM d""",
)
def j15(t: Tables) -> DataFrame:
    """As-of join with the latest crossing at another post, and the speed it takes."""
    out = J.transit(t.crossings, R.post_table(t.spark))
    return out.withColumn("km", F.round(F.col("km") + 1e-9, 6)).withColumn("hours", F.round(F.col("hours") + 1e-9, 6))


@query("J16_seen_before", "SELECT user_id, count(*) AS n, max(ts) AS latest FROM crossings GROUP BY user_id")
def j16(t: Tables) -> DataFrame:
    return t.crossings.groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("latest"))


_UNIT = "u AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM vectors)"


@query("F20_cosine", f"WITH {_UNIT} SELECT a.vec_id, round(list_cosine_similarity(a.e, b.e) + 1e-9, 6) AS cosine FROM u a JOIN u b ON b.vec_id = a.vec_id + 1")
def f20(t: Tables) -> DataFrame:
    a, b = t.vectors, t.vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("other")) + 1e-9, 6).alias("cosine"))


@query(
    "J17_gallery",
    f"""WITH {_UNIT}, s AS (SELECT p.vec_id AS probe_id, g.vec_id, list_cosine_similarity(p.e, g.e) AS cosine FROM u p, u g WHERE p.vec_id % 20 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY round(cosine, 9) DESC, vec_id) AS rn FROM s WHERE cosine >= 0.2), o AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY round(cosine, 9) DESC, vec_id) AS place FROM t WHERE rn <= 10 AND probe_id <> vec_id)
SELECT probe_id, vec_id, round(cosine + 1e-9, 6) AS cosine, CAST(place AS INTEGER) AS place FROM o WHERE place <= 5""",
)
def j17(t: Tables) -> DataFrame:
    """One-to-many search of a stated set of probes over the whole gallery."""
    found = J.gallery(t.vectors.filter("vec_id % 20 = 0"), t.vectors, least=0.2)
    return found.withColumn("cosine", F.round(F.col("cosine") + 1e-9, 6))


@query("J18_score_pairs", f"WITH {_UNIT} SELECT a.label = b.label AS genuine, count(*) AS n, round(avg(list_cosine_similarity(a.e, b.e)) + 1e-9, 6) AS mean FROM u a, u b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id GROUP BY 1")
def j18(t: Tables) -> DataFrame:
    """Genuine and impostor scores of a stated query set (every twentieth vector) against all."""
    return scores(t).groupBy("genuine").agg(F.count("*").alias("n"), F.round(F.avg("score") + 1e-9, 6).alias("mean"))


def scores(t: Tables) -> DataFrame:
    """(genuine, label, score) of every twentieth vector against all others."""
    return J.pair_scores(t.vectors.filter("vec_id % 20 = 0"), t.vectors)


@query("J20_class_map", "SELECT m.target, count(*) AS n FROM boxes b LEFT JOIN (VALUES ('dob', 'date'), ('name', 'text'), ('photo', NULL)) m(class, target) USING (class) GROUP BY 1")
def j20(t: Tables) -> DataFrame:
    """Source classes through a map with gaps: unmapped ones are counted under null."""
    table = t.spark.createDataFrame([("dob", "date"), ("name", "text"), ("photo", None)], "class string, target string")
    return t.boxes.join(F.broadcast(table), "class", "left").groupBy("target").agg(F.count("*").alias("n"))


@query("J22_events_by_id", "SELECT case_id, doc_type FROM cases WHERE case_id IN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def j22(t: Tables) -> DataFrame:
    wanted = t.lineitem.filter("l_quantity > 49").select(F.col("l_orderkey").alias("case_id")).distinct()
    return t.cases.join(wanted, "case_id", "left_semi").select("case_id", "doc_type")


@query("J23_anchor_lookup", "SELECT person_id, n_name AS issuer, n_nationkey IS NOT NULL AS known FROM people LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON k = n_nationkey")
def j23(t: Tables) -> DataFrame:
    anchors = J.dimension(t.nation.filter("n_nationkey < 20"))
    return t.people.join(anchors, F.col("k") == F.col("n_nationkey"), "left").select("person_id", F.col("n_name").alias("issuer"), F.col("n_nationkey").isNotNull().alias("known"))


@query("K2_latest_wins", "SELECT session_id, arg_max(case_id, (created_at, case_id)) AS case_id FROM cases GROUP BY session_id")
def k2(t: Tables) -> DataFrame:
    """Upsert by key as last writer wins."""
    return t.cases.groupBy("session_id").agg(F.max_by("case_id", F.struct("created_at", "case_id")).alias("case_id"))


@query("T1_event_page", "SELECT case_id, created_at FROM cases ORDER BY created_at DESC, case_id DESC LIMIT 50 OFFSET 100")
def t1(t: Tables) -> DataFrame:
    """A page of events, newest first."""
    return t.cases.select("case_id", "created_at").orderBy(F.desc("created_at"), F.desc("case_id")).offset(100).limit(50)


@query("T7_reading_order", "SELECT box_id, row_number() OVER (PARTITION BY image_id ORDER BY round_even(y1 / 24, 0), x1, box_id) AS place FROM boxes")
def t7(t: Tables) -> DataFrame:
    """Lines top to bottom within a tolerance, then left to right."""
    order = Window.partitionBy("image_id").orderBy(F.bround(F.col("y1") / 24, 0), "x1", "box_id")
    return t.boxes.select("box_id", F.row_number().over(order).cast("long").alias("place"))


@query("T8_line_window", "SELECT conv_id, min(turn) AS turn FROM (SELECT conv_id, turn, length(text) AS n, lead(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS m FROM conversations) WHERE n > 100 AND m > 100 GROUP BY conv_id")
def t8(t: Tables) -> DataFrame:
    """First pair of neighbouring lines that are both long enough."""
    n = F.length("text")
    pairs = t.conversations.select("conv_id", "turn", n.alias("n"), F.lead(n).over(Window.partitionBy("conv_id").orderBy("turn")).alias("m"))
    return pairs.filter("n > 100 and m > 100").groupBy("conv_id").agg(F.min("turn").alias("turn"))


@query("T11_sheets", "SELECT box_id, (rn - 1) // 12 AS sheet, (rn - 1) % 12 // 4 AS line, (rn - 1) % 4 AS slot FROM (SELECT box_id, row_number() OVER (PARTITION BY doc_type ORDER BY box_id) AS rn FROM boxes)")
def t11(t: Tables) -> DataFrame:
    """Cards on sheets of three lines by four."""
    rn = F.row_number().over(Window.partitionBy("doc_type").orderBy("box_id")).cast("long") - 1
    return t.boxes.select("box_id", rn.alias("rn")).select("box_id", F.floor(F.col("rn") / 12).alias("sheet"), F.floor(F.col("rn") % 12 / 4).alias("line"), (F.col("rn") % 4).alias("slot"))


@query("W6_run_length", "WITH o AS (SELECT user_id, event_id, value > 5 AS open, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, value > 5 ORDER BY event_id) AS island FROM events), r AS (SELECT user_id, open, island, count(*) AS n FROM o GROUP BY ALL) SELECT user_id, max(n) AS longest FROM r WHERE open GROUP BY user_id")
def w6(t: Tables) -> DataFrame:
    """Longest run of open frames per burst (gaps and islands; W6, P50)."""
    whole = Window.partitionBy("user_id").orderBy("event_id")
    is_open = F.col("value") > 5
    rows = t.events.withColumn("open", is_open).withColumn("island", F.row_number().over(whole) - F.row_number().over(Window.partitionBy("user_id", "open").orderBy("event_id")))
    return rows.filter("open").groupBy("user_id", "island").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.max("n").alias("longest"))


@query("W7_module_change", "SELECT case_id, count(*) FILTER (m IS DISTINCT FROM b) AS changes FROM (SELECT case_id, split_part(id, '.', 1) AS m, lag(split_part(id, '.', 1)) OVER (PARTITION BY case_id ORDER BY seq) AS b FROM signals) GROUP BY case_id")
def w7(t: Tables) -> DataFrame:
    """How often the module changes in a case's stream of signals."""
    m = F.split_part("id", F.lit("."), F.lit(1))
    before = F.lag(m).over(Window.partitionBy("case_id").orderBy("seq"))
    return t.signals.select("case_id", (~m.eqNullSafe(before)).alias("c")).groupBy("case_id").agg(F.count_if("c").alias("changes"))
