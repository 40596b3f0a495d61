"""Remaining rows of the inventory: rule tables, dispatch, quality gates, readers, paging and small lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import checks as C
from attesta.functions import scalars as S
from attesta.operators import fusion as X
from attesta.operators import joins as J

from . import rules as R
from .q_checks import _AADHAAR, aadhaars, d_verhoeff
from .q_etl import written
from .q_fusion import found_sql, ready_sql, signals
from .q_joins import _IOU
from .registry import query
from .views import Tables


def _values(rows: list[tuple], names: str) -> str:
    shown = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"CAST({x} AS DOUBLE)" for x in r) + ")" for r in rows)
    return f"(VALUES {shown}) v({names})"


_WEIGHTS = _values([(d, p, w) for d, own in R.WEIGHTS.items() for p, w in own.items()], "doc_type, pattern, weight")


@query("S1_profile_weights", f"SELECT doc_type, count(*) AS n, round(sum(weight) + 1e-9, 6) AS total FROM {_WEIGHTS} GROUP BY doc_type")
def s1(t: Tables) -> DataFrame:
    """Profiles as a dimension."""
    return R.weight_table(t.spark).groupBy("doc_type").agg(F.count("*").alias("n"), F.round(F.sum("weight") + 1e-9, 6).alias("total"))


@query("S3_profile_validation", f"SELECT DISTINCT doc_type, pattern FROM {_WEIGHTS} WHERE NOT EXISTS (SELECT 1 FROM signals s WHERE s.id = pattern OR (pattern LIKE '%.*' AND starts_with(s.id, left(pattern, length(pattern) - 1))))")
def s3(t: Tables) -> DataFrame:
    """Patterns of the profiles that match no id in use (anti join)."""
    used = t.signals.select("id").distinct()
    prefixes = F.transform(F.sequence(F.lit(1), F.size(F.split("id", r"\."))), lambda k: F.concat(F.array_join(F.slice(F.split("id", r"\."), F.lit(1), k), "."), F.lit(".*")))
    able = used.select(F.explode(F.array_union(F.array("id"), prefixes)).alias("pattern")).distinct()
    return R.weight_table(t.spark).join(able, "pattern", "left_anti").select("doc_type", "pattern")


@query("S9_seed_rows", "SELECT 'SEED' AS source, 'WANTED PERSON' AS name, 'PERSON WANTED' AS name_key, 'X9999999' AS doc_number")
def s9(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame([("SEED", "WANTED PERSON", "X9999999")], "source string, name string, doc_number string")
    return rows.withColumn("name_key", S.watchlist_key(F.col("name")))


@query("S15_labels_csv", "SELECT label, count(*) AS n FROM vectors GROUP BY label")
def s15(t: Tables) -> DataFrame:
    """A labels file with a header, read back and grouped."""
    path = written(t.vectors.select("vec_id", "label"), "csv", header=True)
    return t.spark.read.option("header", True).schema("vec_id long, label int").csv(path).groupBy("label").agg(F.count("*").alias("n"))


@query("S16_complete_people", "SELECT user_id, min(event_id) FILTER (event_type = 'click') AS doc_id, count(*) FILTER (event_type = 'purchase') AS n_live FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'click') > 0 AND count(*) FILTER (event_type = 'purchase') > 0")
def s16(t: Tables) -> DataFrame:
    """People with a first document and live frames; incomplete ones are left out."""
    doc, live = F.col("event_type") == "click", F.count_if(F.col("event_type") == "purchase")
    own = t.events.groupBy("user_id").agg(F.min(F.when(doc, F.col("event_id"))).alias("doc_id"), live.alias("n_live"))
    return own.filter("doc_id is not null and n_live > 0")


@query("P4_usable", "SELECT case_id FROM signals GROUP BY case_id HAVING count(*) FILTER (contains(id, '.quality.') AND verdict = 'fail') = 0")
def p4(t: Tables) -> DataFrame:
    bad = F.contains("id", F.lit(".quality.")) & (F.col("verdict") == "fail")
    return t.signals.groupBy("case_id").agg(F.count_if(bad).alias("n")).filter("n = 0").select("case_id")


@query("P8_located_fields", "SELECT image_id, 'extraction.field.' || class || '.confidence' AS id, max(confidence) AS confidence FROM boxes WHERE class IN ('dob', 'name') GROUP BY ALL")
def p8(t: Tables) -> DataFrame:
    """One pass for each declared class that was located."""
    declared = t.spark.createDataFrame([("dob",), ("name",)], "class string")
    own = t.boxes.join(F.broadcast(declared), "class").groupBy("image_id", "class").agg(F.max("confidence").alias("confidence"))
    return own.select("image_id", F.concat(F.lit("extraction.field."), "class", F.lit(".confidence")).alias("id"), "confidence")


@query(
    "P16_ratify",
    f"WITH {_AADHAAR} SELECT person_id, CASE WHEN person_id % 4 = 3 THEN 'not_applicable' WHEN {d_verhoeff('number', 0)} = 0 THEN 'pass' ELSE 'fail' END AS verdict, CASE WHEN person_id % 4 = 3 THEN NULL WHEN {d_verhoeff('number', 0)} = 0 THEN number END AS stored FROM numbers",
)
def p16(t: Tables) -> DataFrame:
    """A fallback reading is stored if its check digit holds and discarded if not; without an anchor it can't be ratified."""
    ok, _ = C.check_aadhaar(F.col("number"))
    none = F.col("person_id") % 4 == 3
    return aadhaars(t).select("person_id", F.when(none, "not_applicable").when(ok, "pass").otherwise("fail").alias("verdict"), F.when(~none & ok, F.col("number")).alias("stored"))


@query("P24_format_checks", "SELECT person_id, 'pass' AS dob, CASE WHEN person_id % 9 = 0 THEN 'fail' ELSE 'pass' END AS expiry, CASE WHEN nationality = 'ZZZ' THEN 'fail' ELSE 'pass' END AS nationality, 'pass' AS gender FROM people")
def p24(t: Tables) -> DataFrame:
    """Layer B: dates, nationality, gender."""
    mark = lambda c: F.when(c, "pass").otherwise("fail")
    expiry = F.when(F.col("person_id") % 9 == 0, "32/01/2030").otherwise(F.col("expiry"))
    return t.people.select("person_id", mark(S.iso_date(F.col("dob")).isNotNull()).alias("dob"), mark(S.iso_date(expiry).isNotNull()).alias("expiry"), mark(F.upper("nationality").isin("IND", "GBR", "D")).alias("nationality"), mark(S.gender(F.col("sex")).isNotNull()).alias("gender"))


CHECKS = [("tamper.digital.ela", 1), ("tamper.digital.exif_software", 1), ("tamper.digital.copy_move", 2), ("tamper.physical.halftone", 1), ("tamper.digital.ela", 1)]
BLOCKED = ["tamper.physical.halftone", "tamper.physical.guilloche_break", "tamper.stamp.duplicate", "tamper.stamp.date_logic", "tamper.stamp.count_mismatch"]


@query("P35_tamper_dispatch", "SELECT case_id, id, CASE WHEN id = 'tamper.physical.halftone' THEN 'inconclusive' ELSE 'run' END AS action FROM cases, (VALUES ('tamper.digital.ela'), ('tamper.digital.exif_software'), ('tamper.physical.halftone')) v(id) UNION ALL SELECT case_id, 'tamper.digital.copy_move', 'run' FROM cases WHERE case_id % 2 = 0")
def p35(t: Tables) -> DataFrame:
    """Declared checks of a case, each once; blocked ones stay open, second-tier ones wait for an escalation."""
    seen = dict(CHECKS)
    plan = F.explode(F.array(*(F.struct(F.lit(i).alias("id"), F.lit(tier).alias("tier")) for i, tier in seen.items()))).alias("c")
    rows = t.cases.select("case_id", plan).select("case_id", "c.id", "c.tier").filter((F.col("tier") == 1) | (F.col("case_id") % 2 == 0))
    return rows.select("case_id", "id", F.when(F.col("id").isin(BLOCKED), "inconclusive").otherwise("run").alias("action"))


@query("P44_glyph_heights", "SELECT image_id, arg_max(class, (round(cv, 9), class)) AS class, round(max(cv) + 1e-9, 6) AS cv, CASE WHEN round(max(cv), 9) >= 0.22 THEN 'fail' ELSE 'pass' END AS verdict FROM (SELECT image_id, class, stddev_pop(y2 - y1) / avg(y2 - y1) AS cv FROM boxes GROUP BY ALL) GROUP BY image_id")
def p44(t: Tables) -> DataFrame:
    """Worst coefficient of variation of heights among an image's crops."""
    height = F.col("y2") - F.col("y1")
    per = t.boxes.groupBy("image_id", "class").agg((F.stddev_pop(height) / F.avg(height)).alias("cv"))
    worst = F.max("cv")
    return per.groupBy("image_id").agg(F.max_by("class", F.struct(F.round("cv", 9), "class")).alias("class"), F.round(worst + 1e-9, 6).alias("cv"), F.when(F.round(worst, 9) >= 0.22, "fail").otherwise("pass").alias("verdict"))


_PAIR = "WITH u AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM vectors), s AS (SELECT a.vec_id, round(list_cosine_similarity(a.e, b.e), 9) AS c FROM u a LEFT JOIN u b ON b.vec_id = a.vec_id + 10)"


@query("P48_face_match", _PAIR + " SELECT vec_id, CASE WHEN c IS NULL THEN 'inconclusive' WHEN c >= 0.32 THEN 'pass' ELSE 'fail' END AS verdict, round(CASE WHEN c IS NULL THEN 0 ELSE least(1, abs(c - 0.32) / 0.06) END + 1e-9, 6) AS confidence FROM s")
def p48(t: Tables) -> DataFrame:
    """One-to-one match with certainty over the review band; a missing side stays open."""
    other = t.vectors.select((F.col("vec_id") - 10).alias("vec_id"), F.col("embedding").alias("live"))
    c = F.round(S.cosine(F.col("embedding"), F.col("live")), 9)
    rows = t.vectors.join(other, "vec_id", "left").select("vec_id", F.when(F.col("live").isNotNull(), c).alias("c"))
    verdict = F.when(F.col("c").isNull(), "inconclusive").when(F.col("c") >= 0.32, "pass").otherwise("fail")
    return rows.select("vec_id", verdict.alias("verdict"), F.round(F.when(F.col("c").isNull(), F.lit(0.0)).otherwise(S.certainty(F.col("c"), 0.26, 0.38)) + 1e-9, 6).alias("confidence"))


@query("P51_not_deployed", "SELECT case_id, id, 'inconclusive' AS verdict FROM cases, (VALUES ('face.doc.detected'), ('face.doc.quality'), ('face.live.detected'), ('face.live.quality'), ('face.match.cosine')) v(id)")
def p51(t: Tables) -> DataFrame:
    ids = F.explode(F.array(*map(F.lit, ["face.doc.detected", "face.doc.quality", "face.live.detected", "face.live.quality", "face.match.cosine"]))).alias("id")
    return t.cases.select("case_id", ids, F.lit("inconclusive").alias("verdict"))


@query("P54_disclosure", "SELECT case_id, CASE WHEN status = 'F' AND case_id % 2 = 0 THEN 'Signed by the reference issuer' END AS disclosure FROM cases")
def p54(t: Tables) -> DataFrame:
    shown = (F.col("status") == "F") & (F.col("case_id") % 2 == 0)
    return t.cases.select("case_id", F.when(shown, "Signed by the reference issuer").alias("disclosure"))


@query("P57_layer_union", "SELECT person_id, 1 AS layer, 'dob' AS check_name FROM people UNION ALL SELECT person_id, 2, 'sex' FROM people WHERE sex <> '<' UNION ALL SELECT person_id, 3, 'number' FROM people WHERE person_id % 2 = 0")
def p57(t: Tables) -> DataFrame:
    """Layers one after the other, in a fixed order."""
    layer = lambda df, n, name: df.select("person_id", F.lit(n).alias("layer"), F.lit(name).alias("check_name"))
    return layer(t.people, 1, "dob").unionByName(layer(t.people.filter("sex <> '<'"), 2, "sex")).unionByName(layer(t.people.filter("person_id % 2 = 0"), 3, "number"))


@query("J5_first_read_per_field", f"SELECT b.box_id AS field_id, arg_min(a.box_id, (a.ordinal, a.box_id)) AS read_id FROM boxes a JOIN boxes b ON a.image_id = b.image_id AND a.class = b.class WHERE a.box_id <> b.box_id AND {_IOU} > 0.1 GROUP BY b.box_id")
def j5(t: Tables) -> DataFrame:
    """Reads that overlap a field's box; the first of them keeps it."""
    own = t.boxes.select("image_id", "box_id", "class", "ordinal", "x1", "y1", "x2", "y2")
    return J.best_partners(own, ["image_id", "class"], 0.10, False).select(F.col("box_id").alias("field_id"), F.col("other_id").alias("read_id"))


@query("J14_other_sessions", "SELECT a.event_id, count(*) AS n FROM crossings a JOIN crossings b ON a.user_id = b.user_id AND a.post_id <> b.post_id GROUP BY a.event_id")
def j14(t: Tables) -> DataFrame:
    """Crossings of the same holder elsewhere: counts per holder and post, not pairs."""
    per_post = t.crossings.groupBy("user_id", "post_id").agg(F.count("*").alias("c"))
    total = per_post.groupBy("user_id").agg(F.sum("c").alias("all"))
    asked = t.crossings.select("event_id", "user_id", "post_id")
    return asked.join(total, "user_id").join(per_post, ["user_id", "post_id"]).select("event_id", (F.col("all") - F.col("c")).alias("n")).filter("n > 0")


@query("J12_near_names")
def j12(t: Tables) -> DataFrame:
    """Names that sound alike with their match ratio; difflib has no SQL."""
    from .q_joins import documents

    return J.watchlist(documents(t), t.listed).filter("how = 'near'").select("doc_id", "listed_id", "confidence")


@query("T2_session_events", "SELECT session_id, string_agg(CAST(case_id AS STRING), ',' ORDER BY created_at, case_id) AS cases FROM cases GROUP BY session_id")
def t2(t: Tables) -> DataFrame:
    own = F.array_sort(F.collect_list(F.struct("created_at", "case_id")))
    return t.cases.groupBy("session_id").agg(own.alias("c")).select("session_id", F.array_join(F.transform("c", lambda x: x["case_id"].cast("string")), ",").alias("cases"))


@query("T9_version_pick", "SELECT doc_type, arg_min(box_id, (abs(ordinal - 25), -box_id)) AS version FROM boxes GROUP BY doc_type")
def t9(t: Tables) -> DataFrame:
    """The version nearest in size, the latest among equals."""
    return t.boxes.groupBy("doc_type").agg(F.min_by("box_id", F.struct(F.abs(F.col("ordinal") - 25).alias("d"), (-F.col("box_id")).alias("v"))).alias("version"))


@query("F29_payload", "SELECT person_id, CASE WHEN sex = '<' THEN 'dob,name' ELSE 'dob,gender,name' END AS fields FROM people")
def f29(t: Tables) -> DataFrame:
    """Payload maps without their empty fields."""
    full = F.create_map(F.lit("name"), F.col("given"), F.lit("dob"), F.col("dob"), F.lit("gender"), F.when(F.col("sex") != "<", F.col("sex")))
    return t.people.select("person_id", F.array_join(F.array_sort(F.map_keys(F.map_filter(full, lambda _, v: v.isNotNull()))), ",").alias("fields"))


@query("F36_gallery_sentence", "SELECT vec_id, 'field:person_photo' AS anchor, printf('Similarity %.2f with %d earlier records', abs(CAST(embedding[1] AS DOUBLE)), label) AS sentence FROM vectors")
def f36(t: Tables) -> DataFrame:
    text = F.format_string("Similarity %.2f with %d earlier records", F.abs(F.get("embedding", F.lit(0)).cast("double")), "label")
    return t.vectors.select("vec_id", F.concat(F.lit("field:"), F.lit("person_photo")).alias("anchor"), text.alias("sentence"))


@query("F37_pixel_box", "SELECT box_id, round(greatest(0, least(320, x1 * 0.9::DOUBLE - 10)) + 1e-9, 6) AS left_px, round(greatest(0, least(320, x2 * 0.9::DOUBLE - 10)) + 1e-9, 6) AS right_px FROM boxes")
def f37(t: Tables) -> DataFrame:
    from attesta.sources.annotations import corners

    norm = t.boxes.select("box_id", ((F.col("x1") + F.col("x2")) / 2 * 0.9 / 320 - 10 / 320).alias("cx"), F.lit(0.5).alias("cy"), ((F.col("x2") - F.col("x1")) * 0.9 / 320).alias("w"), F.lit(0.1).alias("h"))
    r = norm.select("box_id", corners(320, 200).alias("r"))
    return r.select("box_id", F.round(F.col("r.x1") + 1e-9, 6).alias("left_px"), F.round(F.col("r.x2") + 1e-9, 6).alias("right_px"))


@query("Q7_health", "SELECT (SELECT count(DISTINCT doc_type) FROM cases) AS n_profiles, (SELECT count(*) FROM nation) AS n_anchors, (SELECT count(*) FROM listed) AS n_listed, 4 AS n_posts")
def q7(t: Tables) -> DataFrame:
    """Counts that a health check shows."""
    one = t.cases.agg(F.count_distinct("doc_type").alias("n_profiles")).join(t.nation.agg(F.count("*").alias("n_anchors")), F.lit(True)).join(t.listed.agg(F.count("*").alias("n_listed")), F.lit(True))
    return one.withColumn("n_posts", F.lit(len(R.POSTS)))


@query("Q4_weight_override", "SELECT id, CASE WHEN id = 'face.match.cosine' THEN 0.15 WHEN starts_with(id, 'face.liveness.') THEN 0.4 WHEN starts_with(id, 'face.') THEN 0.1 END::DOUBLE AS weight FROM signals WHERE starts_with(id, 'face.') GROUP BY id")
def q4(t: Tables) -> DataFrame:
    """Overrides change or add patterns; the longest still wins (Q3, Q4, Q10)."""
    rules = R.DEFAULT.override({"face.liveness.*": 0.4})
    ids = t.signals.filter("startswith(id, 'face.')").select("id").distinct().withColumn("doc_type", F.lit("pan"))
    return ids.select("id", X.weight_of(rules).alias("weight"))


@query("R8_replay", "SELECT case_id, count(*) AS n_signals, count(*) FILTER (verdict = 'fail') AS n_failed FROM signals GROUP BY case_id")
def r8(t: Tables) -> DataFrame:
    """Stored cases replayed as an ordered stream of messages."""
    own = signals(t)
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("seq"))
    return own.withColumn("n", place).groupBy("case_id").agg(F.max("n").cast("long").alias("n_signals"), F.count_if(F.col("verdict") == "fail").alias("n_failed"))


@query("R11_results_by_id", "SELECT c.case_id, c.status, o.o_totalprice AS amount FROM cases c JOIN orders o ON o.o_orderkey = c.case_id")
def r11(t: Tables) -> DataFrame:
    """Results are matched by id, never by position."""
    results = t.orders.select(F.col("o_orderkey").alias("case_id"), F.col("o_totalprice").alias("amount"))
    return t.cases.select("case_id", "status").join(results, "case_id")


@query(
    "A17_client_rows",
    f"""WITH {ready_sql()}, {found_sql()}, h AS (SELECT case_id, anchor, id FROM ready WHERE hard_fail AND verdict = 'fail'),
told AS (SELECT r.case_id, r.anchor FROM ready r LEFT JOIN (SELECT DISTINCT case_id, id FROM h) x ON x.case_id = r.case_id AND x.id = r.id WHERE r.verdict <> 'not_applicable' GROUP BY r.case_id, r.anchor HAVING count(*) = count(x.id))
SELECT case_id, 'hard_fail' AS kind, anchor, id FROM h UNION ALL
SELECT f.case_id, 'finding', f.anchor, '' FROM found f WHERE NOT (severity > 0 AND EXISTS (SELECT 1 FROM h WHERE h.case_id = f.case_id AND h.anchor = f.anchor)) AND NOT EXISTS (SELECT 1 FROM told t WHERE t.case_id = f.case_id AND t.anchor = f.anchor)""",
)
def a17(t: Tables) -> DataFrame:
    """Evidence rows in the client's folding."""
    return X.client_rows(signals(t)).select("case_id", "kind", "anchor", "id")


@query("F28_number_builders", "SELECT i AS person_id, chr(CAST(65 + i * 7 % 26 AS INT)) || lpad(CAST(i * 7919 % 10000000 AS STRING), 7, '0') AS number FROM range(0, 3000) r(i)")
def f28(t: Tables) -> DataFrame:
    """Document numbers from row numbers, the same in every run."""
    i = F.col("id")
    letter = F.chr((65 + i * 7 % 26).cast("long"))
    return t.spark.range(3000).select(i.alias("person_id"), F.concat(letter, F.lpad((i * 7919 % 10000000).cast("string"), 7, "0")).alias("number"))


@query("F35_printed_values", "SELECT person_id, CASE person_id % 3 WHEN 0 THEN upper(given || ' ' || surname) WHEN 1 THEN substr(dob, 9, 2) || '/' || substr(dob, 6, 2) || '/' || substr(dob, 1, 4) ELSE regexp_replace(digits11, '(.{4})(.{4})(.*)', '\\1 \\2 \\3') END AS printed FROM people")
def f35(t: Tables) -> DataFrame:
    """What a card prints for a field: names upper case, dates day first, numbers in groups."""
    k = F.col("person_id") % 3
    day = F.date_format(F.to_date("dob"), "dd/MM/yyyy")
    return t.people.select("person_id", F.when(k == 0, F.upper(F.concat_ws(" ", "given", "surname"))).when(k == 1, day).otherwise(S.group_digits(F.col("digits11"))).alias("printed"))


@query("K6_event_sink", "SELECT case_id, seq, split_part(id, '.', 1) AS module FROM signals")
def k6(t: Tables) -> DataFrame:
    """Messages written as JSON lines and read back (K6)."""
    rows = t.signals.select("case_id", "seq", F.to_json(F.struct("id", "verdict", "confidence")).alias("payload"))
    back = t.spark.read.schema("case_id long, seq long, payload string").json(written(rows, "json"))
    return back.select("case_id", "seq", F.split_part(F.get_json_object("payload", "$.id"), F.lit("."), F.lit(1)).alias("module"))


@query("A2_grouped_anchors", "SELECT case_id, count(DISTINCT anchor) AS n_findings FROM signals WHERE verdict <> 'not_applicable' GROUP BY case_id")
def a2(t: Tables) -> DataFrame:
    """One finding for each anchor that has an applicable signal."""
    return X.findings(X.prepared(signals(t))).groupBy("case_id").agg(F.count("*").alias("n_findings"))


@query("W2_longest_pattern_rank", f"SELECT id, arg_max(pattern, length(pattern)) AS pattern FROM (SELECT DISTINCT id FROM signals) s JOIN {_WEIGHTS} ON v.doc_type = 'pan' AND (v.pattern = s.id OR (v.pattern LIKE '%.*' AND starts_with(s.id, left(v.pattern, length(v.pattern) - 1)))) GROUP BY id")
def w2(t: Tables) -> DataFrame:
    """The pattern that wins for each id."""
    table = R.weight_table(t.spark).filter("doc_type = 'pan'").select("pattern", F.col("pattern").alias("winner"))
    return X.resolve_patterns(t.signals, table, "winner").select("id", F.col("winner").alias("pattern"))
