"""Rows of the inventory that share an operator with another one, each as a query of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import mrz as M
from attesta.operators import capture as K
from attesta.operators import fusion as X
from attesta.operators import joins as J
from attesta.operators import stats as ST
from attesta.operators import validation as V
from attesta.session import new_place
from attesta.streaming import sessions as R_

from . import rules as R
from .q_checks import d_check_digit, strips, today
from .q_etl import written
from .q_fusion import found_sql, ready_sql, rounded, signals, verdict_sql
from .q_joins import _UNIT
from .registry import query
from .views import Tables

# Captures made from parts, in SQL that both engines read.
CAPTURES = """SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'scanner' WHEN 1 THEN 'upload' ELSE 'camera' END AS source, CAST(60 + p_partkey * 7 % 300 AS DOUBLE) AS sharpness,
 CAST(500 + p_size * 13 AS INT) AS width, CAST(600 + p_partkey % 400 AS INT) AS height, CAST(30 + p_partkey * 11 % 210 AS DOUBLE) AS brightness, CAST(p_partkey % 9 AS DOUBLE) / 100 AS glare FROM part"""


@query(
    "P6_submit_gate",
    f"""WITH c AS ({CAPTURES}), g AS (SELECT id, sharpness >= CASE source WHEN 'camera' THEN 220 ELSE 140 END AS sharpness, least(width, height) >= 700 AS resolution, brightness BETWEEN 55 AND 215 AS brightness, glare < 0.04 AS glare FROM c)
SELECT *, sharpness AND resolution AS submittable FROM g""",
)
def p6(t: Tables) -> DataFrame:
    """The client's capture gate, with its own thresholds."""
    gate = K.submit_gate(*(F.col(c) for c in ("source", "sharpness", "width", "height", "brightness", "glare")))
    return t.sql(CAPTURES).select("id", gate.alias("g")).select("id", "g.*")


@query("P3_brightness", f"SELECT id, CASE WHEN brightness >= 40 AND brightness <= 215 THEN 'pass' ELSE 'fail' END AS verdict, CASE WHEN brightness >= 40 AND brightness <= 215 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM ({CAPTURES})")
def p3(t: Tables) -> DataFrame:
    good = F.col("brightness").between(40, 215)
    return t.sql(CAPTURES).select("id", F.when(good, "pass").otherwise("fail").alias("verdict"), F.when(good, 1.0).otherwise(0.7).alias("confidence"))


@query("P7_doctype", "SELECT case_id, CASE WHEN status = 'P' THEN 'inconclusive' ELSE 'not_applicable' END AS verdict, CASE WHEN status = 'P' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM cases")
def p7(t: Tables) -> DataFrame:
    """Type chosen at the counter or not (cases in status P have none)."""
    declared = F.when(F.col("status") != "P", F.col("doc_type"))
    return t.cases.select("case_id", K.document_type(declared).alias("s")).select("case_id", "s.*")


# Readings of people: a date in several forms, in fragments, empty, faint, or not a date.
READINGS = """SELECT person_id, 'dob' AS field, CASE person_id % 6 WHEN 0 THEN '' WHEN 1 THEN '31/31/1990' WHEN 2 THEN substr(dob, 1, 5) || ' ' || substr(dob, 6) WHEN 3 THEN substr(dob, 9, 2) || '/' || substr(dob, 6, 2) || '/' || substr(dob, 1, 4) ELSE dob END AS text,
 CAST(40 + person_id % 60 AS DOUBLE) / 100 AS confidence, dob FROM people"""


@query(
    "P10_reader_confidence",
    f"WITH r AS ({READINGS}), v AS (SELECT *, person_id % 6 > 1 AND 40 + person_id % 60 >= 55 AS good FROM r) SELECT person_id, CASE WHEN good THEN 'pass' ELSE 'inconclusive' END AS verdict, CASE WHEN good THEN confidence ELSE 0.0::DOUBLE END AS confidence, CASE WHEN good THEN dob END AS value FROM v",
)
def p10(t: Tables) -> DataFrame:
    """Read fields: empty, faint or no valid value stays open; fragments are joined."""
    from .views import VIEWS

    rows = t.sql(READINGS.replace("FROM people", f"FROM ({VIEWS['people']})"))
    return rows.select("person_id", K.reading(F.col("field"), F.col("text"), F.col("confidence")).alias("s")).select("person_id", "s.*")


@query(
    "P15_normalise",
    "SELECT person_id, 'dob' AS field, dob AS value FROM people UNION ALL SELECT person_id, 'gender', sex FROM people UNION ALL SELECT person_id, 'id_number', upper(doc_number) FROM people UNION ALL SELECT person_id, 'name', given || ' ' || surname FROM people",
)
def p15(t: Tables) -> DataFrame:
    """Every field by its own rule; what isn't a value is dropped."""
    day = F.concat(F.substring("dob", 9, 2), F.lit("."), F.substring("dob", 6, 2), F.lit("."), F.substring("dob", 1, 4))
    number = F.concat(F.lower(F.substring("doc_number", 1, 1)), F.lit("-"), F.substring("doc_number", 2, 20))
    raw = F.create_map(F.lit("dob"), day, F.lit("gender"), F.lower("sex"), F.lit("id_number"), number, F.lit("name"), F.concat_ws(" - ", F.lower("given"), "surname"), F.lit("expiry_date"), F.lit("99/99/2020"))
    rows = t.people.select("person_id", F.explode(raw).alias("field", "text"))
    return rows.select("person_id", "field", K.normalised(F.col("field"), F.col("text")).alias("value")).filter("value is not null")


@query("P12_verified_zones", "SELECT person_id FROM people WHERE person_id % 5 <> 0 OR substr(dob, 3, 1) = '8'")
def p12(t: Tables) -> DataFrame:
    """Zones from the fixed place: kept only if all their check digits verify."""
    digits = M.check_fields(F.col("strip"))
    return strips(t).filter(F.forall(digits, lambda d: M.verify(d["value"], d["digit"]))).select("person_id")


@query("P11_zone_geometry", "SELECT person_id, CASE WHEN person_id % 4 = 0 THEN 'inconclusive' ELSE 'pass' END AS verdict FROM people")
def p11(t: Tables) -> DataFrame:
    """Zones from a detector's crop: their form alone decides, wrong check digits included."""
    cut = F.when(F.col("person_id") % 4 == 0, F.substring("strip", 1, 80)).otherwise(F.col("strip"))
    form = M.parse(cut, today())["format"]
    return strips(t).select("person_id", F.when(form.isNotNull(), "pass").otherwise("inconclusive").alias("verdict"))


@query("P19_fallback_states", "SELECT case_id, 'inconclusive' AS verdict, 0.0::DOUBLE AS confidence FROM cases WHERE case_id % 5 < 4")
def p19(t: Tables) -> DataFrame:
    """What a fallback that gave nothing leaves: an open signal for each of its four states."""
    status = F.get(F.array(*map(F.lit, ["unavailable", "timed_out", "failed", "read_nothing", "read"])), (F.col("case_id") % 5).cast("int"))
    return t.cases.select("case_id", K.fallback_state(status).alias("s")).filter("s is not null").select("case_id", "s.*")


_PAYLOADS = """SELECT case_id, doc_type IN ('aadhaar', 'passport', 'visa') AS declared, CASE WHEN status = 'P' THEN NULL ELSE 'blob' END AS envelope,
 CASE case_id % 5 WHEN 0 THEN 'AUTHENTIC' WHEN 1 THEN 'INVALID_SIGNATURE' WHEN 2 THEN 'UNKNOWN_ISSUER' WHEN 3 THEN 'REVOKED' ELSE 'MALFORMED' END AS state, CASE WHEN case_id % 5 < 4 THEN 'issuer-' || CAST(case_id % 7 AS STRING) END AS issuer FROM cases"""


def signed(t: Tables) -> DataFrame:
    from .views import VIEWS

    rows = t.sql(_PAYLOADS.replace("FROM cases", f"FROM ({VIEWS['cases']})"))
    found = K.signature(F.col("declared"), F.col("envelope"), F.lit(3), F.col("state"), F.col("issuer"))
    return rows.select("case_id", F.explode(found).alias("s")).select("case_id", "s.*")


@query(
    "P20_signature_valid",
    f"SELECT case_id, CASE WHEN NOT declared THEN 'not_applicable' WHEN envelope IS NULL THEN 'inconclusive' WHEN state = 'AUTHENTIC' THEN 'pass' ELSE 'fail' END AS verdict, CASE WHEN declared AND envelope IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS confidence, CASE WHEN declared AND envelope IS NOT NULL THEN 'cryptographic' ELSE 'unverified' END AS trust_class FROM ({_PAYLOADS})",
)
def p20(t: Tables) -> DataFrame:
    """The signature's own signal, with its branches that aren't applicable or stay open."""
    return signed(t).filter("id = 'validation.signature.valid'").drop("id")


@query("P21_issuer_trusted", f"SELECT case_id, CASE WHEN state = 'UNKNOWN_ISSUER' THEN 'fail' ELSE 'pass' END AS verdict FROM ({_PAYLOADS}) WHERE declared AND envelope IS NOT NULL AND issuer IS NOT NULL")
def p21(t: Tables) -> DataFrame:
    """Only for payloads that name an issuer."""
    return signed(t).filter("id = 'validation.signature.issuer_trusted'").select("case_id", "verdict")


@query("P25_nationality", "SELECT person_id, CASE WHEN nationality IN ('IND', 'GBR', 'D') THEN 'pass' ELSE 'fail' END AS verdict, 1.0::DOUBLE AS confidence FROM people WHERE sex <> '<'")
def p25(t: Tables) -> DataFrame:
    """Printed nationalities against the table of codes, where one was read."""
    codes = J.dimension(t.spark.createDataFrame([("IND",), ("GBR",), ("D",)], "code string").withColumn("known", F.lit(True)))
    value = F.when(F.col("sex") != "<", F.col("nationality"))
    rows = t.people.select("person_id", value.alias("value")).join(codes, F.upper("value") == F.col("code"), "left")
    return rows.select("person_id", K.nationality(F.col("value"), F.coalesce("known", F.lit(False)), F.lit(True)).alias("s")).filter("s is not null").select("person_id", "s.*")


@query("P26_gender", "SELECT person_id, CASE WHEN person_id % 4 = 0 THEN 'fail' ELSE 'pass' END AS verdict FROM people")
def p26(t: Tables) -> DataFrame:
    value = F.when(F.col("person_id") % 4 == 0, "Q").otherwise(F.lower("sex"))
    return t.people.select("person_id", K.gender(value)["verdict"].alias("verdict"))


@query("P34_source_guards", "SELECT person_id, source, source IN ('ocr', 'mrz', 'qr') AS comparable, source IN ('ocr', 'mrz', 'vlm') AS printed FROM (SELECT person_id, CASE person_id % 4 WHEN 0 THEN 'ocr' WHEN 1 THEN 'mrz' WHEN 2 THEN 'qr' ELSE 'vlm' END AS source FROM people)")
def p34(t: Tables) -> DataFrame:
    """Which sources may dispute a proven value, and which are ink."""
    source = F.get(F.array(*map(F.lit, V.PRIORITY)), (F.col("person_id") % 4).cast("int"))
    return t.people.select("person_id", source.alias("source")).select("person_id", "source", F.col("source").isin(V.COMPARABLE).alias("comparable"), F.col("source").isin(V.PRINTED).alias("printed"))


@query("P42_ghost_portrait", f"WITH c AS ({CAPTURES}), m AS (SELECT id, id % 11 > 0 AS located, id % 7 > 0 AS photo, id % 5 > 0 AS ghost, CASE WHEN id % 13 = 0 THEN -1.0 ELSE 0.8 + glare * 2 END AS a FROM c) SELECT id, CASE WHEN NOT located OR NOT photo THEN 'inconclusive' WHEN NOT ghost THEN 'fail' WHEN a < 0 THEN 'inconclusive' WHEN round(a, 9) < 0.9 THEN 'fail' ELSE 'pass' END AS verdict, round(CAST(CASE WHEN NOT located OR NOT photo THEN 0 WHEN NOT ghost THEN 0.6 WHEN a < 0 THEN 0 WHEN round(a, 9) < 0.9 THEN least(0.9, 1.3 - a) ELSE 0.7 END AS DOUBLE) + 1e-9, 6) AS confidence FROM m")
def p42(t: Tables) -> DataFrame:
    """The faded second portrait: missing, unreadable, another face, or the same."""
    k = F.col("id")
    agreement = F.round(F.when(k % 13 == 0, -1.0).otherwise(0.8 + F.col("glare") * 2), 9)
    s = K.ghost_portrait(k % 11 > 0, k % 7 > 0, k % 5 > 0, agreement)
    return t.sql(CAPTURES).select("id", s.alias("s")).select("id", "s.verdict", F.round(F.col("s.confidence") + 1e-9, 6).alias("confidence"))


@query("P46_face_detected", "SELECT id, CASE WHEN id % 10 = 0 THEN 'inconclusive' WHEN id % 4 = 0 THEN 'fail' ELSE 'pass' END AS verdict, CAST(CASE WHEN id % 10 = 0 THEN 0 WHEN id % 4 = 0 THEN 0.85 WHEN id % 4 = 1 THEN 0.9 ELSE 0.7 END AS DOUBLE) AS confidence FROM (SELECT p_partkey AS id FROM part)")
def p46(t: Tables) -> DataFrame:
    """Faces not looked for, not found, found at once or only after help."""
    k = F.col("p_partkey")
    how = F.get(F.array(F.lit(None), F.lit("direct"), F.lit("denoised"), F.lit("region")), (k % 4).cast("int"))
    return t.part.select(k.alias("id"), K.face_found(k % 10 != 0, how).alias("s")).select("id", "s.*")


@query("P47_face_quality", f"WITH m AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'live' ELSE 'doc' END AS side, (width - 500) / 6.5 AS w, sharpness / 3 AS s, abs(brightness - 130) / 200 AS yaw FROM ({CAPTURES})), p AS (SELECT *, CASE side WHEN 'live' THEN 80 ELSE 48 END AS lw, CASE side WHEN 'live' THEN 80 ELSE 30 END AS ls FROM m) SELECT id, CASE WHEN w < lw THEN 'width' WHEN s < ls THEN 'sharpness' WHEN round(yaw, 9) > 0.35 THEN 'yaw' END AS problem, round(CASE WHEN w < lw THEN 0.9 WHEN s < ls THEN least(0.95, 0.5 + (ls - s) / ls) WHEN round(yaw, 9) > 0.35 THEN 0.8 ELSE 0.85 END + 1e-9, 6)::DOUBLE AS confidence FROM p")
def p47(t: Tables) -> DataFrame:
    """First failing measure of a face, by side; the yaw from its landmarks."""
    eye = lambda x: F.struct(F.lit(x).alias("x"), F.lit(0.0).alias("y"))
    nose = F.struct(F.col("brightness").alias("x"), F.lit(9.0).alias("y"))
    turned = F.round(K.yaw(eye(30.0), eye(230.0), nose), 9)
    s = K.face_quality(F.when(F.col("id") % 2 == 0, "live").otherwise("doc"), (F.col("width") - 500) / 6.5, F.col("sharpness") / 3, turned)
    return t.sql(CAPTURES).select("id", s.alias("s")).select("id", "s.problem", F.round(F.col("s.confidence") + 1e-9, 6).alias("confidence"))


_BURST = "SELECT user_id, list(value > 5 ORDER BY event_id) AS f, string_agg(CASE WHEN value > 5 THEN 'o' ELSE 'c' END, '' ORDER BY event_id) AS s FROM events GROUP BY user_id"


@query("P50_active_liveness", f"WITH b AS ({_BURST}), m AS (SELECT user_id, len(f) AS n, len(list_filter(f, lambda x: NOT x)) AS shut, s FROM b), g AS (SELECT *, n >= 4 AND 300 + user_id % 50 >= 320 AND n - shut >= 2 AND regexp_matches(s, 'oc+o') AS good FROM m) SELECT user_id, CASE WHEN good THEN 'pass' ELSE 'inconclusive' END AS verdict, CAST(CASE WHEN good THEN least(1.0, shut / 2) ELSE 0 END AS DOUBLE) AS confidence FROM g")
def p50(t: Tables) -> DataFrame:
    """A blink in each user's burst of frames; a burst is short by nature."""
    frames = F.transform(F.array_sort(F.collect_list(F.struct("event_id", (F.col("value") > 5).alias("open")))), lambda x: x["open"])
    bursts = t.events.groupBy("user_id").agg(frames.alias("f"))
    return bursts.select("user_id", K.blink(F.col("f"), (300 + F.col("user_id") % 50).cast("double")).alias("s")).select("user_id", "s.*")


@query("P56_upload_dispatch", "SELECT id, source = 'upload' AS runs FROM (" + CAPTURES + ") WHERE source <> 'camera'")
def p56(t: Tables) -> DataFrame:
    """Checks of files run on uploads only; a scanner's are not applicable, a camera's not listed."""
    return t.sql(CAPTURES).filter("source <> 'camera'").select("id", (F.col("source") == "upload").alias("runs"))


@query("F7_check_digit", f"SELECT person_id, {d_check_digit('doc_number')} AS digit, {d_check_digit('doc_number')} = CAST(person_id % 10 AS STRING) AS ok FROM people")
def f7(t: Tables) -> DataFrame:
    """The weighted check digit and its comparison."""
    return t.people.select("person_id", M.check_digit(F.col("doc_number")).alias("digit"), M.verify(F.col("doc_number"), (F.col("person_id") % 10).cast("string")).alias("ok"))


@query("F9_zone_dates", "SELECT person_id, strftime(CASE WHEN b > DATE '2026-09-06' THEN b - INTERVAL 100 YEAR ELSE b END, '%Y-%m-%d') AS birth FROM (SELECT person_id, CAST('20' || substr(dob, 3) AS DATE) AS b FROM people)")
def f9(t: Tables) -> DataFrame:
    """Two-digit years of birth: never ahead of today."""
    short = F.concat(F.substring("dob", 3, 2), F.substring("dob", 6, 2), F.substring("dob", 9, 2))
    return t.people.select("person_id", M.parse_date(short, today(), True).alias("birth"))


@query("F17_equal_names", "SELECT a.person_id FROM people a WHERE a.given = a.surname OR a.person_id % 2 = 0")
def f17(t: Tables) -> DataFrame:
    """The match ratio is 1 for equal strings and below for others (difflib itself is tested against fixed vectors)."""
    other = F.when(F.col("person_id") % 2 == 0, F.col("given")).otherwise(F.col("surname"))
    return t.people.filter(J.ratio(F.col("given"), other) == 1.0).select("person_id")


def ready(t: Tables) -> DataFrame:
    return X.prepared(signals(t))


@query("A3_dominant_member", f"WITH {ready_sql()}, {found_sql()} SELECT case_id, anchor, headline FROM found")
def a3(t: Tables) -> DataFrame:
    """The member a finding is told by: failures first, then class, certainty and order."""
    return X.findings(ready(t)).select("case_id", "anchor", "headline")


@query("A4_finding_trust", f"WITH {ready_sql()}, {found_sql()} SELECT rank, count(*) AS n FROM found GROUP BY rank")
def a4(t: Tables) -> DataFrame:
    """Findings by their trust class."""
    return X.findings(ready(t)).groupBy("rank").agg(F.count("*").alias("n"))


@query("A7_finding_weight", f"WITH {ready_sql()}, {found_sql()} SELECT case_id, round(sum(weight) + 1e-9, 6) AS weight FROM found GROUP BY case_id")
def a7(t: Tables) -> DataFrame:
    return X.findings(ready(t)).groupBy("case_id").agg(F.sum("weight").alias("weight")).select("case_id", rounded("weight"))


@query("A8_score", f"WITH {verdict_sql()} SELECT case_id, round(score + 1e-9, 6) AS score FROM verdicts")
def a8(t: Tables) -> DataFrame:
    return X.verdicts(signals(t)).select("case_id", rounded("score"))


@query("A10_confirmed_fields", "SELECT case_id, count(DISTINCT anchor) AS n FROM signals WHERE verdict = 'pass' AND starts_with(anchor, 'field:') AND (" + " OR ".join(f"starts_with(id, '{p}')" for p in R.CONFIRMING) + ") GROUP BY case_id")
def a10(t: Tables) -> DataFrame:
    """How many fields of a case a signature confirms."""
    return X.case_facts(ready(t)).select("case_id", F.size("confirmed").cast("long").alias("n")).filter("n > 0")


@query("A11_crypto_precedence", f"WITH {verdict_sql()} SELECT s.case_id, n_all - n_kept AS n_suppressed FROM scored s WHERE n_all > n_kept")
def a11(t: Tables) -> DataFrame:
    """Probabilistic findings that a clean signature overrules."""
    doubt = lambda f: (f["trust_class"] == "probabilistic") & F.array_contains("confirmed", f["anchor"])
    n = F.size(F.filter("findings", doubt)).cast("long")
    return X.joined(signals(t)).filter("crypto_clean").select("case_id", n.alias("n_suppressed")).filter("n_suppressed > 0")


@query("A13_verdict_cascade", f"WITH {verdict_sql()} SELECT CASE WHEN hard THEN 'hard' WHEN round(coverage, 9) < {R.DEFAULT.bands.floor} THEN 'coverage' ELSE 'score' END AS rule, band, count(*) AS n FROM verdicts GROUP BY ALL")
def a13(t: Tables) -> DataFrame:
    """Which step of the cascade decides: hard failure, coverage or score."""
    out = X.verdict_columns(R.DEFAULT)
    rule = F.when(F.col("hard"), "hard").when(X.settled(F.col("coverage")) < R.DEFAULT.bands.floor, "coverage").otherwise("score")
    return X.joined(signals(t)).select(rule.alias("rule"), out["band"].alias("band")).groupBy("rule", "band").agg(F.count("*").alias("n"))


@query("W9_first_failing", "SELECT case_id, arg_min(id, seq) AS id FROM signals WHERE verdict = 'fail' GROUP BY case_id")
def w9(t: Tables) -> DataFrame:
    return t.signals.filter("verdict = 'fail'").groupBy("case_id").agg(F.min_by("id", "seq").alias("id"))


@query(
    "T4_card_order",
    f"WITH {ready_sql()}, {found_sql()}, firsts AS (SELECT case_id, anchor, min(seq) AS s FROM ready WHERE verdict <> 'not_applicable' GROUP BY ALL) SELECT case_id, anchor, row_number() OVER (PARTITION BY case_id ORDER BY rank, round(severity, 9) DESC, s, anchor) AS place FROM found JOIN firsts USING (case_id, anchor)",
)
def t4(t: Tables) -> DataFrame:
    """Findings on a card: the more certain class first, then the worse."""
    order = Window.partitionBy("case_id").orderBy("rank", F.round("severity", 9).desc(), "first_seq", "anchor")
    return X.findings(ready(t)).select("case_id", "anchor", F.row_number().over(order).cast("long").alias("place"))


@query("Q3_band_resolution", "SELECT * FROM (VALUES (0.2::DOUBLE, 0.6::DOUBLE, true), (0.6::DOUBLE, 0.2::DOUBLE, false), (0.5::DOUBLE, 0.5::DOUBLE, true)) v(green, amber, valid)")
def q3(t: Tables) -> DataFrame:
    """Bands are taken only if green does not end above amber."""
    rows = t.spark.createDataFrame([(0.2, 0.6), (0.6, 0.2), (0.5, 0.5)], "green double, amber double")
    return rows.withColumn("valid", F.col("green") <= F.col("amber"))


@query("W1_latest_signed_prior", "SELECT case_id, last_value(CASE WHEN status = 'F' THEN case_id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY created_at, case_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_id FROM cases")
def w1(t: Tables) -> DataFrame:
    """The last verified document before each case, or none."""
    verified = F.when(F.col("status") == "F", F.col("case_id"))
    return J.latest_before(t.cases, "session_id", ["created_at", "case_id"], verified, "prior_id").select("case_id", "prior_id")


@query("W5_latest_crossing", "SELECT user_id, arg_max(post_id, (ts, event_id)) AS post_id FROM crossings GROUP BY user_id")
def w5(t: Tables) -> DataFrame:
    return t.crossings.groupBy("user_id").agg(F.max_by("post_id", F.struct("ts", "event_id")).alias("post_id"))


@query("T5_gallery_best", f"WITH {_UNIT}, s AS (SELECT p.vec_id AS probe_id, g.vec_id, round(list_cosine_similarity(p.e, g.e), 9) AS c FROM u p, u g WHERE p.vec_id % 20 = 0 AND p.vec_id <> g.vec_id) SELECT probe_id, arg_max(vec_id, (c, -vec_id)) AS vec_id FROM s WHERE c >= 0.2 GROUP BY probe_id")
def t5(t: Tables) -> DataFrame:
    """The most similar stored vector of each probe of the stated query set."""
    return J.gallery(t.vectors.filter("vec_id % 20 = 0"), t.vectors, least=0.2).filter("place = 1").select("probe_id", "vec_id")


@query("J19_group_pairs", "WITH v AS (SELECT vec_id, label % 3 AS g, label AS who FROM vectors WHERE vec_id % 20 = 0), p AS (SELECT a.g, a.vec_id AS a, b.vec_id AS b, row_number() OVER (PARTITION BY a.g ORDER BY a.vec_id, b.vec_id) - 1 AS k, count(*) OVER (PARTITION BY a.g) AS n FROM v a JOIN v b ON a.g = b.g AND a.vec_id < b.vec_id AND a.who <> b.who) SELECT g, a, b FROM p WHERE k % greatest(1, n // 200) = 0 AND k // greatest(1, n // 200) < 200")
def j19(t: Tables) -> DataFrame:
    """Pairs of different identity within a group, thinned by an even stride to at most 200 a group (the operator's own cap)."""
    own = t.vectors.filter("vec_id % 20 = 0").select("vec_id", (F.col("label") % 3).alias("g"), F.col("label").alias("who"))
    return ST.capped_pairs(own, "g", "vec_id", "who", 200)


@query("A32_robust_z", "WITH m AS (SELECT class, median(x1) AS med FROM boxes GROUP BY class), d AS (SELECT b.class, median(abs(x1 - med)) AS mad FROM boxes b JOIN m USING (class) GROUP BY b.class) SELECT box_id, round(abs(x1 - med) / greatest(1.4826 * mad, 1.0) + 1e-9, 6) AS z FROM boxes JOIN m USING (class) JOIN d USING (class)")
def a32(t: Tables) -> DataFrame:
    """Distance from the class's median in spreads of its absolute deviations."""
    med = t.boxes.groupBy("class").agg(F.median("x1").alias("med"))
    with_med = t.boxes.join(J.dimension(med), "class")
    mad = J.dimension(with_med.groupBy("class").agg(F.median(F.abs(F.col("x1") - F.col("med"))).alias("mad")))
    z = F.abs(F.col("x1") - F.col("med")) / F.greatest(1.4826 * F.col("mad"), F.lit(1.0))
    return with_med.join(mad, "class").select("box_id", F.round(z + 1e-9, 6).alias("z"))


@query("J21_alias_join", "SELECT s_suppkey AS ent_num, count(p_partkey) AS n_aliases FROM supplier LEFT JOIN part ON p_partkey % 500 = s_suppkey GROUP BY s_suppkey")
def j21(t: Tables) -> DataFrame:
    """Names with their aliases, those without any included."""
    aliases = t.part.groupBy((F.col("p_partkey") % 500).alias("ent_num")).agg(F.count("*").alias("n_aliases"))
    return t.supplier.select(F.col("s_suppkey").alias("ent_num")).join(aliases, "ent_num", "left").select("ent_num", F.coalesce("n_aliases", F.lit(0)).cast("long").alias("n_aliases"))


@query("K4_watchlist_append", "SELECT source, count(*) AS n FROM listed GROUP BY source UNION ALL SELECT 'SEED', 1")
def k4(t: Tables) -> DataFrame:
    """Rows appended to a stored watchlist, read back with what was there."""
    path = written(t.listed.select("source", "name"), "parquet")
    t.spark.createDataFrame([("SEED", "WANTED PERSON")], "source string, name string").write.mode("append").parquet(path)
    return t.spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("n"))


@query("K7_manifest", "SELECT split, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 10 < 7 THEN 'train' WHEN p_partkey % 10 < 9 THEN 'val' ELSE 'test' END AS split FROM part) GROUP BY split")
def k7(t: Tables) -> DataFrame:
    """Label lines written by split, and counted again from the folders."""
    k = F.col("box_id") % 10
    line = F.format_string("%d %.6f %.6f %.6f %.6f", F.col("ordinal"), F.col("x1") / 1000, F.col("y1") / 1000, F.lit(0.1), F.lit(0.1))
    path = new_place(t.spark, "dataset")
    t.boxes.select(F.when(k < 7, "train").when(k < 9, "val").otherwise("test").alias("split"), line.alias("value")).write.partitionBy("split").text(path)
    return t.spark.read.schema("value string, split string").text(path).groupBy("split").agg(F.count("*").alias("n"))


@query("K8_layout_written", "SELECT doc_type, class, count(*) AS n, round(median(x1) + 1e-9, 6) AS cx FROM boxes GROUP BY doc_type, class")
def k8(t: Tables) -> DataFrame:
    """Layout references written as JSON, one object a document type, and read back."""
    per = t.boxes.groupBy("doc_type", "class").agg(F.count("*").alias("n"), F.median("x1").alias("cx"))
    rows = per.groupBy("doc_type").agg(F.collect_list(F.struct("class", "n", "cx")).alias("classes"))
    back = t.spark.read.schema("doc_type string, classes array<struct<class:string,n:long,cx:double>>").json(written(rows, "json"))
    return back.select("doc_type", F.explode("classes").alias("c")).select("doc_type", "c.class", "c.n", F.round(F.col("c.cx") + 1e-9, 6).alias("cx"))


@query("S2_config_rows", "SELECT post_id, lat, lon FROM (VALUES " + ", ".join(f"('{k}', {lat}::DOUBLE, {lon}::DOUBLE)" for k, (_, lat, lon) in R.POSTS.items()) + ") v(post_id, lat, lon)")
def s2(t: Tables) -> DataFrame:
    """A configuration as a table: the posts."""
    return R.post_table(t.spark).select("post_id", "lat", "lon")


@query("S21_dataset_audit", "SELECT source, count(*) AS n, count(*) FILTER (text IS NULL OR trim(text) = '') AS n_empty, CAST(sum(len(string_split(coalesce(text, ''), chr(10)))) AS BIGINT) AS n_lines FROM documents GROUP BY source")
def s21(t: Tables) -> DataFrame:
    """Files, empty files and lines by dataset."""
    text = F.coalesce("text", F.lit(""))
    return t.documents.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.trim(text) == "").alias("n_empty"), F.sum(F.size(F.split(text, "\n", -1))).cast("long").alias("n_lines"))


@query("R1_push_order", "SELECT case_id, string_agg(split_part(id, '.', 1), '>' ORDER BY seq) AS modules FROM signals GROUP BY case_id")
def r1(t: Tables) -> DataFrame:
    """Messages of a case in the order they are sent."""
    own = F.array_sort(F.collect_list(F.struct("seq", F.split_part("id", F.lit("."), F.lit(1)).alias("m"))))
    return t.signals.groupBy("case_id").agg(F.array_join(F.transform(own, lambda x: x["m"]), ">").alias("modules"))


def _at(t: Tables) -> tuple[DataFrame, Column]:
    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    return t.events.select("event_id", "user_id", F.col("ts").alias("created_at")).filter(F.col("created_at").cast("timestamp") <= now), now


@query("R2_pending_state", "SELECT user_id, count(*) AS n FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' AND epoch_us(TIMESTAMP '2024-01-15 00:00:00') - epoch_us(ts) <= 86400000000 GROUP BY user_id")
def r2(t: Tables) -> DataFrame:
    """What is pending a day after: items no older than their limit since creation."""
    items, now = _at(t)
    return R_.alive(items, now, 86400).filter("alive").groupBy("user_id").agg(F.count("*").alias("n"))


@query("R4_eviction_boundary", "SELECT * FROM (VALUES (1::BIGINT, true), (2::BIGINT, true), (3::BIGINT, false)) v(event_id, alive)")
def r4(t: Tables) -> DataFrame:
    """An item goes once it is older than the limit, strictly: at the limit it is still there."""
    rows = t.spark.sql("SELECT * FROM VALUES (1L, TIMESTAMP '2024-01-01 00:00:01'), (2L, TIMESTAMP '2024-01-01 00:00:00'), (3L, TIMESTAMP '2023-12-31 23:59:59.999999') v(event_id, created_at)")
    return R_.alive(rows, F.lit("2024-01-01 00:15:00").cast("timestamp"), 900).select("event_id", "alive")


@query("R10_session_list", "SELECT session_id, count(DISTINCT doc_type) AS n FROM cases GROUP BY session_id")
def r10(t: Tables) -> DataFrame:
    """A document joins its session's list once."""
    return t.cases.dropDuplicates(["session_id", "doc_type"]).groupBy("session_id").agg(F.count("*").alias("n"))
