"""Sources, sinks, streams and kernels, over files and bytes made from the tables."""

from __future__ import annotations

import base64
import json
import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions import ed25519, image
from attesta.operators import documents as D
from attesta.session import new_place
from attesta.sources import annotations as N
from attesta.sources import watchlists as W
from attesta.streaming import sessions as R

from .registry import query
from .views import Tables


def written(df: DataFrame, kind: str, **options) -> str:
    path = new_place(df.sparkSession, kind)
    getattr(df.write.options(**options), kind)(path)
    return path


@query("S7_ofac_csv", "SELECT id, 'OFAC' AS source, name, array_to_string(list_sort(string_split(name, ' ')), ' ') AS name_key, CASE WHEN id % 2 = 0 THEN 'AKA ' || id || ',ALIAS ' || id ELSE '' END AS aliases, dob, doc_number AS doc_numbers FROM listed WHERE id % 3 <> 0 AND id % 4 <> 0")
def s7(t: Tables) -> DataFrame:
    """Sanctions CSV with aliases and dates mined from remarks (S7, J21, F23, K4): written as such files, and read."""
    day = F.expr("date_format(to_date(dob), 'dd MMM yyyy')")
    remarks = F.concat(F.lit("DOB "), day, F.lit("; Passport "), F.col("doc_number"), F.lit(" (India); id "), F.col("id").cast("string"))
    fill = [F.lit(None).cast("string").alias(f"c{i}") for i in range(8)]
    kind = F.when(F.col("id") % 3 == 0, "vessel").otherwise("individual")
    rows = t.listed.select(F.col("id").alias("ent_num"), F.when(F.col("id") % 4 != 0, F.col("name")).alias("name"), kind.alias("t"), *fill, remarks.alias("remarks"))
    alt = t.listed.filter("id % 2 = 0").select(F.col("id").alias("ent_num"), F.explode(F.array(F.lit("ALIAS "), F.lit("AKA "))).alias("a"))
    alt = alt.select("ent_num", F.lit(1).alias("n"), F.lit("aka").alias("k"), F.concat("a", F.col("ent_num").cast("string")).alias("name"), F.lit(None).cast("string").alias("r"))
    found = W.read_sdn(t.spark, written(rows, "csv", nullValue="-0-"), written(alt, "csv", nullValue="-0-"))
    keyed = t.listed.select("id", "doc_number")
    flat = found.withColumn("doc_numbers", F.array_join("doc_numbers", ",")).withColumn("aliases", F.array_join("aliases", ","))
    return flat.join(keyed, flat["doc_numbers"] == keyed["doc_number"]).select("id", "source", "name", "name_key", "aliases", "dob", "doc_numbers")


@query("S8_un_xml", "SELECT 'UN' AS source, name, dob, count(*) AS n FROM listed GROUP BY ALL")
def s8(t: Tables) -> DataFrame:
    """Consolidated list in XML, written and read."""
    words = F.split("name", " ")
    rows = t.listed.select(
        F.get(words, F.lit(0)).alias("FIRST_NAME"), F.get(words, F.lit(1)).alias("SECOND_NAME"), F.get(words, F.lit(2)).alias("THIRD_NAME"),
        F.array(F.struct(F.col("dob").alias("DATE"))).alias("INDIVIDUAL_DATE_OF_BIRTH"), F.array(F.struct(F.col("doc_number").alias("NUMBER"))).alias("INDIVIDUAL_DOCUMENT"),
    )
    path = new_place(t.spark, "xml")
    rows.write.format("xml").option("rootTag", "LIST").option("rowTag", "INDIVIDUAL").save(path)
    return W.read_consolidated(t.spark, path).groupBy("source", "name", "dob").agg(F.count("*").alias("n"))


@query("S10_label_lines", "SELECT image_id, ordinal % 4 AS class_index, count(*) AS n, round(sum(round((x1 + x2) / 2 / 500, 6)) + 1e-9, 5) AS cx FROM boxes GROUP BY ALL")
def s10(t: Tables) -> DataFrame:
    """Label files by split, written as text and read with their names."""
    from .registry import QUERIES

    lines = QUERIES["F27_yolo_lines"](t.spark, t.sf_dir).join(t.boxes.select("box_id", "image_id"), "box_id").select("line", "image_id")
    path = new_place(t.spark, "labels")
    lines.write.partitionBy("image_id").text(path)
    parsed = N.parse_labels(t.spark.read.text(path))
    return parsed.groupBy(F.col("image_id").cast("long").alias("image_id"), "class_index").agg(F.count("*").alias("n"), F.round(F.sum("cx") + 1e-9, 5).alias("cx"))


@query("S11_class_list", "SELECT case_id, 3 AS n, 'name' AS second FROM cases")
def s11(t: Tables) -> DataFrame:
    names = N.class_names(F.lit("nc: 3\nnames: ['dob', 'name', \"photo\"]"))
    return t.cases.select("case_id", F.size(names).alias("n"), F.get(names, F.lit(1)).alias("second"))


@query("S12_coco_json", "SELECT box_id AS image_id, class AS category, round((x1 + (x2 - x1) / 2) / 500 + 1e-9, 6) AS cx, round((y2 - y1) / 400 + 1e-9, 6) AS h FROM boxes")
def s12(t: Tables) -> DataFrame:
    """COCO annotations joined with images and categories, boxes normalised."""
    classes = ["dob", "name", "id_number", "photo"]
    b = t.boxes
    code = F.array_position(F.array(*map(F.lit, classes)), F.col("class"))
    doc = b.groupBy(F.pmod("box_id", F.lit(16)).alias("part")).agg(
        F.collect_list(F.struct(F.col("box_id").alias("id"), F.concat(F.lit("i"), F.col("box_id").cast("string")).alias("file_name"), F.lit(500.0).alias("width"), F.lit(400.0).alias("height"))).alias("images"),
        F.collect_list(F.struct(F.col("box_id").alias("image_id"), code.alias("category_id"), F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("bbox"))).alias("annotations"),
    )
    doc = doc.withColumn("categories", F.array(*(F.struct(F.lit(i + 1).alias("id"), F.lit(c).alias("name")) for i, c in enumerate(classes)))).drop("part")
    names = N.read_coco(t.spark, written(doc, "json", maxRecordsPerFile=1)).dropDuplicates(["image_id"])
    return names.select("image_id", "category", F.round(F.col("cx") + 1e-9, 6).alias("cx"), F.round(F.col("h") + 1e-9, 6).alias("h"))


@query("S14_layout_json", "SELECT doc_type, class, count(*) AS boxes FROM boxes GROUP BY ALL")
def s14(t: Tables) -> DataFrame:
    """Layout references written as JSON and read back."""
    from attesta.operators import stats as X

    from .q_stats import centres

    ref = X.median_mad(centres(t), ["doc_type", "class"], ["cx", "cy"], source="image_id")
    own = F.struct("cx", "cy", F.col("mad_cx").alias("mad_x"), F.col("mad_cy").alias("mad_y"), "n", "boxes")
    doc = ref.groupBy("doc_type").agg(F.map_from_entries(F.collect_list(F.struct("class", own))).alias("classes"))
    text = doc.select(F.to_json(F.struct("doc_type", "classes")).alias("value"))
    path = new_place(t.spark, "layout")
    text.repartition(3, "value").write.option("maxRecordsPerFile", 1).text(path)
    return N.read_layout(t.spark, path).select("doc_type", "class", "boxes")


@query("S17_stored_cases", "SELECT CAST(case_id AS STRING) AS case_id, count(*) AS n, count(*) FILTER (verdict = 'fail') AS failed FROM signals GROUP BY ALL")
def s17(t: Tables) -> DataFrame:
    """Cases stored as JSON documents and exploded into ordered signals."""
    keys = ["id", "verdict", "confidence", "trust_class", "hard_fail", "anchor", "evidence", "latency_ms"]
    s = t.signals
    doc = s.groupBy("case_id").agg(F.first("doc_type").alias("doc_type"), F.transform(F.array_sort(F.collect_list(F.struct("seq", *keys))), lambda x: F.struct(*(x[k].alias(k) for k in keys))).alias("signals"))
    path = written(doc.select(F.struct(F.col("case_id").cast("string").alias("scene"), "doc_type").alias("meta"), "signals"), "json")
    whole = t.spark.read.schema(f"meta struct<scene:string,doc_type:string>, signals array<{N.SIGNAL}>").json(path)
    rows = whole.select(F.col("meta.scene").alias("case_id"), F.posexplode("signals").alias("seq", "s"))
    return rows.groupBy("case_id").agg(F.count("*").alias("n"), F.count_if(F.col("s.verdict") == "fail").alias("failed"))


@query("S13_country_table", "SELECT nationality AS alpha3, count(*) AS n FROM people WHERE nationality <> 'ZZZ' GROUP BY 1")
def s13(t: Tables) -> DataFrame:
    """ISO countries from CSV, with the travel-document extras in front."""
    from attesta.sources.reference import country_codes, read_iso_countries

    rows = t.spark.createDataFrame([("IND", "India"), ("GBR", " United Kingdom"), ("D", "short"), ("UNO", "other")], ["ISO3166-1-Alpha-3", "official_name_en"])
    codes = country_codes(t.spark, read_iso_countries(t.spark, written(rows, "csv", header=True)))
    return t.people.join(F.broadcast(codes), F.col("nationality") == F.col("alpha3")).groupBy("alpha3").agg(F.count("*").alias("n"))


@query("S22_last_metrics", "SELECT event_type, arg_max(value, event_id) AS value FROM events GROUP BY event_type")
def s22(t: Tables) -> DataFrame:
    """The metrics of the last row of a results file, by type."""
    rows = t.spark.read.option("header", True).schema("event_id long, event_type string, value double").csv(written(t.events.select("event_id", "event_type", "value"), "csv", header=True))
    return rows.groupBy("event_type").agg(F.max_by("value", "event_id").alias("value"))


@query("S18_synthetic_people", "SELECT i AS person_id, 1 + i % 12 AS month, i % 9 AS issuer FROM range(0, 5000) r(i)")
def s18(t: Tables) -> DataFrame:
    """Synthetic rows from their numbers alone, the same in every run."""
    return t.spark.range(5000).select(F.col("id").alias("person_id"), (1 + F.col("id") % 12).alias("month"), (F.col("id") % 9).alias("issuer"))


@query("K1_audit_events", "SELECT case_id, sha256(CAST(case_id AS STRING) || '|' || CAST(session_id AS STRING)) AS event_id, right(CAST(session_id AS STRING), 4) AS last4 FROM cases")
def k1(t: Tables) -> DataFrame:
    """Audit events appended as Parquet with hashed identity; ids come from the case, so a repeated write is the same row."""
    rows = t.cases.select("case_id", F.sha2(F.concat_ws("|", F.col("case_id").cast("string"), F.col("session_id").cast("string")), 256).alias("event_id"), F.right(F.col("session_id").cast("string"), F.lit(4)).alias("last4"))
    return t.spark.read.parquet(written(rows, "parquet"))


@query("K5_schema_migration", "SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderstatus END AS post_id FROM orders")
def k5(t: Tables) -> DataFrame:
    """Old and new files of one table read together; the added column is null in old rows."""
    path = new_place(t.spark, "events")
    t.cases.filter("case_id % 2 = 0").select("case_id").write.parquet(f"{path}/v=1")
    t.cases.filter("case_id % 2 = 1").select("case_id", F.col("status").alias("post_id")).write.parquet(f"{path}/v=2")
    return t.spark.read.option("mergeSchema", True).parquet(path).select("case_id", "post_id")


@query("K3_face_vectors", "SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))) + 1e-9, 4) AS total FROM vectors")
def k3(t: Tables) -> DataFrame:
    """Vectors as little-endian float bytes, as a gallery keeps them, and back (K3)."""
    pack = F.pandas_udf(lambda s: s.map(lambda v: np.asarray(v, "<f4").tobytes()), "binary")

    unpack = F.pandas_udf(lambda s: s.map(lambda b: np.frombuffer(b, "<f4").astype(float)), "array<double>")
    back = t.vectors.select("vec_id", unpack(pack("embedding")).alias("v"))
    return back.select("vec_id", F.size("v").cast("long").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x) + 1e-9, 4).alias("total"))


@query("K9_config_rewrite", "SELECT case_id, 'threshold: 0.41' AS line FROM cases")
def k9(t: Tables) -> DataFrame:
    return t.cases.select("case_id", F.regexp_replace(F.lit("threshold: 0.32"), r"(threshold: )[0-9.]+", "threshold: 0.41").alias("line"))


SEED, OTHER_SEED = b"\x01" * 32, b"\x02" * 32
ANCHORS = {"ref": {"public_key": ed25519.public_key(SEED), "algorithm": "ed25519"}, "rsa": {"public_key": b"", "algorithm": "rsa"}}


def envelopes(n: int) -> list[tuple[int, str | None]]:
    out = []
    for k in range(n):
        issuer = "nobody" if k % 6 == 1 else "rsa" if k % 6 == 2 else "ref"
        payload = {"name": f"PERSON {k}", "dob": "1990-01-01"}
        signature = ed25519.sign(OTHER_SEED if k % 6 == 3 else SEED, ed25519.canonical({**payload, "issuer_id": issuer}))
        if k % 6 == 4:
            payload["dob"] = "1991-01-01"
        blob = json.dumps({"issuer_id": issuer, "payload": payload, "signature": base64.b64encode(signature).decode()})
        out.append((k, blob[:-5] if k % 6 == 5 else blob))
    return out


@query("U1_envelope_states", "SELECT n_nationkey AS id, CASE n_nationkey % 6 WHEN 0 THEN 'AUTHENTIC' WHEN 1 THEN 'UNKNOWN_ISSUER' WHEN 2 THEN 'INVALID_SIGNATURE' WHEN 5 THEN 'MALFORMED_PAYLOAD' ELSE 'TAMPERED' END AS state FROM nation")
def u1(t: Tables) -> DataFrame:
    """Signed envelopes through Ed25519 verification to their states."""
    signed = t.spark.createDataFrame(envelopes(25), "id int, blob string")
    own = t.nation.select(F.col("n_nationkey").alias("id")).join(F.broadcast(signed), "id")
    return D.envelope_states(own, ANCHORS).select("id", "state")


def jpeg(table: list[int] | None, software: bytes | None) -> bytes:
    out = b"\xff\xd8"
    if software is not None:
        tag = software + b"\0"
        body = b"Exif\0\0II*\0" + struct.pack("<I", 8) + struct.pack("<HHHII", 1, 0x0131, 2, len(tag), 26) + struct.pack("<I", 0) + tag
        out += b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body
    if table is not None:
        out += b"\xff\xdb" + struct.pack(">H", 67) + b"\0" + bytes(int(table[i]) for i in image.ZIGZAG)
    return out + b"\xff\xda"


@query("P37_exif_software", "SELECT r_regionkey AS id, CASE r_regionkey WHEN 0 THEN 'fail' WHEN 1 THEN 'pass' WHEN 2 THEN 'not_applicable' WHEN 3 THEN 'inconclusive' ELSE 'not_applicable' END AS verdict FROM region")
def p37(t: Tables) -> DataFrame:
    """Editor marks in image bytes."""
    raw = [(0, jpeg(None, b"Adobe Photoshop 25")), (1, jpeg(None, b"Scanner 1.0")), (2, jpeg(None, None)), (3, None), (4, b"PNG")]
    rows = t.spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in raw], "id int, raw binary")
    return rows.join(t.region.select(F.col("r_regionkey").alias("id")), "id").select("id", D.exif_verdicts(F.col("raw")).alias("verdict"))


@query("P38_double_jpeg", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 = 0 THEN 'fail' ELSE 'pass' END AS verdict FROM nation")
def p38(t: Tables) -> DataFrame:
    """Quantisation tables that no standard encoder writes."""
    made = []
    for k in range(25):
        table = image.standard_table(40 + 2 * k)
        if k % 5 == 0:
            table = table.copy()
            table[9] = table[9] + 7
        made.append((k, bytearray(jpeg(table, None))))
    rows = t.spark.createDataFrame(made, "id int, raw binary")
    return rows.join(t.nation.select(F.col("n_nationkey").alias("id")), "id").select("id", D.jpeg_verdicts(F.col("raw"))["verdict"].alias("verdict"))


@query("P2_plane_measures")
def p2(t: Tables) -> DataFrame:
    """Sharpness, brightness and noise of 8 x 8 planes."""
    return D.plane_measures(t.vectors, "vec_id", "embedding", 8)


@query("T6_suppression")
def t6(t: Tables) -> DataFrame:
    """Greedy suppression of overlapping boxes per image; sequential by nature, so SQL has no form of it."""
    return D.suppressed(t.boxes.select("box_id", "image_id", "x1", "y1", "x2", "y2", "confidence"), ["image_id"]).select("image_id", "box_id")


@query("U2_models_absent", "SELECT case_id, 'face.doc.detected' AS id, 'inconclusive' AS verdict FROM cases")
def u2(t: Tables) -> DataFrame:
    """Checks whose model isn't deployed give the open signal."""
    s = D.model_or_open(False, "face.doc.detected", F.lit("pass"), F.lit("found"))
    return t.cases.select("case_id", s.alias("s")).select("case_id", "s.id", "s.verdict")


@query("R3_stream_sessions", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(*) AS n, round(sum(value) + 1e-9, 4) AS total FROM s GROUP BY user_id, k")
def r3(t: Tables) -> DataFrame:
    """Sessions of a stream by idle gap."""
    path = new_place(t.spark, "sessions")
    stream = R.read_stream(t.spark, f"{t.sf_dir}/events.parquet")
    R.run_once(R.sessions(stream), path, new_place(t.spark, "checkpoint"), "complete")
    latest = t.spark.read.parquet(path)
    last = latest.agg(F.max("batch").alias("batch"))
    return latest.join(F.broadcast(last), "batch").select("user_id", "n", F.round(F.col("total") + 1e-9, 4).alias("total"))


@query("R6_stream_edges", "SELECT session_id, case_id, prior_id FROM (SELECT session_id, case_id, last_value(CASE WHEN status = 'F' THEN case_id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY created_at, case_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_id FROM cases) WHERE prior_id IS NOT NULL")
def r6(t: Tables) -> DataFrame:
    """Trust carried along a session with keyed state."""
    path = new_place(t.spark, "edges")
    orders = R.read_stream(t.spark, f"{t.sf_dir}/orders.parquet")
    cases = orders.select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("case_id"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderstatus") == "F").alias("verified"))
    R.run_once(R.session_edges(cases), path, new_place(t.spark, "checkpoint"))
    return t.spark.read.parquet(path).select("session_id", "case_id", "prior_id")


@query("R5_expired_lookup", "SELECT event_id, CASE WHEN epoch_us(TIMESTAMP '2024-01-15 00:00:00') - epoch_us(ts) <= 900000000 THEN NULL ELSE 'expired' END AS error FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00'")
def r5(t: Tables) -> DataFrame:
    """Items past their time give a recoverable error."""
    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    items = t.events.filter(F.col("ts").cast("timestamp") < now).withColumnRenamed("ts", "created_at")
    return R.alive(items, now, 900).select("event_id", F.when(~F.col("alive"), "expired").alias("error"))


@query("R7_client_fold", "SELECT case_id, count(*) AS n_signals, arg_max(evidence, seq) FILTER (verdict = 'fail') AS verdict FROM signals GROUP BY case_id")
def r7(t: Tables) -> DataFrame:
    """Messages folded to what a client shows."""
    messages = t.signals.select("case_id", "seq", F.lit("signal").alias("type"), F.col("id").alias("payload")).unionByName(
        t.signals.filter("verdict = 'fail'").select("case_id", "seq", F.lit("verdict").alias("type"), F.col("evidence").alias("payload"))
    )
    return R.fold(messages).select("case_id", F.col("n_signals").cast("long").alias("n_signals"), "verdict")


@query("R9_consume_once", "SELECT user_id, count(DISTINCT event_id % 100) AS n FROM events GROUP BY user_id")
def r9(t: Tables) -> DataFrame:
    """Repeated captures count once."""
    return t.events.select("user_id", (F.col("event_id") % 100).alias("capture")).dropDuplicates(["user_id", "capture"]).groupBy("user_id").agg(F.count("*").alias("n"))
