"""Screening tables derived from the driver's tables, as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from attesta.session import share_code

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

SIGNAL_IDS = [
    "validation.signature.valid", "validation.mrz.checkdigit.composite", "validation.mrz.checkdigit.dob", "validation.vizmrz.dob_mismatch",
    "validation.vizmrz.name_mismatch", "validation.verhoeff.aadhaar", "validation.crossdoc.dob_mismatch", "validation.crossdoc.name_mismatch",
    "validation.format.pan.id_number", "validation.format.dl.id_number", "validation.expiry.expired", "validation.watchlist.hit",
    "validation.signed.name_mismatch", "validation.crossfield.date_order", "validation.history.impossible_transit", "tamper.stamp.duplicate",
    "tamper.digital.ela", "tamper.digital.copy_move", "tamper.physical.layout_geometry", "face.match.cosine", "face.liveness.passive",
    "face.doc.quality", "extraction.quality.blur", "extraction.ocr.name.confidence", "extraction.field.dob.confidence",
]
GIVEN = "ANNA PRADEEP MARIA RAVI SUNITA IMRAN LEELA JOHN MEERA ARUN FATIMA".split()
SURNAME = "SHARMA GHARAT KUMAR FERNANDES KHAN ERIKSSON DESAI".split()


def pick(index: str, options: list) -> str:
    """CASE over index, which must run from 0."""
    shown = [f"'{x}'" if isinstance(x, str) else str(x) for x in options]
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(shown)) + " END"


DOC_TYPE = pick("o_orderkey % 6", ["passport", "visa", "aadhaar", "pan", "voter_id", "dl"])
_DATE = "CAST({y} AS STRING) || '-' || lpad(CAST(1 + {k} % 12 AS STRING), 2, '0') || '-' || lpad(CAST(1 + {k} % 28 AS STRING), 2, '0')"

VIEWS: dict[str, str] = {
    "signals": f"""
SELECT l_orderkey AS case_id, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 10000 + l_suppkey AS seq, {DOC_TYPE} AS doc_type,
  {pick(f"l_partkey % {len(SIGNAL_IDS)}", SIGNAL_IDS)} AS id,
  CASE WHEN l_returnflag = 'R' THEN 'fail' WHEN l_returnflag = 'A' THEN 'pass' WHEN l_linestatus = 'O' THEN 'inconclusive' ELSE 'not_applicable' END AS verdict,
  CASE WHEN l_discount * 10 > 1 THEN CAST(1 AS DOUBLE) ELSE l_discount * 10 END AS confidence,
  {pick("l_suppkey % 4", ["cryptographic", "arithmetic", "probabilistic", "unverified"])} AS trust_class,
  l_partkey % 997 = 0 AS hard_fail,
  {pick("(l_partkey + l_suppkey) % 5", ["field:dob", "field:name", "document", "field:person_photo", "field:id_number"])} AS anchor,
  'evidence ' || CAST(l_partkey AS STRING) || '/' || CAST(l_suppkey AS STRING) || '/' || CAST(l_linenumber AS STRING) AS evidence,
  CAST(l_partkey % 400 AS INT) AS latency_ms
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "cases": f"SELECT o_orderkey AS case_id, o_custkey AS session_id, o_orderdate AS created_at, o_orderkey AS seq, {DOC_TYPE} AS doc_type, o_totalprice AS amount, o_orderstatus AS status FROM orders",
    "people": f"""
SELECT c_custkey AS person_id, {pick("c_custkey % 11", GIVEN)} AS given, {pick("c_custkey % 7", SURNAME)} AS surname,
  {_DATE.format(y="(1940 + c_custkey % 65)", k="c_custkey")} AS dob, {_DATE.format(y="(2020 + c_custkey % 20)", k="c_custkey")} AS expiry,
  {_DATE.format(y="(2010 + c_custkey % 20)", k="c_custkey")} AS issued,
  {pick("c_custkey % 3", ["M", "F", "<"])} AS sex, {pick("c_custkey % 4", ["IND", "GBR", "D", "ZZZ"])} AS nationality,
  {pick("c_custkey % 5", ["A", "K", "M", "Z", "E"])} || lpad(CAST(c_custkey * 7919 % 10000000 AS STRING), 7, '0') AS doc_number,
  CAST(23456789012 + c_custkey * 1000003 % 60000000000 AS STRING) AS digits11, c_nationkey AS k
FROM customer""",
    "boxes": f"""
SELECT p_partkey AS box_id, p_partkey % 50 AS image_id, {pick("p_partkey % 4", ["dob", "name", "id_number", "photo"])} AS class, p_size AS ordinal,
  CAST(p_partkey % 37 * 10 AS DOUBLE) AS x1, CAST(p_partkey % 23 * 10 AS DOUBLE) AS y1,
  CAST(p_partkey % 37 * 10 + 20 + p_size AS DOUBLE) AS x2, CAST(p_partkey % 23 * 10 + 20 + p_size * 2 AS DOUBLE) AS y2,
  CAST(p_partkey % 100 AS DOUBLE) / 100 AS confidence, {pick("p_partkey % 3", ["pan", "dl", "visa"])} AS doc_type
FROM part""",
    "crossings": f"SELECT event_id, user_id, ts, {pick('event_id % 4', ['raxaul', 'sunauli', 'jogbani', 'panitanki'])} AS post_id, event_type, value FROM events",
    "vectors": "SELECT vec_id, label, embedding FROM embeddings",
    "listed": f"""
SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'OFAC' ELSE 'UN' END AS source,
  {pick("s_suppkey % 11", GIVEN)} || ' ' || {pick("s_suppkey % 7", SURNAME)} || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE ' ' || {pick("s_suppkey % 5", ["ALI", "DEV", "ROY", "SEN", "PAL"])} END AS name,
  {_DATE.format(y="(1940 + s_suppkey % 65)", k="s_suppkey")} AS dob,
  {pick("s_suppkey % 5", ["A", "K", "M", "Z", "E"])} || lpad(CAST(s_suppkey * 7919 % 10000000 AS STRING), 7, '0') AS doc_number
FROM supplier""",
}


class Tables:
    """The tables and derived views of one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = share_code(spark), sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in VIEWS:
            return self.sql(VIEWS[name])
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        """SQL over the tables, which it names plainly."""
        used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", text)]
        for t in used:
            text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
        return self.spark.sql(text, **{t: getattr(self, t) for t in used})


def with_views(sql: str) -> str:
    """DuckDB SQL with the derived views it names in front, as common table expressions."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not used:
        return sql
    head = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in used)
    body = sql.strip()
    return f"WITH {head},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head}\n{body}"
