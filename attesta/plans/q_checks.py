"""Scalar functions, number checks, machine-readable zones and validation layers over derived people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import checks as C
from attesta.functions import mrz as M
from attesta.functions import scalars as S
from attesta.operators import validation as V

from . import rules as R
from .registry import query
from .views import Tables

TODAY = "2026-09-06"


def today() -> Column:
    return F.lit(TODAY).cast("date")


# DuckDB expressions of the same functions, written on their own.
def d_check_digit(x: str) -> str:
    value = "greatest(strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr({x}, i::INT, 1)) - 1, 0)".format(x=x)
    return f"CAST(list_sum(list_transform(range(1, length({x}) + 1), lambda i: {value} * (CASE (i - 1) % 3 WHEN 0 THEN 7 WHEN 1 THEN 3 ELSE 1 END))) % 10 AS STRING)"


def d_pad(x: str, n: int) -> str:
    return f"rpad(replace(upper({x}), ' ', '<'), {n}, '<')"


PARTS = f"""parts AS (SELECT *, {d_pad("doc_number", 9)} AS num, substr(replace(dob, '-', ''), 3) AS b, substr(replace(expiry, '-', ''), 3) AS e, rpad('', 14, '<') AS opt FROM people),
lines AS (SELECT *, 'P<' || 'IND' || {d_pad("surname || '<<' || given", 39)} AS l1, num || {d_check_digit("num")} || {d_pad("nationality", 3)} || b || {d_check_digit("b")} || sex || e || {d_check_digit("e")} || opt || {d_check_digit("opt")} AS body FROM parts),
built AS (SELECT *, l1 || chr(10) || body || {d_check_digit("(substr(body, 1, 10) || substr(body, 14, 7) || substr(body, 22, 22))")} AS strip FROM lines),
zones AS (SELECT *, substr(strip, 1, 44) AS z1, CASE WHEN person_id % 5 = 0 THEN substr(strip, 46, 13) || '8' || substr(strip, 60) ELSE substr(strip, 46) END AS z2 FROM built)"""


def strips(t: Tables) -> DataFrame:
    """A zone for each person; every fifth has its year of birth changed."""
    lit = F.lit
    strip = M.build_td3(lit("P"), lit("IND"), F.col("surname"), F.col("given"), F.col("doc_number"), F.col("nationality"), F.col("dob"), F.col("sex"), F.col("expiry"), lit(""))
    second = F.substring("built", 46, 44)
    bad = F.concat(F.substring(second, 1, 13), lit("8"), F.substring(second, 15, 30))
    return t.people.withColumn("built", strip).withColumn("strip", F.concat(F.substring("built", 1, 45), F.when(F.col("person_id") % 5 == 0, bad).otherwise(second)))


@query("F10_build_td3", f"WITH {PARTS} SELECT person_id, strip FROM built")
def f10(t: Tables) -> DataFrame:
    return strips(t).select("person_id", F.col("built").alias("strip"))


_DIGITS = f"""SELECT person_id, 'document_number' AS field, {d_check_digit("substr(z2, 1, 9)")} = substr(z2, 10, 1) AS ok FROM zones UNION ALL
SELECT person_id, 'dob', {d_check_digit("substr(z2, 14, 6)")} = substr(z2, 20, 1) FROM zones UNION ALL
SELECT person_id, 'expiry', {d_check_digit("substr(z2, 22, 6)")} = substr(z2, 28, 1) FROM zones UNION ALL
SELECT person_id, 'optional', {d_check_digit("substr(z2, 29, 14)")} = substr(z2, 43, 1) FROM zones UNION ALL
SELECT person_id, 'composite', {d_check_digit("(substr(z2, 1, 10) || substr(z2, 14, 7) || substr(z2, 22, 22))")} = substr(z2, 44, 1) FROM zones"""


@query("P22_mrz_check_digits", f"WITH {PARTS} {_DIGITS}")
def p22(t: Tables) -> DataFrame:
    """One row for each check digit of each zone."""
    digits = strips(t).select("person_id", F.explode(M.check_fields(F.col("strip"))).alias("d"))
    return digits.select("person_id", "d.field", M.verify(F.col("d.value"), F.col("d.digit")).alias("ok"))


@query(
    "F8_mrz_parse",
    f"""WITH {PARTS}, p AS (SELECT *, make_date_try AS d FROM (SELECT *, try_cast('20' || substr(z2, 14, 2) || '-' || substr(z2, 16, 2) || '-' || substr(z2, 18, 2) AS DATE) AS make_date_try,
 try_cast('20' || substr(z2, 22, 2) || '-' || substr(z2, 24, 2) || '-' || substr(z2, 26, 2) AS DATE) AS ex FROM zones))
SELECT person_id, 'TD3' AS format, surname, given AS given_names, rtrim(substr(z2, 1, 9), '<') AS document_number, rtrim(substr(z2, 11, 3), '<') AS nationality,
 strftime(CASE WHEN d > DATE '{TODAY}' THEN d - INTERVAL 100 YEAR ELSE d END, '%Y-%m-%d') AS birth_date, substr(z2, 21, 1) AS sex,
 strftime(CASE WHEN year(ex) < 1976 THEN ex + INTERVAL 100 YEAR ELSE ex END, '%Y-%m-%d') AS expiry_date FROM p""",
)
def f8(t: Tables) -> DataFrame:
    """Fields of parsed zones with their century rules."""
    m = strips(t).select("person_id", M.parse(F.col("strip"), today()).alias("m"))
    return m.select("person_id", *(f"m.{c}" for c in ("format", "surname", "given_names", "document_number", "nationality", "birth_date", "sex", "expiry_date")))


@query(
    "F11_positional_charset",
    f"""WITH {PARTS}, d AS (SELECT person_id, translate(z2, '0125', 'OIZS') AS x, z2 FROM zones)
SELECT person_id, substr(x, 1, 9) || translate(substr(x, 10, 1), 'OQDILZSBG', '000112586') || translate(substr(x, 11, 3), '012568', 'OIZSGB') || translate(substr(x, 14, 7), 'OQDILZSBG', '000112586') || substr(x, 21, 1)
 || translate(substr(x, 22, 7), 'OQDILZSBG', '000112586') || substr(x, 29, 14) || translate(substr(x, 43, 2), 'OQDILZSBG', '000112586') AS line FROM d""",
)
def f11(t: Tables) -> DataFrame:
    """Look-alike characters put right by their place in the line."""
    noisy = F.translate(F.substring("strip", 46, 44), "0125", "OIZS")
    return strips(t).select("person_id", M.positional(noisy).alias("line"))


_VERHOEFF = "list_reduce(list_prepend(0, list_transform(range(0, length({x})), lambda i: CAST(substr('{p}', CAST((i + {s}) % 8 * 10 + CAST(substr({x}, CAST(length({x}) - i AS INT), 1) AS INT) + 1 AS INT), 1) AS INT))), lambda a, b: CAST(substr('{d}', CAST(a * 10 + b + 1 AS INT), 1) AS INT))"


def _digits(rows: list[list[int]]) -> str:
    return "".join(str(n) for row in rows for n in row)


def d_verhoeff(x: str, shift: int) -> str:
    return _VERHOEFF.format(x=x, s=shift, p=_digits(C.VERHOEFF_P), d=_digits(C.VERHOEFF_D))


_AADHAAR = f"""numbers AS (SELECT person_id, CASE WHEN person_id % 7 = 0 THEN substr(digits11, 1, 10) || CAST((CAST(substr(digits11, 11) AS INT) + 1) % 10 AS STRING) ELSE digits11 END || substr('{_digits([C.VERHOEFF_INVERSE])}', {d_verhoeff("digits11", 1)} + 1, 1) AS number FROM people)"""


def aadhaars(t: Tables) -> DataFrame:
    wrong = F.concat(F.substring("digits11", 1, 10), ((F.substring("digits11", 11, 1).cast("int") + 1) % 10).cast("string"))
    base = F.when(F.col("person_id") % 7 == 0, wrong).otherwise(F.col("digits11"))
    return t.people.select("person_id", F.concat(base, C.verhoeff_digit(F.col("digits11"))).alias("number"))


@query("F12_verhoeff", f"WITH {_AADHAAR} SELECT person_id, number, {d_verhoeff('number', 0)} = 0 AS ok FROM numbers")
def f12(t: Tables) -> DataFrame:
    return aadhaars(t).withColumn("ok", C.verhoeff(F.col("number")))


@query(
    "P23_check_aadhaar",
    f"""WITH {_AADHAAR}, v AS (SELECT *, {d_verhoeff("number", 0)} = 0 AS good FROM numbers)
SELECT person_id, length(number) = 12 AND number[1] NOT IN ('0', '1') AND good AS ok, CASE WHEN length(number) <> 12 THEN 'Wrong length of an Aadhaar number: ' || length(number) || ' digits' WHEN number[1] IN ('0', '1') THEN 'First digit not allowed in an Aadhaar number'
 WHEN NOT good THEN 'Aadhaar number with a wrong last digit' ELSE 'Aadhaar number ends with its check digit, ' || number[12] END AS detail FROM v""",
)
def p23(t: Tables) -> DataFrame:
    ok, detail = C.check_aadhaar(F.col("number"))
    return aadhaars(t).select("person_id", ok.alias("ok"), detail.alias("detail"))


_PAN = "SELECT person_id, surname, upper(substr(given, 1, 3)) || CASE person_id % 4 WHEN 0 THEN 'P' WHEN 1 THEN 'C' WHEN 2 THEN 'X' ELSE 'H' END || CASE WHEN person_id % 6 = 0 THEN 'Q' ELSE substr(surname, 1, 1) END || lpad(CAST(person_id % 10000 AS STRING), 4, '0') || CASE WHEN person_id % 9 = 0 THEN '7' ELSE 'F' END AS pan FROM people"


@query(
    "F13_check_pan",
    f"""WITH p AS ({_PAN}), q AS (SELECT *, regexp_matches(pan, '^[A-Z]{{5}}[0-9]{{4}}[A-Z]$') AS form, pan[4] IN ('P','C','H','A','B','G','J','L','F','T') AS held, pan[5] = surname[1] AS same FROM p)
SELECT person_id, form AND held AND same AS ok, CASE WHEN NOT form THEN 'Not the form of a PAN: ' || pan WHEN NOT held THEN 'No holder of a PAN has the letter ' || pan[4]
 WHEN NOT same THEN 'PAN of another surname than ' || surname || ': its letter is ' || pan[5]
 ELSE 'PAN of a holder of type ' || CASE pan[4] WHEN 'P' THEN 'individual' WHEN 'C' THEN 'company' ELSE 'Hindu undivided family' END || ' named ' || surname END AS detail FROM q""",
)
def f13_pan(t: Tables) -> DataFrame:
    from .views import VIEWS

    people = t.sql(_PAN.replace("FROM people", f"FROM ({VIEWS['people']})"))
    ok, detail = C.check_pan(F.col("pan"), F.col("surname"))
    return people.select("person_id", ok.alias("ok"), detail.alias("detail"))


@query(
    "F13_check_epic",
    """WITH e AS (SELECT person_id, substr(surname, 1, 3) || lpad(CAST(person_id * 7919 % 10000000 AS STRING), CASE WHEN person_id % 8 = 0 THEN 6 ELSE 7 END, '0') AS epic FROM people)
SELECT person_id, regexp_matches(epic, '^[A-Z]{3}[0-9]{7}$') AS ok, CASE WHEN regexp_matches(epic, '^[A-Z]{3}[0-9]{7}$') THEN 'Voter number of constituency ' || substr(epic, 1, 3) ELSE 'Not the form of a voter number: ' || epic END AS detail FROM e""",
)
def f13_epic(t: Tables) -> DataFrame:
    serial = (F.col("person_id") * 7919 % 10000000).cast("string")
    epic = F.concat(F.substring("surname", 1, 3), F.when(F.col("person_id") % 8 == 0, F.lpad(serial, 6, "0")).otherwise(F.lpad(serial, 7, "0")))
    ok, detail = C.check_epic(epic)
    return t.people.select("person_id", ok.alias("ok"), detail.alias("detail"))


_STATES = ", ".join(f"'{k}': '{v}'" for k, v in C.STATES.items())


@query(
    "F13_check_dl",
    f"""WITH d AS (SELECT person_id, CASE person_id % 5 WHEN 0 THEN 'MH' WHEN 1 THEN 'DL' WHEN 2 THEN 'XX' WHEN 3 THEN 'KA' ELSE 'TN' END || lpad(CAST(person_id % 12 AS STRING), 2, '0') || CAST(1895 + person_id % 150 AS STRING) || lpad(CAST(person_id AS STRING), 7, '0') AS dl FROM people),
q AS (SELECT *, MAP {{{_STATES}}}[substr(dl, 1, 2)] AS place FROM d)
SELECT person_id, place IS NOT NULL AND substr(dl, 3, 2) <> '00' AND CAST(substr(dl, 5, 4) AS INT) BETWEEN 1900 AND 2026 AS ok,
 CASE WHEN place IS NULL THEN 'No state has the licence code ' || substr(dl, 1, 2) WHEN substr(dl, 3, 2) = '00' THEN 'No office has the licence code 00'
 WHEN CAST(substr(dl, 5, 4) AS INT) NOT BETWEEN 1900 AND 2026 THEN 'No licence is of the year ' || substr(dl, 5, 4) ELSE 'Licence of ' || substr(dl, 5, 4) || ' from office ' || substr(dl, 3, 2) || ' in ' || place END AS detail FROM q""",
)
def f13_dl(t: Tables) -> DataFrame:
    k = F.col("person_id")
    state = F.get(F.array(*map(F.lit, ["MH", "DL", "XX", "KA", "TN"])), (k % 5).cast("int"))
    dl = F.concat(state, F.lit("-"), F.lpad((k % 12).cast("string"), 2, "0"), F.lit(" "), (1895 + k % 150).cast("string"), F.lpad(k.cast("string"), 7, "0"))
    ok, detail = C.check_dl(dl, 2026)
    return t.people.select("person_id", ok.alias("ok"), detail.alias("detail"))


@query("F1_name", "SELECT page_id, trim(regexp_replace(regexp_replace(upper(strip_accents(regexp_replace(html, '[^A-Za-z0-9éèêñíóúüöä< .,-]', ' ', 'g'))), '[^A-Z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM pages")
def f1(t: Tables) -> DataFrame:
    """Name normaliser over Latin text."""
    text = F.regexp_replace("html", "[^A-Za-z0-9éèêñíóúüöä< .,-]", " ")
    return t.pages.select("page_id", S.name(text).alias("name"))


_FORMS = """CASE person_id % 8 WHEN 0 THEN dob WHEN 1 THEN substr(dob, 9, 2) || '/' || substr(dob, 6, 2) || '/' || substr(dob, 1, 4) WHEN 2 THEN substr(dob, 9, 2) || '-' || substr(dob, 6, 2) || '-' || substr(dob, 1, 4)
 WHEN 3 THEN substr(dob, 9, 2) || '.' || substr(dob, 6, 2) || '.' || substr(dob, 1, 4) WHEN 4 THEN replace(dob, '-', '/') WHEN 5 THEN '31/02/' || substr(dob, 1, 4) WHEN 6 THEN ' ' || dob || '  ' ELSE 'unread ' || dob END"""


@query("F2_iso_date", "SELECT person_id, CASE WHEN person_id % 8 IN (5, 7) THEN NULL ELSE dob END AS iso FROM people")
def f2(t: Tables) -> DataFrame:
    """Printed dates in all their forms, invalid ones null."""
    return t.people.select("person_id", S.iso_date(F.expr(_FORMS)).alias("iso"))


@query("F3_gender", "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN 'M' WHEN 3 THEN '<' WHEN 4 THEN '<' ELSE NULL END AS gender FROM customer")
def f3(t: Tables) -> DataFrame:
    words = F.get(F.array(*map(F.lit, ["male ", "Mahila", "PURUSH", "x", "Transgender", "unknown"])), (F.col("c_custkey") % 6).cast("int"))
    return t.customer.select("c_custkey", S.gender(words).alias("gender"))


@query("F4_id_number", "SELECT person_id, upper(doc_number) AS id_number FROM people")
def f4(t: Tables) -> DataFrame:
    spaced = F.concat(F.lower(F.substring("doc_number", 1, 4)), F.lit(" - "), F.substring("doc_number", 5, 4))
    return t.people.select("person_id", S.id_number(spaced).alias("id_number"))


@query("F5_watchlist_key", "SELECT id, array_to_string(list_sort(string_split(name, ' ')), ' ') AS key FROM listed")
def f5(t: Tables) -> DataFrame:
    return t.listed.select("id", S.watchlist_key(F.col("name")).alias("key"))


@query("F6_country_codes", "SELECT person_id, nationality, nationality IN ('IND', 'GBR', 'D') AS known FROM people")
def f6(t: Tables) -> DataFrame:
    """Membership in the ISO list with the travel-document extras."""
    from attesta.sources.reference import country_codes

    codes = country_codes(t.spark, t.spark.createDataFrame([("IND", "India"), ("GBR", "United Kingdom"), ("D", "not this one")], "alpha3 string, name string"))
    return t.people.join(F.broadcast(codes), F.upper(F.trim("nationality")) == F.col("alpha3"), "left").select("person_id", "nationality", F.col("alpha3").isNotNull().alias("known"))


@query("F14_doc_hash", "SELECT person_id, sha256(array_to_string(['sih-ref-1', 'issuer-' || CAST(person_id % 3 AS STRING), given || ' ' || surname, dob, sex, doc_number, ''], chr(31))) AS doc_hash FROM people")
def f14(t: Tables) -> DataFrame:
    """Canonical form and its SHA-256; null counts as empty."""
    fields = [F.concat(F.col("given"), F.lit("  "), F.col("surname")), F.col("dob"), F.col("sex"), F.col("doc_number"), F.lit(None).cast("string")]
    return t.people.select("person_id", S.doc_hash(F.concat(F.lit("issuer-"), (F.col("person_id") % 3).cast("string")), fields).alias("doc_hash"))


@query("F15_hash_id_number", "SELECT person_id, sha256('pepper' || doc_number) AS hash, right(doc_number, 4) AS last4 FROM people")
def f15(t: Tables) -> DataFrame:
    spaced = F.concat(F.substring("doc_number", 1, 4), F.lit("-"), F.substring("doc_number", 5, 4))
    return t.people.select("person_id", S.hash_id_number(spaced, "pepper").alias("h")).select("person_id", "h.hash", "h.last4")


@query("F16_phonetic_key")
def f16(t: Tables) -> DataFrame:
    return t.listed.select("id", S.phonetic_key(S.watchlist_key(F.col("name"))).alias("key"))


_KM = "2 * 6371.0 * asin(sqrt(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2)))"
_POSTS = "(VALUES " + ", ".join(f"('{k}', '{n}', CAST({la} AS DOUBLE), CAST({lo} AS DOUBLE))" for k, (n, la, lo) in R.POSTS.items()) + ") "


@query("F18_haversine", f"SELECT a.post_id AS here, b.post_id AS there, round({_KM} + 1e-9, 6) AS km FROM {_POSTS} a(post_id, name, lat, lon), {_POSTS} b(post_id, name, lat, lon)")
def f18(t: Tables) -> DataFrame:
    a, b = R.post_table(t.spark).alias("a"), R.post_table(t.spark).alias("b")
    km = S.haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    # Four posts: the product of the table with itself has sixteen rows.
    return a.join(F.broadcast(b), F.lit(True)).select(F.col("a.post_id").alias("here"), F.col("b.post_id").alias("there"), F.round(km + 1e-9, 6).alias("km"))


@query("F19_humanise", "SELECT c_custkey, CASE WHEN h < 1 THEN CAST(CAST(round_even(h * 60, 0) AS BIGINT) AS STRING) || ' minutes ago' WHEN h < 48 THEN CAST(CAST(round_even(h, 0) AS BIGINT) AS STRING) || ' hours ago' ELSE CAST(CAST(round_even(h / 24, 0) AS BIGINT) AS STRING) || ' days ago' END AS ago FROM (SELECT c_custkey, c_custkey % 4000 / 16.0::DOUBLE AS h FROM customer)")
def f19(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", S.ago(F.col("c_custkey") % 4000 / 16.0).alias("ago"))


@query("F22_labels", "SELECT case_id, CASE doc_type WHEN 'aadhaar' THEN 'An Aadhaar card' WHEN 'pan' THEN 'A PAN card' WHEN 'voter_id' THEN 'A Voter ID' WHEN 'dl' THEN 'A driving licence' ELSE 'A ' || doc_type END AS text, 'date of birth' AS field FROM cases")
def f22(t: Tables) -> DataFrame:
    return t.cases.select("case_id", S.describe_start(F.col("doc_type")).alias("text"), S.field_label(F.lit("dob")).alias("field"))


@query("F26_hash_split", "SELECT source, CASE WHEN s < 70 THEN 'train' WHEN s < 90 THEN 'val' ELSE 'test' END AS split, n FROM (SELECT source, CAST('0x' || substr(sha1(source), 1, 8) AS BIGINT) % 100 AS s, count(*) AS n FROM documents GROUP BY source)")
def f26(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.count("*").alias("n")).withColumn("split", S.hash_split(F.col("source"))).select("source", "split", "n")


@query("F27_yolo_lines", "SELECT box_id, CAST(ordinal % 4 AS STRING) || printf(' %.6f %.6f %.6f %.6f', (x1 + x2) / 2 / 500, (y1 + y2) / 2 / 400, (x2 - x1) / 500, (y2 - y1) / 400) AS line FROM boxes")
def f27(t: Tables) -> DataFrame:
    """Label lines: class, centre and size as shares of the image."""
    b = F.col
    numbers = [(b("x1") + b("x2")) / 2 / 500, (b("y1") + b("y2")) / 2 / 400, (b("x2") - b("x1")) / 500, (b("y2") - b("y1")) / 400]
    return t.boxes.select("box_id", F.concat((b("ordinal") % 4).cast("string"), F.format_string(" %.6f %.6f %.6f %.6f", *numbers)).alias("line"))


@query("F31_normal_cdf", "WITH e AS (SELECT c_custkey, (c_custkey % 200 / 100.0::DOUBLE - 0.9) / (0.25 * sqrt(2)) AS z FROM customer), u AS (SELECT *, 1 / (1 + 0.3275911 * abs(z)) AS q FROM e) SELECT c_custkey, round((1 + sign(z) * (1 - ((((1.061405429 * q - 1.453152027) * q + 1.421413741) * q - 0.284496736) * q + 0.254829592) * q * exp(-z * z))) / 2 + 1e-9, 6) AS p FROM u")
def f31(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.round(S.normal_cdf(F.col("c_custkey") % 200 / 100.0, 0.9, 0.25) + 1e-9, 6).alias("p"))


@query("F34_derived_identity", "SELECT person_id, given || ' ' || surname AS full_name, regexp_replace(digits11, '(.{4})(.{4})(.*)', '\\1 \\2 \\3') AS grouped FROM people")
def f34(t: Tables) -> DataFrame:
    return t.people.select("person_id", F.concat_ws(" ", "given", "surname").alias("full_name"), S.group_digits(F.col("digits11")).alias("grouped"))


@query("F32_script_runs", "SELECT conv_id, turn, 2 AS n_runs FROM conversations")
def f32(t: Tables) -> DataFrame:
    mixed = F.concat(F.regexp_replace("text", "[ऀ-ॿ]", ""), F.lit("x"), F.lit("नाम"))
    return t.conversations.select("conv_id", "turn", F.size(S.script_runs(mixed)).alias("n_runs"))


@query("F33_wrap")
def f33(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", S.wrap(F.col("text"), 40).alias("lines"))


@query("P29_date_order", "SELECT person_id, CASE WHEN dob < issued AND issued < expiry THEN 'pass' ELSE 'fail' END AS verdict FROM (SELECT person_id, CASE WHEN person_id % 6 = 0 THEN expiry ELSE dob END AS dob, issued, expiry FROM people)")
def p29(t: Tables) -> DataFrame:
    dob = F.when(F.col("person_id") % 6 == 0, F.col("expiry")).otherwise(F.col("dob"))
    return t.people.select("person_id", V.date_order(dob, F.col("issued"), F.col("expiry"))["verdict"].alias("verdict"))


@query(
    "P30_expired",
    f"""WITH e AS (SELECT person_id, expiry, abs(date_diff('day', CAST(expiry AS DATE), DATE '{TODAY}')) AS days FROM people)
SELECT person_id, CASE WHEN CAST(expiry AS DATE) < DATE '{TODAY}' THEN 'fail' ELSE 'pass' END AS verdict, CASE WHEN CAST(expiry AS DATE) < DATE '{TODAY}' THEN 'Expired on ' || expiry || ', ' || (days // 365) || ' years ' || (days % 365 // 30) || ' months ago'
 ELSE 'Expires ' || expiry || ', valid for another ' || (days // 365) || ' years ' || (days % 365 // 30) || ' months' END AS evidence FROM e""",
)
def p30(t: Tables) -> DataFrame:
    return t.people.select("person_id", V.expiry(F.lit("passport"), F.col("expiry"), today()).alias("s")).select("person_id", "s.verdict", "s.evidence")


@query("P31_validity_period", "SELECT person_id, CASE WHEN abs(y - 10) < 0.6 OR abs(y - 5) < 0.6 THEN 'pass' ELSE 'fail' END AS verdict FROM (SELECT person_id, date_diff('day', CAST(issued AS DATE), CAST(expiry AS DATE)) / 365.25 AS y FROM people)")
def p31(t: Tables) -> DataFrame:
    return t.people.select("person_id", V.validity_period(F.lit("passport"), F.col("issued"), F.col("expiry"))["verdict"].alias("verdict"))


@query("P32_age", f"SELECT person_id, date_diff('day', CAST(dob AS DATE), DATE '{TODAY}') / 365.25 BETWEEN 0 AND 70 AS plausible FROM people")
def p32(t: Tables) -> DataFrame:
    return t.people.select("person_id", V.plausible_age(F.col("dob"), today(), 70).alias("plausible"))


@query(
    "P33_viz_mrz",
    f"""WITH {PARTS}, p AS (SELECT person_id, given || ' ' || surname AS mname, 'name' AS field, CASE WHEN person_id % 4 = 0 THEN surname WHEN person_id % 4 = 1 THEN 'OTHER PERSON' ELSE given || ' ' || surname END AS printed FROM people)
SELECT person_id, CASE WHEN person_id % 4 = 1 THEN 'fail' ELSE 'pass' END AS name_verdict, CASE WHEN z.person_id % 9 = 0 THEN 'inconclusive' WHEN z.person_id % 5 = 0 AND substr(z2, 14, 1) <> substr(b, 1, 1) THEN 'fail' ELSE 'pass' END AS dob_verdict FROM zones z""",
)
def p33(t: Tables) -> DataFrame:
    """Printed fields against the zone: names by token subset, dates equal, read-by-fallback fields left open."""
    k = F.col("person_id")
    printed = F.when(k % 4 == 0, F.col("surname")).when(k % 4 == 1, "Other Person").otherwise(F.concat_ws(" ", "given", "surname"))
    m = strips(t).withColumn("m", M.parse(F.col("strip"), today())).withColumn("printed", printed)
    source = F.when(k % 9 == 0, "vlm").otherwise("ocr")
    machine = F.concat_ws(" ", "m.given_names", "m.surname")
    return m.select("person_id", V.compare_names(F.col("printed"), machine, F.lit("ocr")).alias("name_verdict"), V.compare_dates(F.col("dob"), F.col("m.birth_date"), source).alias("dob_verdict"))


@query("P27_length_limits", "SELECT page_id, length(url) > 24 AS url_long, length(html) > 240 AS html_long FROM pages")
def p27(t: Tables) -> DataFrame:
    return t.pages.select("page_id", V.too_long("id_number", F.col("url")).alias("url_long"), V.too_long("address", F.col("html")).alias("html_long"))


@query("P28_forbidden_classes", "SELECT image_id, string_agg(DISTINCT class, ',' ORDER BY class) AS classes FROM boxes WHERE (doc_type = 'pan' AND class IN ('photo')) OR (doc_type = 'visa' AND class IN ('id_number', 'dob')) GROUP BY image_id")
def p28(t: Tables) -> DataFrame:
    """Boxes of classes that a document type must not have, listed per image (semi join)."""
    banned = t.spark.createDataFrame([("pan", "photo"), ("visa", "id_number"), ("visa", "dob")], "doc_type string, class string")
    hit = t.boxes.join(F.broadcast(banned), ["doc_type", "class"], "left_semi")
    return hit.groupBy("image_id").agg(F.array_join(F.array_sort(F.collect_set("class")), ",").alias("classes"))


@query("P9_unread_fields", "SELECT i.image_id, w.class FROM (SELECT DISTINCT image_id FROM boxes) i CROSS JOIN (VALUES ('dob'), ('name'), ('id_number'), ('address')) w(class) WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE b.image_id = i.image_id AND b.class = w.class AND b.confidence > 0.6)")
def p9(t: Tables) -> DataFrame:
    """Declared fields that were not located (anti join)."""
    declared = t.boxes.select("image_id").distinct().withColumn("class", F.explode(F.array(*map(F.lit, ["dob", "name", "id_number", "address"]))))
    return declared.join(t.boxes.filter("confidence > 0.6"), ["image_id", "class"], "left_anti")


@query("P1_quality", "SELECT box_id, CASE WHEN least(x1, y1) >= 60 THEN 'pass' ELSE 'fail' END AS resolution, CASE WHEN x2 >= 180 THEN 'pass' ELSE 'fail' END AS blur, CASE WHEN x2 >= 180 THEN 1.0::DOUBLE ELSE round(least(1, 0.5 + (180 - x2) / 180) + 1e-9, 6) END AS blur_confidence, CASE WHEN y2 BETWEEN 40 AND 215 THEN 'pass' ELSE 'fail' END AS brightness FROM boxes")
def p1(t: Tables) -> DataFrame:
    """Capture quality verdicts: resolution, blur with confidence, brightness."""
    sharp, light = F.col("x2"), F.col("y2")
    mark = lambda ok: F.when(ok, "pass").otherwise("fail")
    blur = F.when(sharp >= 180, F.lit(1.0)).otherwise(F.round(F.least(F.lit(1.0), 0.5 + (180 - sharp) / 180) + 1e-9, 6))
    return t.boxes.select("box_id", mark(F.least("x1", "y1") >= 60).alias("resolution"), mark(sharp >= 180).alias("blur"), blur.alias("blur_confidence"), mark(light.between(40, 215)).alias("brightness"))


@query("P5_sharpest_frame", "SELECT image_id, arg_max(box_id, (x2, box_id)) AS box_id FROM boxes GROUP BY image_id")
def p5(t: Tables) -> DataFrame:
    return t.boxes.groupBy("image_id").agg(F.max_by("box_id", F.struct("x2", "box_id")).alias("box_id"))


@query("P53_field_state", "SELECT box_id, CASE WHEN confidence >= 0.75 THEN 'pass' ELSE 'inconclusive' END AS state FROM boxes")
def p53(t: Tables) -> DataFrame:
    return t.boxes.select("box_id", F.when(F.col("confidence") >= 0.75, "pass").otherwise("inconclusive").alias("state"))


@query("P52_face_margin", "SELECT vec_id, CASE WHEN m > 0.06 THEN 'match' WHEN m < -0.06 THEN 'no_match' ELSE 'review' END AS band FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS m FROM vectors)")
def p52(t: Tables) -> DataFrame:
    m = F.get("embedding", F.lit(0)).cast("double")
    return t.vectors.select("vec_id", F.when(m > 0.06, "match").when(m < -0.06, "no_match").otherwise("review").alias("band"))


@query("P49_liveness", "SELECT vec_id, CASE WHEN s >= 0.6 THEN 'pass' ELSE 'fail' END AS verdict, round(least(1, abs(s - 0.5) / 0.1) + 1e-9, 6) AS confidence FROM (SELECT vec_id, abs(CAST(embedding[1] AS DOUBLE)) * 3 AS s FROM vectors)")
def p49(t: Tables) -> DataFrame:
    """Passive liveness with certainty over its review band (P49, P48's certainty)."""
    s = F.abs(F.get("embedding", F.lit(0)).cast("double")) * 3
    return t.vectors.select("vec_id", F.when(s >= 0.6, "pass").otherwise("fail").alias("verdict"), F.round(S.certainty(s, 0.4, 0.6) + 1e-9, 6).alias("confidence"))


@query("P18_parse_regions", "SELECT box_id, x1 AS bx1, y1 AS by1, x2 AS bx2, y2 AS by2 FROM (SELECT box_id, CAST(CAST(x1 AS INT) AS DOUBLE) AS x1, CAST(CAST(y1 AS INT) AS DOUBLE) AS y1, CAST(CAST(x2 AS INT) AS DOUBLE) AS x2, CAST(CAST(y2 AS INT) AS DOUBLE) AS y2 FROM boxes)")
def p18(t: Tables) -> DataFrame:
    """Boxes out of location marks in a reader's text."""
    mark = lambda c: F.concat(F.lit("<loc_"), F.col(c).cast("int").cast("string"), F.lit(">"))
    text = F.concat(F.lit("NAME"), mark("x2"), mark("y1"), mark("x1"), mark("y2"))
    return t.boxes.select("box_id", V.parse_region(text).alias("r")).select("box_id", F.col("r.x1").alias("bx1"), F.col("r.y1").alias("by1"), F.col("r.x2").alias("bx2"), F.col("r.y2").alias("by2"))


@query("P17_date_assignment", "SELECT user_id, d[1] AS dob, d[2] AS issued, d[3] AS expiry FROM (SELECT user_id, list_sort(list(DISTINCT strftime(ts, '%Y-%m-%d'))) AS d FROM crossings GROUP BY user_id)")
def p17(t: Tables) -> DataFrame:
    """Distinct dates in order become birth, issue and expiry."""
    days = F.array_sort(F.collect_set(F.date_format("ts", "yyyy-MM-dd"))).alias("d")
    return t.crossings.groupBy("user_id").agg(days).select("user_id", F.get("d", F.lit(0)).alias("dob"), F.get("d", F.lit(1)).alias("issued"), F.get("d", F.lit(2)).alias("expiry"))


@query("P14_priority_merge", "SELECT user_id, field, arg_min(value, (pr, event_id)) AS value FROM (SELECT user_id, 'f' || CAST(event_id % 3 AS STRING) AS field, value, event_id, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS pr FROM crossings) GROUP BY ALL")
def p14(t: Tables) -> DataFrame:
    """Fields from several readers: those read off the print win over the code, the code over the fallback."""
    source = F.get(F.array(*map(F.lit, ["ocr", "mrz", "qr", "vlm"])), (F.col("event_id") % 4).cast("int"))
    rows = t.crossings.select("user_id", F.concat(F.lit("f"), (F.col("event_id") % 3).cast("string")).alias("field"), "value", "event_id", source.alias("source"))
    return V.merge_fields(rows, ["user_id", "field"], "event_id")


@query("P13_fallback_trigger", "SELECT image_id, count(*) FILTER (confidence < 0.5) AS unread, count(*) AS attempted, count(*) FILTER (confidence < 0.5) > 0 AND count(*) FILTER (confidence < 0.5)::DOUBLE / count(*) >= 0.34 AS run FROM boxes GROUP BY image_id")
def p13(t: Tables) -> DataFrame:
    unread = F.count_if(F.col("confidence") < 0.5)
    return t.boxes.groupBy("image_id").agg(unread.alias("unread"), F.count("*").alias("attempted"), ((unread > 0) & (unread / F.count("*") >= 0.34)).alias("run"))
