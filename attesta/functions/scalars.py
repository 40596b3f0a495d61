"""Normalisers, keys and formatters as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions.ed25519 import VERSION
from attesta.plans import rules as R

#: Latin letters with marks, and the plain letters they stand for once marks are dropped.
_MARKED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿĀāĂăĄąĆćĈĉĊċČčĎďĒēĔĕĖėĘęĚěĜĝĞğĠġĢģĤĥĨĩĪīĬĭĮįİĴĵĶķĹĺĻļĽľŃńŅņŇňŌōŎŏŐőŔŕŖŗŘřŚśŜŝŞşŠšŢţŤťŨũŪūŬŭŮůŰűŲųŴŵŶŷŸŹźŻżŽž"
_PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyyAaAaAaCcCcCcCcDdEeEeEeEeEeGgGgGgGgHhIiIiIiIiIJjKkLlLlLlNnNnNnOoOoOoRrRrRrSsSsSsSsTtTtUuUuUuUuUuUuWwYyYZzZzZz"

#: Printed date forms, strict in the number of digits.
DATE_FORMS = [
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{2}/\d{2}/\d{4}$", "dd/MM/yyyy"),
    (r"^\d{2}-\d{2}-\d{4}$", "dd-MM-yyyy"),
    (r"^\d{2}\.\d{2}\.\d{4}$", "dd.MM.yyyy"),
    (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"),
]
_MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def name(value: Column) -> Column:
    """Upper-case Latin letters and digits, marks dropped, everything else one blank; null becomes empty."""
    plain = F.translate(F.coalesce(value, F.lit("")), _MARKED, _PLAIN)
    return squeeze(F.regexp_replace(F.upper(F.regexp_replace(plain, "[̀-ͯ]", "")), "[^A-Z0-9 ]+", " "))


def iso_date(value: Column, past: bool = False, today: Column | None = None) -> Column:
    """A printed date as yyyy-MM-dd; null if it isn't one, or lies after ``today`` where the past is asked for."""
    text = squeeze(value)
    found = None
    for pattern, form in DATE_FORMS:
        hit, day = F.rlike(text, F.lit(pattern)), F.try_to_date(text, form)
        found = F.when(hit, day) if found is None else found.when(hit, day)
    named = F.rlike(text, F.lit(r"^\d{2} [A-Za-z]{3} \d{4}$"))
    month = F.lpad(F.array_position(F.array(*map(F.lit, _MONTHS)), F.upper(F.substring(text, 4, 3))).cast("string"), 2, "0")
    day = found.when(named, F.try_to_date(F.concat(F.substring(text, 8, 4), F.lit("-"), month, F.lit("-"), F.substring(text, 1, 2)), "yyyy-MM-dd"))
    out = F.date_format(day, "yyyy-MM-dd")
    return F.when(day <= today, out) if past and today is not None else out


def gender(value: Column) -> Column:
    text = F.upper(F.trim(value))
    return F.when(text.isin("M", "MALE", "PURUSH"), "M").when(text.isin("F", "FEMALE", "MAHILA"), "F").when(text.isin("<", "X", "O", "OTHER", "TRANSGENDER", "T"), "<")


def id_number(value: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(value, F.lit("")), r"[\s\-]", ""))


def watchlist_key(value: Column) -> Column:
    """Tokens of the name in order of the alphabet."""
    return F.array_join(F.array_sort(F.split(name(value), " ")), " ")


def phonetic_key(key: Column) -> Column:
    """Soundex codes of a watchlist key's tokens, sorted. Tokens without a letter have an empty code."""
    codes = F.transform(F.filter(F.split(key, " "), lambda t: t != ""), lambda t: F.soundex(F.regexp_replace(t, "[^A-Za-z]", "")))
    return F.array_join(F.array_sort(codes), " ")


def canonical(issuer: Column, fields: list[Column]) -> Column:
    """The canonical string of a payload: version, issuer and fields, squeezed, null as empty, joined by 0x1f."""
    return F.concat_ws("\x1f", F.lit(VERSION), *(F.coalesce(squeeze(c.cast("string")), F.lit("")) for c in (issuer, *fields)))


def doc_hash(issuer: Column, fields: list[Column]) -> Column:
    return F.sha2(F.encode(canonical(issuer, fields), "UTF-8"), 256)


def hash_id_number(number: Column, salt: str) -> Column:
    """struct(hash, last4) of the letters and digits of an identity number; null where there are none."""
    digits = F.regexp_replace(number, r"[^\p{L}\p{N}]", "")
    return F.when(F.length(digits) > 0, F.struct(F.sha2(F.encode(F.concat(F.lit(salt), digits), "UTF-8"), 256).alias("hash"), F.right(digits, F.lit(4)).alias("last4")))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b, c, d = (F.radians(x) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return 2 * F.lit(6371.0) * F.asin(F.sqrt(h))


def ago(hours: Column) -> Column:
    return (
        F.when(hours < 1, F.concat(F.bround(hours * 60, 0).cast("long").cast("string"), F.lit(" minutes ago")))
        .when(hours < 48, F.concat(F.bround(hours, 0).cast("long").cast("string"), F.lit(" hours ago")))
        .otherwise(F.concat(F.bround(hours / 24, 0).cast("long").cast("string"), F.lit(" days ago")))
    )


def span(hours: Column) -> Column:
    return (
        F.when(hours < 1, F.concat(F.bround(hours * 60, 0).cast("long").cast("string"), F.lit(" minutes")))
        .when(hours < 48, F.format_string("%.1f hours", hours))
        .otherwise(F.format_string("%.1f days", hours / 24))
    )


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / F.when(norm > 0, norm)).otherwise(F.lit(0.0))


def certainty(value: Column, low: float, high: float) -> Column:
    """1 outside the band low..high, falling to 0 at its middle."""
    middle, half = (low + high) / 2, (high - low) / 2
    return F.least(F.lit(1.0), F.abs(value - middle) / half)


def label(doc_type: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in R.DOC_LABEL.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, doc_type), F.replace(doc_type, F.lit("_"), F.lit(" ")))


def describe(doc_type: Column) -> Column:
    text = label(doc_type)
    return F.concat(F.when(F.rlike(text, F.lit("^[AEIOUaeiou]")), "an ").otherwise("a "), text)


def describe_start(doc_type: Column) -> Column:
    text = describe(doc_type)
    return F.concat(F.upper(F.substring(text, 1, 1)), text.substr(F.lit(2), F.length(text)))


def field_label(field: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in R.FIELD_LABEL.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, field), F.replace(field, F.lit("_"), F.lit(" ")))


def erf(x: Column) -> Column:
    """Rational approximation of the error function (Abramowitz and Stegun 7.1.26)."""
    t = 1 / (1 + F.lit(0.3275911) * F.abs(x))
    poly = ((((F.lit(1.061405429) * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def normal_cdf(x: Column, mean: float, deviation: float) -> Column:
    return (1 + erf((x - mean) / (deviation * 2**0.5))) / 2


def group_digits(number: Column) -> Column:
    """Blanks after every fourth character."""
    return F.regexp_replace(number, "(.{4})(?=.)", "$1 ")


def hash_split(key: Column) -> Column:
    """train, val or test by the first eight hex digits of the key's SHA-1: 70, 20 and 10 of a hundred."""
    slot = F.conv(F.substring(F.sha1(F.encode(key, "UTF-8")), 1, 8), 16, 10).cast("long") % 100
    return F.when(slot < 70, "train").when(slot < 90, "val").otherwise("test")


def script_runs(text: Column) -> Column:
    """Runs of Devanagari and of other characters."""
    return F.regexp_extract_all(text, F.lit("([ऀ-ॿ]+|[^ऀ-ॿ]+)"), 1)


def wrap(text: Column, width: int, lines: int = 3) -> Column:
    """Words in lines of at most ``width`` characters (a longer word alone), the first ``lines`` of them."""
    start = F.array().cast("array<string>")

    def put(acc: Column, word: Column) -> Column:
        last = F.coalesce(F.try_element_at(acc, F.size(acc)), F.lit(""))
        fits = (F.size(acc) > 0) & (F.length(last) + 1 + F.length(word) <= width)
        body = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(fits, F.concat(body, F.array(F.concat(last, F.lit(" "), word)))).otherwise(F.concat(acc, F.array(word)))

    return F.slice(F.aggregate(F.filter(F.split(text, r"\s+"), lambda w: w != ""), start, put), 1, lines)
