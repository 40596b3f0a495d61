"""Validation checks as Column expressions: each gives a verdict, mostly with evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import scalars as S
from attesta.plans import rules as R

#: Longest plausible values of fields, and document types that carry an expiry date.
CEILINGS = {"name": 80, "father_name": 80, "address": 240, "id_number": 24}
WITH_EXPIRY = ["passport", "visa", "dl"]
PRINTED = ["ocr", "mrz", "vlm"]
COMPARABLE = ["ocr", "mrz", "qr"]
PRIORITY = ["ocr", "mrz", "qr", "vlm"]


def signal(verdict: Column, evidence: Column) -> Column:
    return F.struct(verdict.alias("verdict"), evidence.alias("evidence"))


def day(text: Column) -> Column:
    return F.try_to_date(S.iso_date(text), "yyyy-MM-dd")


def date_order(dob: Column, issued: Column, expiry: Column) -> Column:
    """Birth before issue before expiry, of those that are known; open with fewer than two."""
    b, i, e = day(dob), day(issued), day(expiry)
    iso = lambda d: F.date_format(d, "yyyy-MM-dd")
    known = sum((d.isNotNull().cast("int") for d in (b, i, e)), F.lit(0))
    problems = F.array_compact(
        F.array(
            F.when(b >= i, F.concat(F.lit("date of birth "), iso(b), F.lit(" is not before the issue date "), iso(i))),
            F.when(i >= e, F.concat(F.lit("issue date "), iso(i), F.lit(" is not before the expiry date "), iso(e))),
            F.when(b >= e, F.concat(F.lit("date of birth "), iso(b), F.lit(" is not before the expiry date "), iso(e))),
        )
    )
    shown = F.array_join(F.array_compact(F.array(F.concat(F.lit("born "), iso(b)), F.concat(F.lit("issued "), iso(i)), F.concat(F.lit("expires "), iso(e)))), ", ")
    verdict = F.when(known < 2, "inconclusive").when(F.size(problems) > 0, "fail").otherwise("pass")
    evidence = (
        F.when(known < 2, "Not enough dates could be read to check their ordering")
        .when(F.size(problems) > 0, F.concat(F.lit("The printed dates are inconsistent: "), F.array_join(problems, "; ")))
        .otherwise(F.concat(F.lit("Printed dates are in order: "), shown))
    )
    return signal(verdict, evidence)


def expiry(doc_type: Column, text: Column, today: Column) -> Column:
    """Expired strictly before today; not applicable to types without an expiry date."""
    e = day(text)
    days = F.abs(F.datediff(today, e))
    period = F.concat(F.floor(days / 365).cast("string"), F.lit(" years "), F.floor(days % 365 / 30).cast("string"), F.lit(" months"))
    verdict = F.when(~doc_type.isin(WITH_EXPIRY), "not_applicable").when(e.isNull(), "inconclusive").when(e < today, "fail").otherwise("pass")
    evidence = (
        F.when(~doc_type.isin(WITH_EXPIRY), F.concat(S.describe_start(doc_type), F.lit(" does not carry an expiry date")))
        .when(e.isNull(), "The expiry date could not be read")
        .when(e < today, F.concat(F.lit("Expired on "), F.date_format(e, "yyyy-MM-dd"), F.lit(", "), period, F.lit(" ago")))
        .otherwise(F.concat(F.lit("Expires "), F.date_format(e, "yyyy-MM-dd"), F.lit(", valid for another "), period))
    )
    return signal(verdict, evidence)


def validity_period(doc_type: Column, issued: Column, expires: Column) -> Column:
    """Whether the years of validity are usual for the type, give or take 0.6; null without both dates."""
    years = F.datediff(day(expires), day(issued)) / 365.25
    usual = F.lit(None).cast("boolean")
    for name, allowed in R.VALIDITY_YEARS.items():
        near = F.lit(False)
        for a in allowed:
            near = near | (F.abs(years - a) < 0.6)
        usual = F.when(doc_type == name, near).otherwise(usual)
    text = F.when(usual, F.concat(F.lit("Valid for "), F.bround(years, 0).cast("int").cast("string"), F.lit(" years, a standard period for "), S.describe(doc_type))).otherwise(
        F.concat(F.format_string("Valid for %.1f years, which is not a standard period for ", years), S.describe(doc_type))
    )
    return F.when(usual.isNotNull() & years.isNotNull(), signal(F.when(usual, "pass").otherwise("fail"), text))


def plausible_age(dob: Column, today: Column, most: int = 120) -> Column:
    return (F.datediff(today, day(dob)) / 365.25).between(0, most)


def too_long(field: str, value: Column) -> Column:
    return F.length(value) > CEILINGS[field]


def _compared(printed: Column, machine: Column, source: Column, agree: Column) -> Column:
    """Null without a machine value; open where the printed value is missing, or wasn't read off the print to the character."""
    return (
        F.when(machine.isNull() | machine.isin("", "<"), F.lit(None).cast("string"))
        .when(printed.isNull() | ~source.isin(PRINTED) | ~source.isin(COMPARABLE), "inconclusive")
        .when(agree.isNull(), "inconclusive")
        .otherwise(F.when(agree, "pass").otherwise("fail"))
    )


def compare_names(printed: Column, machine: Column, source: Column) -> Column:
    """Names agree if the words of one are all among the other's, as zones cut long names."""
    a, b = S.name(printed), S.name(machine)
    left, right = F.split(a, " "), F.split(b, " ")
    inside = (F.size(F.array_except(left, right)) == 0) | (F.size(F.array_except(right, left)) == 0)
    return _compared(printed, machine, source, (a == b) | ((a != "") & (b != "") & inside))


def compare_dates(printed: Column, machine: Column, source: Column) -> Column:
    return _compared(printed, machine, source, S.iso_date(printed) == S.iso_date(machine))


def compare_exact(printed: Column, machine: Column, source: Column) -> Column:
    return _compared(printed, machine, source, S.id_number(printed) == S.id_number(machine))


def parse_region(text: Column) -> Column:
    """The box of a text's location marks: marks alternate between x and y; null with fewer than four."""
    marks = F.transform(F.regexp_extract_all(text, F.lit(r"<loc_(\d+)>"), 1), lambda m: m.cast("double"))
    xs, ys = F.filter(marks, lambda _, i: i % 2 == 0), F.filter(marks, lambda _, i: i % 2 == 1)
    return F.when(F.size(marks) >= 4, F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2")))


def merge_fields(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One value for each key: print and zone before the signed code, that before the fallback reader; the earliest among equals."""
    rank = F.when(F.col("source").isin("ocr", "mrz"), 0).when(F.col("source") == "qr", 1).otherwise(2)
    return rows.groupBy(*keys).agg(F.min_by("value", F.struct(rank.alias("rank"), F.col(order))).alias("value"))
