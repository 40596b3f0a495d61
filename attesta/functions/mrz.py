"""Machine-readable zones as Column expressions: check digits, parsing of TD3, MRV-A and MRV-B, and building."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def char_value(c: Column) -> Column:
    """Digits are themselves, A..Z 10..35, the filler 0."""
    return F.greatest(F.instr(F.lit(ALPHABET), c) - 1, F.lit(0))


def check_digit(value: Column) -> Column:
    """Sum of values by the weights 7, 3, 1, modulo 10."""
    parts = F.transform(F.split(value, ""), lambda c, i: char_value(c) * F.when(i % 3 == 0, 7).when(i % 3 == 1, 3).otherwise(1))
    return (F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10).cast("string")


def verify(value: Column, digit: Column) -> Column:
    """A filler as digit means that the field isn't used, so it must be all filler."""
    return F.when(digit == "<", F.rlike(value, F.lit("^<*$"))).when(F.rlike(digit, F.lit("^[0-9]$")), check_digit(value) == digit).otherwise(F.lit(False))


def parse_date(text: Column, today: Column, past: bool) -> Column:
    """yyMMdd as yyyy-MM-dd: births don't lie ahead of today, expiries not over fifty years behind."""
    century = F.year(today) - F.year(today) % 100
    good = F.rlike(text, F.lit("^[0-9]{6}$"))
    day = lambda year: F.try_to_date(
        F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.substring(text, 3, 2), F.substring(text, 5, 2)), "yyyy-MM-dd"
    )
    year = century + F.substring(text, 1, 2).try_cast("int")
    first = day(year)
    moved = F.when(first > today, day(year - 100)).otherwise(first) if past else F.when(F.year(first) < F.year(today) - 50, day(year + 100)).otherwise(first)
    return F.when(good & first.isNotNull(), F.date_format(moved, "yyyy-MM-dd"))


def _spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "<+", " "))


def check_fields(strip: Column) -> Column:
    """(field, value, digit) of each check digit of a two-line zone; null where it can't be read.

    Only the second line is looked at, and each place of it once, so a plan that needs nothing else stays small.
    """
    form = F.regexp_extract(F.upper(F.regexp_replace(strip, r"[ \t]", "")), r"^\s*([A-Z0-9<]{44}|[A-Z0-9<]{36})\r?\n([A-Z0-9<]{44}|[A-Z0-9<]{36})\s*$", 2)

    def places(line: Column) -> Column:
        one = lambda name, value, at: F.struct(F.lit(name).alias("field"), value.alias("value"), F.substring(line, at, 1).alias("digit"))
        three = F.array(one("document_number", F.substring(line, 1, 9), 10), one("dob", F.substring(line, 14, 6), 20), one("expiry", F.substring(line, 22, 6), 28))
        whole = F.concat(F.substring(line, 1, 10), F.substring(line, 14, 7), F.substring(line, 22, 22))
        two = F.array(one("optional", F.substring(line, 29, 14), 43), one("composite", whole, 44))
        passport = (F.length(line) == 44) & ~F.startswith(F.upper(F.ltrim(strip)), F.lit("V"))
        return F.when(passport, F.concat(three, two)).when(F.length(line) > 0, three)

    return F.get(F.transform(F.array(form), places), F.lit(0))


def parse(strip: Column, today: Column) -> Column:
    """struct of the zone's fields and check digits; null fields and a reason where it can't be read."""
    lines = F.filter(F.transform(F.split(F.trim(strip), r"\r?\n"), lambda x: F.upper(F.regexp_replace(x, r"\s", ""))), lambda x: x != "")
    l1, l2 = F.coalesce(F.get(lines, F.lit(0)), F.lit("")), F.coalesce(F.get(lines, F.lit(1)), F.lit(""))
    two = F.size(lines) == 2
    charset = ~F.rlike(F.concat(l1, l2), F.lit("[^A-Z0-9<]"))
    long, short = (F.length(l1) == 44) & (F.length(l2) == 44), (F.length(l1) == 36) & (F.length(l2) == 36)
    reason = F.when(~two, "lines").when(~charset, "charset").when(~(long | short), "length")
    ok = reason.isNull()
    form = F.when(ok & long & F.startswith(l1, F.lit("V")), "MRVA").when(ok & long, "TD3").when(ok, "MRVB")
    names = F.substring(l1, 6, 39)
    tail = lambda a, n: F.regexp_replace(F.substring(l2, a, n), "<+$", "")
    digits = F.array(
        F.struct(F.lit("document_number").alias("field"), F.substring(l2, 1, 9).alias("value"), F.substring(l2, 10, 1).alias("digit")),
        F.struct(F.lit("dob").alias("field"), F.substring(l2, 14, 6).alias("value"), F.substring(l2, 20, 1).alias("digit")),
        F.struct(F.lit("expiry").alias("field"), F.substring(l2, 22, 6).alias("value"), F.substring(l2, 28, 1).alias("digit")),
    )
    more = F.array(
        F.struct(F.lit("optional").alias("field"), F.substring(l2, 29, 14).alias("value"), F.substring(l2, 43, 1).alias("digit")),
        F.struct(F.lit("composite").alias("field"), F.concat(F.substring(l2, 1, 10), F.substring(l2, 14, 7), F.substring(l2, 22, 22)).alias("value"), F.substring(l2, 44, 1).alias("digit")),
    )
    given = lambda c: F.when(ok, c)
    return F.struct(
        form.alias("format"),
        given(F.regexp_replace(F.substring(l1, 1, 2), "<+$", "")).alias("doc_code"),
        given(F.regexp_replace(F.substring(l1, 3, 3), "<+$", "")).alias("issuing_state"),
        given(_spaced(F.get(F.split(names, "<<", 2), F.lit(0)))).alias("surname"),
        given(_spaced(F.coalesce(F.get(F.split(names, "<<", 2), F.lit(1)), F.lit("")))).alias("given_names"),
        given(tail(1, 9)).alias("document_number"),
        given(tail(11, 3)).alias("nationality"),
        given(parse_date(F.substring(l2, 14, 6), today, True)).alias("birth_date"),
        given(F.substring(l2, 21, 1)).alias("sex"),
        given(parse_date(F.substring(l2, 22, 6), today, False)).alias("expiry_date"),
        F.when(form == "TD3", tail(29, 14)).when(form == "MRVA", tail(29, 16)).when(form == "MRVB", tail(29, 8)).alias("optional_data"),
        F.when(form == "TD3", F.concat(digits, more)).when(ok, digits).alias("check_digits"),
        reason.alias("reason"),
    )


def _pad(text: Column, n: int) -> Column:
    return F.rpad(F.replace(F.upper(text), F.lit(" "), F.lit("<")), n, "<")


def build_td3(doc_code: Column, state: Column, surname: Column, given: Column, number: Column, nationality: Column, birth: Column, sex: Column, expiry: Column, optional: Column) -> Column:
    """The two lines of a passport zone, every check digit computed; dates are yyyy-MM-dd."""
    short = lambda d: F.when(F.length(d) > 0, F.substring(F.replace(d, F.lit("-"), F.lit("")), 3, 6)).otherwise("<<<<<<")
    names = F.concat(F.replace(F.upper(surname), F.lit(" "), F.lit("<")), F.lit("<<"), F.replace(F.upper(given), F.lit(" "), F.lit("<")))
    num, dob, exp, opt = _pad(number, 9), short(birth), short(expiry), _pad(optional, 14)
    mark = F.when(F.length(sex) > 0, F.substring(sex, 1, 1)).otherwise("<")
    body = F.concat(num, check_digit(num), _pad(nationality, 3), dob, check_digit(dob), mark, exp, check_digit(exp), opt, check_digit(opt))
    final = check_digit(F.concat(F.substring(body, 1, 10), F.substring(body, 14, 7), F.substring(body, 22, 22)))
    return F.concat(_pad(doc_code, 2), _pad(state, 3), _pad(names, 39), F.lit("\n"), body, final)


#: Letters that readers give for digits, and digits for letters.
_TO_DIGIT = ("OQDILZSBG", "000112586")
_TO_LETTER = ("012568", "OIZSGB")


def positional(line: Column) -> Column:
    """Second line of a passport zone with look-alike characters put right by position: dates and check digits are digits, the nationality letters."""
    digit = lambda a, n: F.translate(F.substring(line, a, n), *_TO_DIGIT)
    return F.concat(F.substring(line, 1, 9), digit(10, 1), F.translate(F.substring(line, 11, 3), *_TO_LETTER), digit(14, 7), F.substring(line, 21, 1), digit(22, 7), F.substring(line, 29, 14), digit(43, 2))
