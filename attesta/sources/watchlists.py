"""Watchlist sources: a sanctions list as headerless CSV with aliases, and a consolidated list as XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import scalars as S

# The columns of both CSV files, and the mark for null.
SDN = "ent_num long, name string, sdn_type string, program string, title string, call_sign string, vess_type string, tonnage string, grt string, vess_flag string, vess_owner string, remarks string"
ALT = "ent_num long, alt_num long, alt_type string, alt_name string, alt_remarks string"
NULL = "-0-"
MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()


def birth_date(remarks: F.Column) -> F.Column:
    """The date of ``DOB dd Mon yyyy`` in remarks; other forms stay null."""
    day, month, year = (F.regexp_extract(remarks, r"DOB (\d{2}) ([A-Za-z]{3}) (\d{4})", i) for i in (1, 2, 3))
    number = F.lpad(F.array_position(F.array(*map(F.lit, MONTHS)), F.upper(month)).cast("string"), 2, "0")
    return F.when(year != "", F.date_format(F.try_to_date(F.concat_ws("-", year, number, day), "yyyy-MM-dd"), "yyyy-MM-dd"))


def document_numbers(remarks: F.Column) -> F.Column:
    """Passport and national id numbers named in remarks, distinct and sorted."""
    found = F.regexp_extract_all(F.coalesce(remarks, F.lit("")), F.lit(r"(?:Passport|National ID No\.|Identification Number) ([A-Z0-9]+)"), 1)
    return F.array_sort(F.array_distinct(found))


def read_sdn(spark: SparkSession, sdn: str, alt: str | None = None) -> DataFrame:
    """Individuals of a sanctions list: (source, name, name_key, aliases, dob, doc_numbers)."""
    rows = spark.read.schema(SDN).option("nullValue", NULL).option("ignoreTrailingWhiteSpace", True).option("ignoreLeadingWhiteSpace", True).csv(sdn)
    people = rows.filter((F.lower("sdn_type") == "individual") & (F.length(F.coalesce("name", F.lit(""))) > 0))
    empty = F.array().cast("array<string>")
    if alt:
        names = spark.read.schema(ALT).option("nullValue", NULL).option("ignoreTrailingWhiteSpace", True).option("ignoreLeadingWhiteSpace", True).csv(alt)
        people = people.join(names.filter("alt_name is not null").groupBy("ent_num").agg(F.array_sort(F.collect_list("alt_name")).alias("aliases")), "ent_num", "left")
    else:
        people = people.withColumn("aliases", empty)
    return people.select(
        F.lit("OFAC").alias("source"), "name", S.watchlist_key(F.col("name")).alias("name_key"), F.coalesce("aliases", empty).alias("aliases"),
        birth_date(F.col("remarks")).alias("dob"), document_numbers(F.col("remarks")).alias("doc_numbers"),
    )


UN = (
    "FIRST_NAME string, SECOND_NAME string, THIRD_NAME string, FOURTH_NAME string, INDIVIDUAL_ALIAS array<struct<ALIAS_NAME:string>>, "
    "INDIVIDUAL_DATE_OF_BIRTH array<struct<DATE:string>>, INDIVIDUAL_DOCUMENT array<struct<NUMBER:string>>, NATIONALITY struct<VALUE:string>"
)


def read_consolidated(spark: SparkSession, path: str) -> DataFrame:
    """Individuals of a consolidated list in XML, in the same columns; document numbers are kept as written."""
    rows = spark.read.format("xml").option("rowTag", "INDIVIDUAL").schema(UN).load(path)
    name = F.concat_ws(" ", "FIRST_NAME", "SECOND_NAME", "THIRD_NAME", "FOURTH_NAME")
    text = lambda c, f: F.array_compact(F.coalesce(F.transform(c, lambda x: x[f]), F.array().cast("array<string>")))
    return rows.filter(F.length(name) > 0).select(
        F.lit("UN").alias("source"), name.alias("name"), S.watchlist_key(name).alias("name_key"), text("INDIVIDUAL_ALIAS", "ALIAS_NAME").alias("aliases"),
        S.iso_date(F.get("INDIVIDUAL_DATE_OF_BIRTH", F.lit(0))["DATE"]).alias("dob"), text("INDIVIDUAL_DOCUMENT", "NUMBER").alias("doc_numbers"),
    )
