"""Reference tables from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Codes on travel documents that the ISO list doesn't have.
ICAO_EXTRA = {
    "D": "Germany", "GBD": "United Kingdom (British Overseas Territories citizen)", "GBN": "United Kingdom (British National Overseas)",
    "GBO": "United Kingdom (British Overseas citizen)", "GBP": "United Kingdom (British Protected Person)", "GBS": "United Kingdom (British Subject)",
    "UNO": "United Nations Organization", "UNA": "United Nations Agency", "UNK": "UNMIK travel document holder", "XXA": "Stateless person",
    "XXB": "Refugee (1951 Convention)", "XXC": "Refugee (other)", "XXX": "Person of unspecified nationality",
    "XOM": "Sovereign Military Order of Malta", "XCC": "Caribbean Community", "RKS": "Kosovo",
}


def read_iso_countries(spark: SparkSession, path: str) -> DataFrame:
    """(alpha3, name) of an ISO 3166 list with a header line."""
    rows = spark.read.option("header", True).csv(path)
    first = F.coalesce(*(F.when(F.trim(c) != "", F.trim(c)) for c in ("official_name_en", "CLDR display name", "UNTERM English Short") if c in rows.columns))
    code = F.upper(F.trim("ISO3166-1-Alpha-3"))
    return rows.select(code.alias("alpha3"), F.coalesce(first, code).alias("name")).filter("length(alpha3) = 3")


def country_codes(spark: SparkSession, iso: DataFrame) -> DataFrame:
    """ISO codes and the extras; where both have a code the extra stays."""
    extra = spark.createDataFrame(list(ICAO_EXTRA.items()), "alpha3 string, name string").withColumn("rank", F.lit(0))
    both = extra.unionByName(iso.select("alpha3", "name").withColumn("rank", F.lit(1)))
    return both.withColumn("n", F.row_number().over(Window.partitionBy("alpha3").orderBy("rank", "name"))).filter("n = 1").select("alpha3", "name")
