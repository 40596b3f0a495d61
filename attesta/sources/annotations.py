"""Box annotations and profiles from files: label lines, COCO JSON, class lists, layout references, stored signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_labels(lines: DataFrame, text: str = "value") -> DataFrame:
    """Label lines ``class cx cy w h`` as typed columns beside the others; shorter lines are left out."""
    parts = F.split(F.trim(text), r"\s+")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    typed = lines.filter(F.size(parts) >= 5).select(*[c for c in lines.columns if c != text], F.get(parts, F.lit(0)).try_cast("int").alias("class_index"), *(number(i).alias(n) for i, n in enumerate(("cx", "cy", "w", "h"), 1)))
    return typed.filter("class_index is not null")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return parse_labels(spark.read.text(path).select("value", F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("stem")))


def corners(width: float, height: float) -> Column:
    """The pixel box of normalised centre and size, cut at the image's edges."""
    c = F.col
    clamp = lambda v, top: F.greatest(F.lit(0.0), F.least(F.lit(float(top)), v))
    return F.struct(
        clamp((c("cx") - c("w") / 2) * width, width).alias("x1"), clamp((c("cy") - c("h") / 2) * height, height).alias("y1"),
        clamp((c("cx") + c("w") / 2) * width, width).alias("x2"), clamp((c("cy") + c("h") / 2) * height, height).alias("y2"),
    )


def class_names(text: Column) -> Column:
    """The names of a class list line ``names: ['a', 'b']``."""
    inner = F.regexp_extract(text, r"names:\s*\[([^\]]*)\]", 1)
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(F.regexp_replace(x, "['\"]", ""))), lambda x: x != "")


COCO = (
    "images array<struct<id:long,file_name:string,width:double,height:double>>, categories array<struct<id:long,name:string>>, "
    "annotations array<struct<image_id:long,category_id:long,bbox:array<double>>>"
)


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    """Annotations with their image and category, boxes as normalised centre and size."""
    whole = spark.read.schema(COCO).option("multiLine", True).json(path)
    images = whole.select(F.explode("images").alias("i")).select("i.*").withColumnRenamed("id", "image_id")
    names = whole.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), F.col("c.name").alias("category"))
    rows = whole.select(F.explode("annotations").alias("a")).select("a.*")
    b = lambda i: F.get("bbox", F.lit(i))
    return rows.join(images, "image_id").join(names, "category_id").select(
        "image_id", "file_name", "category", ((b(0) + b(2) / 2) / F.col("width")).alias("cx"), ((b(1) + b(3) / 2) / F.col("height")).alias("cy"),
        (b(2) / F.col("width")).alias("w"), (b(3) / F.col("height")).alias("h"),
    )


LAYOUT = "map<string,struct<cx:double,cy:double,mad_x:double,mad_y:double,n:long,boxes:long>>"


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """A layout reference file: one row for each class; none if the file can't be read as one."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", f"doc_type string, classes {LAYOUT}").alias("j"))
    return rows.select("j.doc_type", F.explode("j.classes").alias("class", "ref")).select("doc_type", "class", "ref.*")


SIGNAL = (
    "struct<id:string,module:string,tier:int,verdict:string,confidence:double,trust_class:string,hard_fail:boolean,anchor:string,evidence:string,"
    "region:array<double>,latency_ms:int>"
)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Stored cases (one JSON document each, with meta and signals) as ordered signals."""
    whole = spark.read.schema(f"meta struct<scene:string,doc_type:string>, signals array<{SIGNAL}>").option("multiLine", True).json(path)
    rows = whole.select(F.col("meta.scene").alias("case_id"), F.col("meta.doc_type").alias("doc_type"), F.posexplode("signals").alias("seq", "s"))
    r = F.col("s.region")
    box = F.when(F.size(r) == 4, F.struct(*(F.get(r, F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2")))))
    return rows.select("case_id", "doc_type", F.col("seq").cast("long").alias("seq"), *(f"s.{c}" for c in ("id", "verdict", "confidence", "trust_class", "hard_fail", "anchor", "evidence", "latency_ms")), box.alias("region"))
