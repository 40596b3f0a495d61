"""Session set-up that the queries share."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

_LIMIT = "spark.sql.codegen.hugeMethodLimit"
ROOT = str(Path(__file__).resolve().parents[1])


def share_code(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it (on one machine, or a shared folder).

    A cluster without such a folder gets the package by ``--py-files``.  Also has
    plans with very large expressions (rule tables) cut into methods that the JVM
    compiles: it leaves methods above 8000 bytes to the interpreter.
    """
    if spark.conf.get(_LIMIT) == "65535":  # as it is by default
        spark.conf.set(_LIMIT, "8000")
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a run on one machine gets a temporary folder; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='attesta-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/attesta/{name}-{uuid.uuid4().hex}"
