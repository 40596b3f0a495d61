"""Byte and model kernels over tables: envelopes, image bytes, boxes; absent models give the documented open signal."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import ed25519, image

STATE = "state string, issuer_id string"


def envelope_states(envelopes: DataFrame, anchors: dict[str, dict], blob: str = "blob") -> DataFrame:
    """envelopes with state and issuer_id; the anchors are a few dozen keys."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([ed25519.envelope_state(b, anchors) for b in batch], columns=["state", "issuer_id"])

    return envelopes.withColumn("v", F.pandas_udf(run, STATE)(F.col(blob))).select(*envelopes.columns, "v.state", "v.issuer_id")


def signature_signal(state: Column) -> Column:
    """pass, fail or inconclusive of validation.signature.valid."""
    return F.when(state.isNull(), "inconclusive").when(state == "AUTHENTIC", "pass").otherwise("fail")


def proven_payloads(cases: DataFrame, envelopes: DataFrame, anchors: dict[str, dict], key: str, blob: str = "blob") -> DataFrame:
    """cases with state, issuer_id and payload of their envelope, each distinct envelope verified once.

    ``envelopes`` has key and blob.  The payload (JSON) is given only if its signature verifies; a
    case without an envelope has null for all three.  A key that envelopes repeat repeats its cases.
    """
    once = envelopes.select(blob).filter(F.col(blob).isNotNull()).distinct()
    checked = envelope_states(once, anchors, blob)
    own = envelopes.select(key, blob).join(checked, blob)
    proven = F.when(F.col("state") == "AUTHENTIC", F.get_json_object(blob, "$.payload"))
    return cases.join(own.select(key, "state", "issuer_id", proven.alias("payload")), key, "left")


def screen_verdicts(plane: Column, width: int) -> Column:
    """verdict and confidence of the print-screen check; planes are arrays, row by row."""
    import numpy as np

    def run(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([image.screen_verdict(np.asarray(v, float).reshape(-1, width)) for v in batch], columns=["verdict", "confidence"])

    return F.pandas_udf(run, "verdict string, confidence double")(plane)


def exif_verdicts(raw: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(image.exif_verdict), "string")(raw)


def jpeg_verdicts(raw: Column) -> Column:
    return F.pandas_udf(lambda s: pd.DataFrame([image.jpeg_verdict(x) for x in s], columns=["verdict", "quality"]), "verdict string, quality int")(raw)


def plane_measures(planes: DataFrame, key: str, values: str, width: int) -> DataFrame:
    """Sharpness, brightness and contrast of grey planes given as arrays, row by row."""
    import numpy as np

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            arrays = [np.asarray(v, float).reshape(-1, width) for v in batch]
            yield pd.DataFrame({"sharpness": [image.laplacian_variance(a) for a in arrays], "brightness": [a.mean() for a in arrays], "noise": [image.noise_outliers(a, 2) for a in arrays]})

    measured = F.pandas_udf(run, "sharpness double, brightness double, noise double")(F.col(values))
    return planes.select(key, measured.alias("m")).select(key, "m.*")


def suppressed(boxes: DataFrame, keys: list[str], overlap: float = 0.45) -> DataFrame:
    """Boxes kept by greedy suppression within each key (an image's boxes, some hundreds)."""
    fields = boxes.schema

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["confidence", "box_id"], ascending=[False, True])
        keep = image.suppress(group[["x1", "y1", "x2", "y2"]].to_numpy(float), group["confidence"].to_numpy(float), overlap)
        return group.iloc[keep]

    return boxes.groupBy(*keys).applyInPandas(run, fields)


_checks: dict[str, Callable[..., Column]] = {}


def register_check(template: str, make: Callable[..., Column]) -> None:
    """Add a check: an expression that gives array<signal> for a row. Its id must be new."""
    if template in _checks:
        raise ValueError(f"{template} is registered already")
    _checks[template] = make


def run_checks(cases: DataFrame) -> DataFrame:
    """All registered checks over cases, one row per signal, in order of registration."""
    parts = [cases.select("*", F.explode(make()).alias("signal"), F.lit(i).alias("check")) for i, make in enumerate(_checks.values())]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def model_or_open(available: bool, signal_id: str, verdict: Column, evidence: Column) -> Column:
    """A model's signal, or the open one where the model isn't deployed."""
    if available:
        return F.struct(F.lit(signal_id).alias("id"), verdict.alias("verdict"), evidence.alias("evidence"))
    return F.struct(F.lit(signal_id).alias("id"), F.lit("inconclusive").alias("verdict"), F.lit("The model for this check is not deployed").alias("evidence"))
