"""Checks on captures, readings, signatures and faces as Column expressions.

Each gives a struct with at least a verdict; null inputs stand for what wasn't
found or read.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions import scalars as S

# Thresholds of the capture gate, the reader, faces, the burst and the second portrait.
SHARPNESS = {"scanner": 140.0, "upload": 140.0, "camera": 220.0}
SHORT_EDGE = 700
BRIGHTNESS = (55.0, 215.0)
GLARE = 0.04
READER_CONFIDENCE = 0.55
FACE_WIDTH = {"doc": 48.0, "live": 80.0}
FACE_SHARPNESS = {"doc": 30.0, "live": 80.0}
YAW = 0.35
BURST_FRAMES, OPEN_FRAMES, BURST_FACE = 4, 2, 320.0
GHOST_AGREEMENT = 0.90


def _by(key: Column, values: dict[str, float]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def signal(verdict: Column, confidence: Column) -> Column:
    return F.struct(verdict.alias("verdict"), confidence.cast("double").alias("confidence"))


def submit_gate(source: Column, sharpness: Column, width: Column, height: Column, brightness: Column, glare: Column) -> Column:
    """The client's gates, and whether the capture may be sent: exposure and glare only warn."""
    sharp = F.coalesce(sharpness >= _by(source, SHARPNESS), F.lit(False))
    large = F.coalesce(F.least(width, height) >= SHORT_EDGE, F.lit(False))
    exposed = F.coalesce(brightness.between(*BRIGHTNESS), F.lit(False))
    matt = F.coalesce(glare < GLARE, F.lit(False))
    return F.struct(sharp.alias("sharpness"), large.alias("resolution"), exposed.alias("brightness"), matt.alias("glare"), (sharp & large).alias("submittable"))


def document_type(declared: Column) -> Column:
    """A type chosen at the counter leaves nothing to classify; without one the check stays open."""
    chosen = declared.isNotNull()
    return signal(F.when(chosen, "not_applicable").otherwise("inconclusive"), F.when(chosen, 1.0).otherwise(0.0))


def normalised(field: Column, text: Column) -> Column:
    """What a reading of a field means, by the field's own rule; null if it isn't a valid value."""
    date = field.isin("dob", "issue_date", "expiry_date")
    named = field.isin("name", "father_name", "address")
    out = F.when(date, S.iso_date(text)).when(field == "gender", S.gender(text)).when(field == "id_number", S.id_number(text)).when(named, S.name(text)).otherwise(text)
    return F.nullif(out, F.lit(""))


def reading(field: Column, text: Column, confidence: Column) -> Column:
    """A reader's result: nothing, too faint or not a valid value stays open; fragments joined by blanks are tried joined as well."""
    value = F.coalesce(normalised(field, text), normalised(field, F.replace(text, F.lit(" "), F.lit(""))))
    empty = F.coalesce(text, F.lit("")) == ""
    good = ~empty & (confidence >= READER_CONFIDENCE) & value.isNotNull()
    return F.struct(
        F.when(good, "pass").otherwise("inconclusive").alias("verdict"),
        F.when(good, confidence.cast("double")).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(good, value).alias("value"),
    )


def face_found(available: Column, how: Column) -> Column:
    """How a face was found: directly, after noise reduction, or only within the printed region (null: not at all)."""
    return signal(
        F.when(~available, "inconclusive").when(how.isNull(), "fail").otherwise("pass"),
        F.when(~available, 0.0).when(how.isNull(), 0.85).when(how == "direct", 0.9).otherwise(0.7),
    )


def yaw(left: Column, right: Column, nose: Column) -> Column:
    """How far the nose stands from the middle of the eyes, in eye distances (structs x, y); 1 without a distance."""
    apart = F.sqrt((right["x"] - left["x"]) * (right["x"] - left["x"]) + (right["y"] - left["y"]) * (right["y"] - left["y"]))
    return F.when(apart <= 1e-6, 1.0).otherwise(F.abs(nose["x"] - (left["x"] + right["x"]) / 2) / F.when(apart > 1e-6, apart))


def face_quality(side: Column, width: Column, sharpness: Column, turned: Column) -> Column:
    """First failing measure of a face on side 'doc' or 'live': width, sharpness, yaw."""
    narrow, least = width < _by(side, FACE_WIDTH), _by(side, FACE_SHARPNESS)
    soft, away = sharpness < least, turned > YAW
    problem = F.when(narrow, "width").when(soft, "sharpness").when(away, "yaw")
    confidence = F.when(narrow, 0.9).when(soft, F.least(F.lit(0.95), 0.5 + (least - sharpness) / least)).when(away, 0.8).otherwise(0.85)
    return F.struct(F.when(problem.isNull(), "pass").otherwise("fail").alias("verdict"), confidence.cast("double").alias("confidence"), problem.alias("problem"))


def blink(states: Column, width: Column) -> Column:
    """Active liveness over a burst, an array of whether the eyes were open: a closed run between open frames passes; nothing ever fails."""
    n = F.size(states)
    shut = F.size(F.filter(states, lambda s: ~s))
    enough = states.isNotNull() & (n >= BURST_FRAMES) & (width >= BURST_FACE) & (n - shut >= OPEN_FRAMES)
    # The first frame that closes after an open one must have an open one behind it.
    text = F.array_join(F.transform(states, lambda s: F.when(s, "o").otherwise("c")), "")
    good = F.coalesce(enough & F.rlike(text, F.lit("oc+o")), F.lit(False))
    return signal(F.when(good, "pass").otherwise("inconclusive"), F.when(good, F.least(F.lit(1.0), shut / 2)).otherwise(0.0))


def ghost_portrait(located: Column, photo: Column, ghost: Column, agreement: Column) -> Column:
    """The second, faded portrait: open without boxes, a portrait or a measure (below 0); fails if it is missing or another face."""
    open_ = ~located | ~photo
    small, other = agreement < 0, agreement < GHOST_AGREEMENT
    return signal(
        F.when(open_, "inconclusive").when(~ghost, "fail").when(small, "inconclusive").when(other, "fail").otherwise("pass"),
        F.when(open_, 0.0).when(~ghost, 0.6).when(small, 0.0).when(other, F.least(F.lit(0.9), 0.4 + (GHOST_AGREEMENT - agreement))).otherwise(0.7),
    )


SIGNED = "array<struct<id:string,verdict:string,confidence:double,trust_class:string>>"


def signature(declared: Column, envelope: Column, anchors: Column, state: Column, issuer: Column) -> Column:
    """Signals of a signed payload, of type SIGNED: its signature, and its issuer where one is named."""

    def one(id_: str, verdict: Column | str, confidence: float, trust: str) -> Column:
        verdict = F.lit(verdict) if isinstance(verdict, str) else verdict
        return F.struct(F.lit(id_).alias("id"), verdict.alias("verdict"), F.lit(confidence).alias("confidence"), F.lit(trust).alias("trust_class"))

    valid = "validation.signature.valid"
    checked = F.array(one(valid, F.when(state == "AUTHENTIC", "pass").otherwise("fail"), 1.0, "cryptographic"))
    trusted = F.array(one("validation.signature.issuer_trusted", F.when(state == "UNKNOWN_ISSUER", "fail").otherwise("pass"), 1.0, "cryptographic"))
    named = F.when(issuer.isNotNull(), F.concat(checked, trusted)).otherwise(checked)
    unread = F.coalesce(envelope, F.lit("")) == ""
    return F.when(~declared, F.array(one(valid, "not_applicable", 1.0, "unverified"))).when(unread | (anchors == 0), F.array(one(valid, "inconclusive", 0.0, "unverified"))).otherwise(named)


def nationality(value: Column, known: Column, loaded: Column) -> Column:
    """A printed nationality against the table of codes; open without a table, null without a value."""
    return F.when(value.isNotNull(), signal(F.when(~loaded, "inconclusive").when(known, "pass").otherwise("fail"), F.when(loaded, 1.0).otherwise(0.0)))


def gender(value: Column) -> Column:
    return F.when(value.isNotNull(), signal(F.when(S.gender(value).isNotNull(), "pass").otherwise("fail"), F.lit(1.0)))


def fallback_state(status: Column) -> Column:
    """Why a fallback reading gave nothing; null where it gave something."""
    return F.when(status.isin("unavailable", "timed_out", "failed", "read_nothing"), signal(F.lit("inconclusive"), F.lit(0.0)))
