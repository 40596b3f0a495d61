"""Published vectors and edge cases of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from attesta.functions import bpe, ed25519, image
from attesta.functions import checks as C
from attesta.functions import mrz as M
from attesta.functions import scalars as S

SPECIMEN = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<\nL898902C36UTO7408122F1204159ZE184226B<<<<<10"


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


def today():
    return F.lit("2026-09-06").cast("date")


def verified(spark, strip):
    m = M.parse(F.col("s"), today())
    return {r["field"]: r["ok"] for r in one(spark, F.transform(m["check_digits"], lambda d: F.struct(d["field"].alias("field"), M.verify(d["value"], d["digit"]).alias("ok"))), s=strip)}


def test_specimen_zone(spark):
    m = one(spark, M.parse(F.col("s"), today()), s=SPECIMEN)
    assert (m["format"], m["surname"], m["given_names"], m["birth_date"], m["expiry_date"]) == ("TD3", "ERIKSSON", "ANNA MARIA", "1974-08-12", "2012-04-15")
    assert all(verified(spark, SPECIMEN).values())


@pytest.mark.parametrize(("place", "field"), [(9, "document_number"), (19, "dob"), (27, "expiry"), (42, "optional"), (43, "composite")])
def test_changed_digit(spark, place, field):
    first, second = SPECIMEN.split("\n")
    second = second[:place] + str((int(second[place]) + 1) % 10) + second[place + 1 :]
    found = verified(spark, f"{first}\n{second}")
    assert not found[field] and not found["composite"]


@pytest.mark.parametrize(("strip", "reason"), [("", "lines"), ("A\nB\nC", "lines"), ("P<UTO\nL89", "length"), (SPECIMEN.replace("ANNA", "AN*A"), "charset")])
def test_unreadable_zone(spark, strip, reason):
    m = one(spark, M.parse(F.col("s"), today()), s=strip)
    assert m["format"] is None and m["reason"] == reason


def test_visa_zones(spark):
    a = one(spark, M.parse(F.col("s"), today()), s=("V<UTO" + "ERIKSSON<<ANNA").ljust(44, "<") + "\n" + "L8988901C4XXX4009078F9612109".ljust(44, "<"))
    b = one(spark, M.parse(F.col("s"), today()), s=("V<UTO" + "ERIKSSON<<ANNA").ljust(36, "<") + "\n" + "L8988901C4XXX4009078F9612109".ljust(36, "<"))
    assert (a["format"], b["format"], len(a["check_digits"]), len(b["check_digits"])) == ("MRVA", "MRVB", 3, 3)
    assert a["birth_date"] == "1940-09-07" and a["expiry_date"] == "2096-12-10"


def test_verhoeff(spark):
    digit = one(spark, C.verhoeff_digit(F.col("a")), a="23456789012")
    good = f"23456789012{digit}"
    assert one(spark, C.check_aadhaar(F.col("a"))[0], a=f"{good[:4]} {good[4:8]} {good[8:]}")
    for k in range(12):
        bad = good[:k] + str((int(good[k]) + 1) % 10) + good[k + 1 :]
        assert not one(spark, C.check_aadhaar(F.col("a"))[0], a=bad)
    assert not one(spark, C.check_aadhaar(F.col("a"))[0], a=None)


@pytest.mark.parametrize(
    ("number", "surname", "ok"),
    [("ABLPG7040F", "GHARAT", True), ("ABLPG7040F", "KHAN", False), ("ABLPG7040F", None, True), ("ABLXG7040F", None, False), ("ABL7G7040F", None, False)],
)
def test_pan(spark, number, surname, ok):
    assert one(spark, C.check_pan(F.col("n"), F.col("s"))[0], n=number, s=surname) is ok


@pytest.mark.parametrize(("number", "ok"), [("MH12 20110012345", True), ("MH-12-2011-0012345", True), ("XX1220110012345", False), ("MH0020110012345", False), ("MH1218990012345", False), ("MH12", False)])
def test_licence(spark, number, ok):
    assert one(spark, C.check_dl(F.col("n"), 2026)[0], n=number) is ok


@pytest.mark.parametrize(
    ("text", "iso"),
    [("04/08/1991", "1991-08-04"), ("04-08-1991", "1991-08-04"), ("04.08.1991", "1991-08-04"), ("1991/08/04", "1991-08-04"), ("04 aug 1991", "1991-08-04"), ("30/02/1991", None), ("4/8/1991", None), ("", None), (None, None), ("04 XXX 1991", None)],
)
def test_dates(spark, text, iso):
    assert one(spark, S.iso_date(F.col("t")), t=text) == iso


@pytest.mark.parametrize(("text", "name"), [("Müller-O'Neil  José", "MULLER O NEIL JOSE"), ("ERIKSSON<<ANNA", "ERIKSSON ANNA"), (None, ""), ("  ", "")])
def test_names(spark, text, name):
    assert one(spark, S.name(F.col("t")), t=text) == name


def test_phonetic_key_ignores_order(spark):
    key = S.phonetic_key(S.watchlist_key(F.col("t")))
    assert one(spark, key, t="Prodeep Ghorat") == one(spark, key, t="GHARAT PRADEEP") == "G630 P631"


def test_identity_hash(spark):
    h = S.hash_id_number(F.col("t"), "salt")
    assert one(spark, h, t="12-34 56") == one(spark, h, t="123456") and one(spark, h["last4"], t="12-34 56") == "3456"
    assert one(spark, h, t="--") is None and one(spark, h, t=None) is None


def test_canonical_form_keeps_empty_fields(spark):
    text = one(spark, S.canonical(F.lit("iss"), [F.col("a"), F.col("b"), F.lit("x  y ")]), a=None, b="")
    assert text.split("\x1f")[1:] == ["iss", "", "", "x y"]


@pytest.mark.parametrize(("hours", "ago", "span"), [(0.5, "30 minutes ago", "30 minutes"), (2.5, "2 hours ago", "2.5 hours"), (47.9, "48 hours ago", "47.9 hours"), (72.0, "3 days ago", "3.0 days")])
def test_spans(spark, hours, ago, span):
    assert one(spark, S.ago(F.lit(hours))) == ago and one(spark, S.span(F.lit(hours))) == span


def test_labels(spark):
    assert [one(spark, S.describe_start(F.lit(d))) for d in ("aadhaar", "pan", "dl", "ration_card")] == ["An Aadhaar card", "A PAN card", "A driving licence", "A ration card"]
    assert one(spark, S.field_label(F.lit("photo_page"))) == "photo page"


def test_ed25519_published_vector():
    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    assert ed25519.public_key(seed).hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    signature = ed25519.sign(seed, b"")
    assert signature.hex().startswith("e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e06522490155")
    assert ed25519.verify(ed25519.public_key(seed), b"", signature)
    assert not ed25519.verify(ed25519.public_key(seed), b"x", signature)
    assert not ed25519.verify(ed25519.public_key(seed), b"", signature[:-1])


def test_envelope_states():
    from attesta.plans.q_etl import ANCHORS, envelopes

    states = [ed25519.envelope_state(b, ANCHORS)[0] for _, b in envelopes(6)]
    assert states == ["AUTHENTIC", "UNKNOWN_ISSUER", "INVALID_SIGNATURE", "TAMPERED", "TAMPERED", "MALFORMED_PAYLOAD"]
    old = {"ref": {**ANCHORS["ref"], "valid_until": "2020-01-01"}}
    blob = envelopes(1)[0][1]
    assert ed25519.envelope_state(blob, old, "2026-01-01")[0] == "REVOKED" and ed25519.envelope_state(blob, old)[0] == "AUTHENTIC"
    assert ed25519.envelope_state(None, ANCHORS)[0] == "MALFORMED_PAYLOAD"


def test_jpeg_tables():
    from attesta.plans.q_etl import jpeg

    assert image.zigzag()[:6] == [0, 1, 8, 16, 9, 2]
    for quality in (10, 50, 75, 95):
        assert image.jpeg_verdict(jpeg(image.standard_table(quality).tolist(), None)) == ("pass", quality)
    assert image.jpeg_verdict(b"PNG")[0] == "not_applicable"
    assert image.software(jpeg(None, b"GIMP 2.10")) == "GIMP 2.10"


def test_planes():
    import numpy as np

    rng = np.random.default_rng(0)
    flat, noisy = np.full((64, 64), 7.0), rng.normal(size=(64, 64))
    assert image.laplacian_variance(flat) == 0 < image.laplacian_variance(noisy)
    assert image.correlation(noisy, noisy) == pytest.approx(1) and image.correlation(flat, noisy) == 0
    wave = lambda k: 50 * np.sin(np.arange(384) * 2 * np.pi * k / 128)[None, :].repeat(384, 0)
    assert image.screen_disagreement(wave(24)) == (0.0, 9) and image.screen_verdict(wave(24)) == ("pass", 0.6)
    mixed = wave(24)
    mixed[:, 256:] = wave(48)[:, 256:]
    assert image.screen_disagreement(mixed) == (pytest.approx(1 / 3), 9) and image.screen_verdict(mixed)[0] == "fail"
    assert image.screen_verdict(np.zeros((384, 384))) == image.screen_verdict(wave(24)[:128]) == ("inconclusive", 0.0)
    boxes = np.array([[0, 0, 10, 10], [1, 1, 10, 10], [20, 20, 30, 30]], float)
    assert image.suppress(boxes, np.array([0.5, 0.9, 0.4])) == [1, 2]
    points = rng.normal(size=(5, 2))
    turn = np.array([[0, -2], [2, 0]])
    m = image.similarity_transform(points, points @ turn.T + [3, 4])
    assert np.allclose(m, [[0, -2, 3], [2, 0, 4]])
    keys = rng.integers(0, 1000, (40, 2))
    marks = rng.integers(0, 256, (40, 32), dtype=np.uint8)
    x, y, n = image.copied_shift(np.concatenate([keys, keys + [80, 40]]), np.concatenate([marks, marks]))
    assert (abs(x), abs(y)) == (80, 40) and n == 80


MERGES = [(b" ", b"t"), (b"h", b"e"), (b" t", b"he"), (b"i", b"n"), (b"a", b"b"), (b"ab", b"ab")]


@pytest.mark.parametrize("text", ["", "the hen in the inn", "ababab abab", "it's 12  \n x\t", "\u00e9\u0939\U0001f600 naive", " " * 7 + "the"])
def test_pair_encoding(text):
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    spell = lambda t: "".join(bpe.alphabet()[b] for b in t)
    coder = bpe.Coder(MERGES)
    model = Tokenizer(models.BPE({spell(t): i for t, i in coder.ids.items()}, [(spell(a), spell(b)) for a, b in MERGES]))
    cut = pre_tokenizers.Split(Regex(bpe.PIECES.pattern), "isolated")
    model.pre_tokenizer = pre_tokenizers.Sequence([cut, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    model.decoder = decoders.ByteLevel()
    assert coder.encode(text) == model.encode(text).ids
    assert coder.decode(coder.encode(text)) == text == model.decode(coder.encode(text))


def test_pair_encoding_edges():
    coder = bpe.Coder(MERGES)
    assert coder.encode(" the") == [256 + 2] and coder.decode([10**6, 0xE9]) == "\ufffd"
    assert bpe.from_file_form("\u0120t\u010a") == b" t\n" and len(set(bpe.alphabet().values())) == 256
