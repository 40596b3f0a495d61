"""Fusion rules, joins and streams on small tables."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from attesta.operators import documents as D
from attesta.operators import fusion as X
from attesta.operators import joins as J
from attesta.operators import stats as Z
from attesta.plans import catalogue
from attesta.plans import rules as R
from attesta.streaming import sessions as T

SIGNALS = "case_id long, seq long, doc_type string, id string, verdict string, confidence double, trust_class string, hard_fail boolean, anchor string, evidence string, region struct<x1:double,y1:double,x2:double,y2:double>"


def signals(spark, rows, doc_type="passport"):
    full = [(1, k, doc_type, i, v, c, t, False, a, f"{i} {v}", None) for k, (i, v, c, t, a) in enumerate(rows)]
    return spark.createDataFrame(full, SIGNALS)


def verdict(spark, rows, rules=R.DEFAULT, doc_type="passport"):
    return X.verdicts(signals(spark, rows, doc_type), rules).first()


PASSING = [
    ("validation.signature.valid", "pass", 1.0, "cryptographic", "document"), ("validation.mrz.checkdigit.dob", "pass", 1.0, "arithmetic", "field:dob"),
    ("validation.vizmrz.name_mismatch", "pass", 1.0, "arithmetic", "field:name"), ("face.match.cosine", "pass", 1.0, "probabilistic", "field:person_photo"),
]


def test_clean_case_is_green(spark):
    v = verdict(spark, PASSING)
    assert (v["band"], v["score"], v["coverage"], v["reason"]) == ("GREEN", 0.0, 1.0, None)


def test_inconclusive_costs_coverage_and_not_applicable_does_not(spark):
    half = [(i, "inconclusive" if n < 2 else v, c, t, a) for n, (i, v, c, t, a) in enumerate(PASSING)]
    v = verdict(spark, half)
    assert v["band"] == "AMBER" and v["reason"] == R.LOW_COVERAGE and v["coverage"] == pytest.approx(0.40 / 0.90)
    none = [(i, "not_applicable" if n < 2 else v, c, t, a) for n, (i, v, c, t, a) in enumerate(PASSING)]
    assert verdict(spark, none)["coverage"] == 1.0


def test_hard_fail_wins_and_the_first_gives_the_reason(spark):
    rows = [*PASSING, ("validation.expiry.expired", "fail", 1.0, "arithmetic", "field:expiry_date"), ("validation.watchlist.hit", "fail", 1.0, "arithmetic", "document")]
    v = verdict(spark, rows)
    assert (v["band"], v["score"], v["reason"]) == ("RED", 1.0, "validation.expiry.expired fail")


def test_noisy_or_and_clamp(spark):
    rows = [("tamper.digital.ela", "fail", 0.6, "probabilistic", "document"), ("tamper.digital.copy_move", "fail", 7.0, "probabilistic", "document"), ("face.doc.quality", "pass", 1.0, "probabilistic", "document")]
    f = X.findings(X.prepared(signals(spark, rows))).first()
    assert f["severity"] == pytest.approx(1 - (1 - 0.6 * 0.3) * (1 - 0.7)) and f["headline"] == "tamper.digital.copy_move fail"


def test_finding_class_is_that_of_its_failures(spark):
    rows = [("validation.signed.dob_mismatch", "pass", 1.0, "cryptographic", "field:dob"), ("tamper.digital.ela", "fail", 0.9, "probabilistic", "field:dob")]
    assert X.findings(X.prepared(signals(spark, rows))).first()["trust_class"] == "probabilistic"


def test_confirmed_fields_silence_heuristics_only_under_clean_signatures(spark):
    noise = ("tamper.digital.ela", "fail", 1.0, "probabilistic", "field:dob")
    own = [*PASSING, ("validation.signed.dob_mismatch", "pass", 1.0, "cryptographic", "field:dob2"), ("validation.crossdoc.dob_mismatch", "pass", 1.0, "cryptographic", "field:dob"), noise]
    # The heuristic shares its anchor with the confirmation, and a failing finding there keeps its own class.
    assert verdict(spark, own)["score"] == 0.0
    unclean = [*own, ("validation.signature.issuer_trusted", "fail", 1.0, "cryptographic", "document")]
    assert verdict(spark, unclean)["score"] > 0


def test_longest_pattern(spark):
    ids = spark.createDataFrame([("passport", "face.match.cosine"), ("passport", "face.match.other"), ("passport", "other")], "doc_type string, id string")
    got = {r["id"]: r["w"] for r in ids.select("id", X.weight_of().alias("w")).collect()}
    assert got == {"face.match.cosine": 0.15, "face.match.other": 0.10, "other": 0.0}
    joined = {r["id"]: r["weight"] for r in X.resolve_patterns(ids, R.weight_table(spark), "weight", ["doc_type"]).collect()}
    assert joined == {"face.match.cosine": 0.15, "face.match.other": 0.10}


def test_region_anchor(spark):
    rows = [("tamper.digital.ela", "fail", 0.5, "probabilistic", a) for a in ("region:605,472,945,523", "region:10,10,20,20", "region:x", "document")]
    boxes = spark.createDataFrame([(1, 0, "dob", (600.0, 470.0, 950.0, 525.0)), (1, 1, "name", (600.0, 360.0, 1250.0, 415.0))], "case_id long, ordinal int, field string, box struct<x1:double,y1:double,x2:double,y2:double>")
    got = [r["anchor"] for r in X.resolve_anchors(signals(spark, rows), boxes).orderBy("seq").collect()]
    assert got == ["field:dob", "region:10,10,20,20", "region:x", "document"]


def test_bands_and_weights_are_checked():
    with pytest.raises(ValueError, match="bands"):
        R.Bands(0.6, 0.2)
    with pytest.raises(ValueError, match="outside"):
        R.DEFAULT.override({"face.*": 1.5})


@pytest.mark.parametrize(
    ("rows", "decision"),
    [
        ([("validation.watchlist.hit", "fail", 1.0, "arithmetic", "document")], "hard_fail"),
        ([("validation.vizmrz.name_mismatch", "fail", 1.0, "arithmetic", "field:name")], "escalate"),
        ([("face.match.cosine", "pass", 0.9, "probabilistic", "field:person_photo")], "escalate"),
        ([("tamper.digital.ela", "fail", 0.16, "probabilistic", "document")], "escalate"),
        ([("tamper.digital.ela", "fail", 0.15, "probabilistic", "document")], "clear"),
    ],
)
def test_gate(spark, rows, decision):
    assert X.gate(signals(spark, rows)).first()["decision"] == decision


def test_iou(spark):
    box = lambda *v: F.struct(*(F.lit(float(x)).alias(n) for x, n in zip(v, ("x1", "y1", "x2", "y2"), strict=True)))
    pairs = [((0, 0, 10, 10), (0, 0, 10, 10), 1.0), ((0, 0, 10, 10), (20, 20, 30, 30), 0.0), ((0, 0, 10, 10), (5, 0, 15, 10), 1 / 3), ((0, 0, 10, 10), (10, 0, 20, 10), 0.0)]
    for a, b, want in pairs:
        assert spark.range(1).select(X.iou(box(*a), box(*b))).first()[0] == pytest.approx(want)


def test_watchlist_chain(spark):
    listed = spark.createDataFrame([(1, "OFAC", "WANTED PERSON", "1980-01-01", "X9999999"), (2, "UN", "Pradeep Gharat", None, None), (3, "UN", "WANTED PERSON", "1970-01-01", "Y1")], "id long, source string, name string, dob string, doc_number string")
    asked = [(1, "x9999-999", "A", None), (2, None, "person wanted", "1980-01-01"), (3, None, "person wanted", "1990-01-01"), (4, None, "Prodeep Ghorat", None), (5, "Q1", "Nobody Here", None), (6, None, None, None), (7, "", "", None)]
    got = {r["doc_id"]: (r["verdict"], r["confidence"], r["listed_id"]) for r in J.watchlist(spark.createDataFrame(asked, "doc_id long, number string, name string, dob string"), listed).collect()}
    assert got == {1: ("fail", 1.0, 1), 2: ("fail", 1.0, 1), 3: ("inconclusive", 0.5, 1), 4: ("inconclusive", 0.56, 2), 5: ("pass", 1.0, None), 6: ("inconclusive", 0.0, None), 7: ("inconclusive", 0.0, None)}


def test_transit(spark):
    at = lambda h: dt.datetime(2026, 1, 1, h)
    rows = [(1, 7, at(1), "raxaul"), (2, 7, at(2), "raxaul"), (3, 7, at(3), "panitanki"), (4, 7, at(23), "raxaul"), (5, 7, at(23), "nowhere"), (6, 8, at(1), "raxaul")]
    got = {r["event_id"]: (r["there_id"], r["verdict"]) for r in J.transit(spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, post_id string"), R.post_table(spark)).collect()}
    assert got == {3: ("raxaul", "fail"), 4: ("panitanki", "pass"), 5: ("raxaul", "inconclusive")}


def test_nearest_rank(spark):
    rows = spark.createDataFrame([("a", v) for v in (5, 1, 3, 2, 4, 9)], "k string, v int")
    r = Z.nearest_rank(rows, ["k"], "v", {"p50": 0.5, "p95": 0.95}).first()
    assert (r["p50"], r["p95"], r["max"], r["n"]) == (3, 9, 9, 6)  # round(2.5) is 2


def test_stream_edges_across_batches(spark, tmp_path):
    """State carries a session's last verified document from one batch to the next."""
    at = lambda m: dt.datetime(2026, 1, 1, 0, m)
    schema = "session_id long, case_id long, created_at timestamp, verified boolean"
    source, out, check = (f"{tmp_path}/{n}" for n in ("in", "out", "check"))
    for k, rows in enumerate([[(1, 10, at(1), True), (1, 11, at(2), False)], [(1, 12, at(3), True), (1, 13, at(4), False), (2, 20, at(1), False)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        T.run_once(T.session_edges(spark.readStream.schema(schema).parquet(source), 3_600_000), f"{out}{k}", check)
    first, second = ({(r["case_id"], r["prior_id"]) for r in spark.read.parquet(f"{out}{k}").collect()} for k in (0, 1))
    assert first == {(11, 10)} and second == {(12, 10), (13, 12)}


def test_expiry_is_strict(spark):
    now = F.lit("2026-01-01 00:15:00").cast("timestamp")
    items = spark.createDataFrame([(1, dt.datetime(2026, 1, 1, 0, 0)), (2, dt.datetime(2025, 12, 31, 23, 59, 59))], "id int, created_at timestamp")
    assert {r["id"]: r["alive"] for r in T.alive(items, now, 900).collect()} == {1: True, 2: False}


def test_registered_checks(spark):
    one = lambda v: F.array(F.struct(F.lit("custom.check").alias("id"), v.alias("verdict")))
    D.register_check("custom.check", lambda: one(F.when(F.col("x") > 1, "pass").otherwise("fail")))
    with pytest.raises(ValueError, match="already"):
        D.register_check("custom.check", lambda: one(F.lit("pass")))
    got = D.run_checks(spark.createDataFrame([(1,), (2,)], "x int")).select("x", "signal.verdict").collect()
    assert {tuple(r) for r in got} == {(1, "fail"), (2, "pass")}


def test_score_quantiles(spark):
    """Exact quantiles from counts: ties, a zero vector, no probes."""
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(60)] + [(60, 1, [0.0] * 4)]
    vectors = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    probes = vectors.filter("vec_id % 20 = 0")
    shares = {"low": 0.05, "mid": 0.5, "high": 0.95, "last": 1.0}
    scored = J.pair_scores(probes, vectors).withColumn("score", F.round("score", 9))
    want = scored.groupBy("genuine").agg(*(F.percentile("score", F.lit(q)).alias(n) for n, q in shares.items())).collect()
    got = {r["genuine"]: list(r)[1:] for r in J.score_quantiles(probes, vectors, shares).collect()}
    assert got == {r["genuine"]: pytest.approx(list(r)[1:], abs=2e-9) for r in want} and len(got) == 2
    assert J.score_quantiles(probes.limit(0), vectors, shares).count() == 0
    assert J.score_counts(probes, vectors).groupBy("genuine").agg(F.sum("n").alias("n")).orderBy("n").collect() == scored.groupBy("genuine").agg(F.count("*").alias("n")).orderBy("n").collect()


def test_equal_planes_are_measured_once(spark, tmp_path):
    from attesta.plans import catalogue

    spark.range(1, 201).withColumnRenamed("id", "p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    out = catalogue.QUERIES["P45_print_screen"](spark, str(tmp_path))
    assert out.count() == 200 and out.select("id").distinct().count() == 200
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Aggregate [")


@pytest.mark.parametrize(("nearest", "least"), [(True, 0.3), (False, 0.1)])
def test_best_partners(spark, monkeypatch, nearest, least):
    """Copies, boxes that only touch, empty and open ones, odd keys; a tile over several tasks; no pair of boxes is a row."""
    monkeypatch.setattr(J, "TILE_PLACES", 16)
    rng = np.random.default_rng(7)
    rows = []
    for i in range(300):
        x, y = (float(v) for v in rng.integers(-4, 12, 2) * 10)
        w, h = (float(v) for v in rng.integers(0, 5, 2) * 15 + rng.integers(0, 2) * 0.1)
        rows.append((int(rng.integers(0, 2)) if i % 40 else None, i, "ab"[i % 2], int(rng.integers(0, 4)), x, y, x + w if i % 50 else None, y + h if i % 70 else y - 5))
    boxes = spark.createDataFrame(rows + [(0, 1000, "a", 9, -500.0, -500.0, 900.0, 900.0)], "image_id int, box_id long, class string, ordinal int, x1 double, y1 double, x2 double, y2 double")
    rows = [tuple(r) for r in boxes.collect()]

    def iou(p, q):
        w, h = min(p[6], q[6]) - max(p[4], q[4]), min(p[7], q[7]) - max(p[5], q[5])
        return w * h / ((p[6] - p[4]) * (p[7] - p[5]) + (q[6] - q[4]) * (q[7] - q[5]) - w * h) if w > 0 and h > 0 else 0.0

    want = {}
    for p in rows:
        met = [(-round(iou(p, q), 9) if nearest else 0, q[3], q[1], q[2]) for q in rows if p[1] != q[1] and p[0] == q[0] and None not in (p[0], p[6], q[6]) and iou(p, q) > least]
        if met:
            want[p[1]] = min(met)[2:]
    found = J.best_partners(boxes, ["image_id"], least, nearest)
    got = found.collect()
    assert {r["box_id"]: (r["other_id"], r["other_class"]) for r in got} == want and len(got) == len(want) > 100


def quantiles_of_all_pairs(rows, shares):
    """genuine: quantiles of the scores of all ordered pairs with different ids, by a plain loop."""
    found = {}
    for i, a, v in rows:
        for j, b, w in rows:
            if i is not None and j is not None and i != j:
                x, y = np.array(v, float), np.array(w, float)
                genuine = None if a is None or b is None else a == b
                found.setdefault(genuine, []).append(round(float(x @ y / np.sqrt(x @ x) / np.sqrt(y @ y)), 9))
    return {g: [float(np.quantile(s, q)) for q in shares] for g, s in found.items()}


def test_score_quantiles_of_all_pairs(spark, monkeypatch):
    """The stored frame as probes: several blocks and rounds, an id twice, missing ids and labels, equal vectors."""
    monkeypatch.setattr(J, "BLOCK_PROBES", 16)
    monkeypatch.setattr(J, "SENT_BLOCKS", 2)
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 3)), rng.normal(size=4).tolist()) for i in range(90)]
    rows += [(7, 1, [1.0, 2.0, 0.0, 1.0]), (None, 1, [1.0, 0.0, 0.0, 0.0]), (90, None, [0.0, 1.0, 0.0, 2.0]), *((100 + i, 2, [1.0, 1.0, 0.0, 0.0]) for i in range(20))]
    vectors = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    shares = {"first": 0.0, "low": 0.05, "mid": 0.5, "high": 0.95, "last": 1.0}
    got = {r["genuine"]: list(r)[1:] for r in J.score_quantiles(vectors, vectors, shares).collect()}
    want = quantiles_of_all_pairs(rows, shares.values())
    assert set(want) == {False, True, None}
    assert got == {g: pytest.approx(x, abs=2e-9) for g, x in want.items()}
    twice = spark.createDataFrame(rows, vectors.schema)
    assert sorted(map(tuple, J.score_counts(vectors, vectors).collect()), key=str) == sorted(map(tuple, J.score_counts(vectors, twice).collect()), key=str)


def test_a22_takes_every_vector_as_probe(spark, tmp_path):
    """No id is divisible by 20: the query set of a twentieth would be empty."""
    rng = np.random.default_rng(6)
    rows = [(i, i % 3, rng.normal(size=8).astype(np.float32).tolist()) for i in range(1, 80) if i % 20]
    table = pa.table({"vec_id": [r[0] for r in rows], "label": pa.array([r[1] for r in rows], pa.int32()), "embedding": pa.array([r[2] for r in rows], pa.list_(pa.float32()))})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    got = {r["genuine"]: [r["p05"], r["median"], r["p95"]] for r in catalogue.QUERIES["A22_score_quantiles"](spark, str(tmp_path)).collect()}
    assert got == {g: pytest.approx(x, abs=2e-6) for g, x in quantiles_of_all_pairs(rows, (0.05, 0.5, 0.95)).items()} and len(got) == 2
