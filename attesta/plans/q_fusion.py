"""Fusion, gate, cards and re-scoring over the derived signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.operators import fusion as X

from . import rules as R
from .registry import query
from .views import Tables

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


def signals(t: Tables) -> DataFrame:
    return t.signals.withColumn("region", F.lit(None).cast(BOX))


def rounded(c: str, digits: int = 6) -> F.Column:
    return F.round(F.col(c) + 1e-9, digits).alias(c)


def _case(values: dict[str, float], default: float, column: str = "id") -> str:
    """SQL for the longest pattern that matches."""
    out = []
    for p in sorted(values, key=len, reverse=True):
        test = f"starts_with({column}, '{p[:-1]}')" if p.endswith(".*") else f"{column} = '{p}'"
        out.append(f"WHEN {test} THEN CAST({values[p]} AS DOUBLE)")
    return "CASE " + " ".join(out) + f" ELSE CAST({default} AS DOUBLE) END"


def _weight_sql(rules: R.RuleSet) -> str:
    return "CASE doc_type " + " ".join(f"WHEN '{d}' THEN {_case(w, 0.0)}" for d, w in rules.weights.items()) + " END"


def _any(patterns: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with(id, '{p[:-1]}')" if p.endswith(".*") else f"id = '{p}'" for p in patterns) + ")"


def _hard_sql(rules: R.RuleSet) -> str:
    return "CASE doc_type " + " ".join(f"WHEN '{d}' THEN {_any(p)}" for d, p in rules.hard_fail.items()) + " END"


def ready_sql(rules: R.RuleSet = R.DEFAULT, name: str = "ready") -> str:
    rank = "CASE trust_class " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(R.TRUST_CLASSES)) + " END"
    return f"""{name} AS (SELECT *, {_weight_sql(rules)} AS weight, {_case(rules.reliability, R.RELIABILITY_DEFAULT)} AS rel, {rank} AS rank,
  verdict = 'fail' AND (hard_fail OR {_hard_sql(rules)}) AS hard FROM signals)"""


def found_sql(ready: str = "ready", name: str = "found") -> str:
    return f"""{name} AS (SELECT case_id, anchor,
  1 - product(CASE WHEN verdict = 'fail' THEN 1 - greatest(0.0, least(1.0, confidence)) * rel ELSE 1.0 END) AS severity,
  coalesce(min(rank) FILTER (verdict = 'fail'), min(rank)) AS rank,
  sum(CASE WHEN verdict = 'fail' THEN weight ELSE 0 END) AS weight, count(*) AS n_members,
  coalesce(arg_min(evidence, struct_pack(a := rank, b := -confidence * rel, c := seq)) FILTER (verdict = 'fail'),
           arg_min(evidence, struct_pack(a := rank, b := -confidence * rel, c := seq))) AS headline
  FROM {ready} WHERE verdict <> 'not_applicable' GROUP BY case_id, anchor)"""


def verdict_sql(rules: R.RuleSet = R.DEFAULT, tag: str = "") -> str:
    """CTEs that end in a table ``verdicts`` (plus tag)."""
    b = rules.bands
    conf = "verdict = 'pass' AND starts_with(anchor, 'field:') AND (" + " OR ".join(f"starts_with(id, '{p}')" for p in R.CONFIRMING) + ")"
    return f"""{ready_sql(rules, "ready" + tag)}, {found_sql("ready" + tag, "found" + tag)},
facts{tag} AS (SELECT case_id, any_value(doc_type) AS doc_type, sum(CASE WHEN verdict <> 'not_applicable' THEN weight ELSE 0 END) AS total,
  sum(CASE WHEN verdict IN ('pass', 'fail') THEN weight ELSE 0 END) AS ran, bool_or(hard) AS hard, arg_min(evidence, seq) FILTER (hard) AS hard_reason FROM ready{tag} GROUP BY case_id),
confirmed{tag} AS (SELECT DISTINCT case_id, anchor FROM ready{tag} WHERE {conf}),
clean{tag} AS (SELECT case_id, coalesce(bool_or(rank = 0), false) AND coalesce(max(severity) FILTER (rank = 0), 1) <= 0 AS clean FROM found{tag} GROUP BY case_id),
parts{tag} AS (SELECT f.case_id, sum(f.severity * f.weight) AS plain, count(*) AS n_all,
  sum(CASE WHEN c.clean AND f.rank = 2 AND k.anchor IS NOT NULL THEN 0 ELSE f.severity * f.weight END) AS kept,
  count(*) FILTER (NOT (c.clean AND f.rank = 2 AND k.anchor IS NOT NULL)) AS n_kept
  FROM found{tag} f JOIN clean{tag} c USING (case_id) LEFT JOIN confirmed{tag} k ON k.case_id = f.case_id AND k.anchor = f.anchor GROUP BY f.case_id),
scored{tag} AS (SELECT a.*, CASE WHEN total > 0 THEN ran / total ELSE 0 END AS coverage, coalesce(n_all, 0) AS n_all, coalesce(n_kept, 0) AS n_kept,
  CASE WHEN ran > 0 THEN least(1, greatest(0, coalesce(plain, 0) / ran)) ELSE 0 END AS s_plain, CASE WHEN ran > 0 THEN least(1, greatest(0, coalesce(kept, 0) / ran)) ELSE 0 END AS s_kept
  FROM facts{tag} a LEFT JOIN parts{tag} USING (case_id)),
verdicts{tag} AS (SELECT case_id, doc_type, CASE WHEN hard THEN 'RED' WHEN round(coverage, 9) < {b.floor} THEN 'AMBER' WHEN round(s_kept, 9) < {b.green} THEN 'GREEN' WHEN round(s_kept, 9) < {b.amber} THEN 'AMBER' ELSE 'RED' END AS band,
  CAST(CASE WHEN hard THEN 1 WHEN round(coverage, 9) < {b.floor} THEN s_plain ELSE s_kept END AS DOUBLE) AS score, CAST(coverage AS DOUBLE) AS coverage,
  CASE WHEN hard THEN hard_reason WHEN round(coverage, 9) < {b.floor} THEN '{R.LOW_COVERAGE}' END AS reason, CAST(CASE WHEN hard OR round(coverage, 9) < {b.floor} THEN n_all ELSE n_kept END AS INTEGER) AS n_findings, hard FROM scored{tag})"""


_VERDICT_COLUMNS = "case_id, doc_type, band, round(score + 1e-9, 6) AS score, round(coverage + 1e-9, 6) AS coverage, reason, n_findings"


@query("Q1_rescore", f"WITH {verdict_sql()} SELECT {_VERDICT_COLUMNS} FROM verdicts")
def q1(t: Tables) -> DataFrame:
    """Every stored case re-scored: A1-A13 with J1-J3."""
    return X.verdicts(signals(t)).select("case_id", "doc_type", "band", rounded("score"), rounded("coverage"), "reason", "n_findings")


OTHER = R.DEFAULT.override({"tamper.*": 0.3, "face.liveness.*": 0.2}, R.Bands(0.15, 0.5, 0.6))


@query(
    "Q2_rescore_changed",
    f"""WITH {verdict_sql(OTHER, "_n")}, {verdict_sql(R.DEFAULT, "_o")}
SELECT n.case_id, n.doc_type, n.band, round(n.score + 1e-9, 3) AS score, round(n.coverage + 1e-9, 3) AS coverage, n.reason,
 CASE WHEN n.hard THEN 0 ELSE n.n_findings END AS n_findings, o.band AS old_band, round(o.score + 1e-9, 3) AS old_score, n.band <> o.band AS changed
FROM verdicts_n n JOIN verdicts_o o USING (case_id)""",
)
def q2(t: Tables) -> DataFrame:
    """Batch re-score under other weights and bands (Q2-Q5)."""
    return X.rescored(signals(t), OTHER)


POINTS = [R.Bands(0.1, 0.5), R.Bands(0.2, 0.6), R.Bands(0.3, 0.7), R.Bands(0.05, 0.4)]


@query(
    "Q5_operating_points",
    " UNION ALL ".join(
        f"SELECT CAST({p.green} AS DOUBLE) AS green_below, CAST({p.amber} AS DOUBLE) AS amber_below, count(*) FILTER (band = 'GREEN') AS n_green, count(*) FILTER (band = 'AMBER') AS n_amber, count(*) FILTER (band = 'RED') AS n_red FROM ({'WITH ' + verdict_sql(R.DEFAULT.override(bands=p), f'_{i}')} SELECT band FROM verdicts_{i})"
        for i, p in enumerate(POINTS)
    ).replace("FROM signals)", "FROM signals )"),
)
def q5(t: Tables) -> DataFrame:
    """Bands of all cases under several operating points in one pass."""
    return X.operating_points(signals(t), POINTS)


@query("Q6_confirmed_fields", f"SELECT DISTINCT case_id, anchor FROM signals WHERE verdict = 'pass' AND starts_with(anchor, 'field:') AND ({' OR '.join(f'''starts_with(id, '{p}')''' for p in R.CONFIRMING)})")
def q6(t: Tables) -> DataFrame:
    """Fields that a signature or another signed document confirms (A10, Q6)."""
    facts = X.case_facts(X.prepared(signals(t)))
    return facts.select("case_id", F.explode("confirmed").alias("anchor"))


@query(
    "A1_findings",
    f"WITH {ready_sql()}, {found_sql()} SELECT case_id, anchor, round(severity + 1e-9, 6) AS severity, CASE rank WHEN 0 THEN 'cryptographic' WHEN 1 THEN 'arithmetic' WHEN 2 THEN 'probabilistic' ELSE 'unverified' END AS trust_class, headline, round(weight + 1e-9, 6) AS weight, CAST(n_members AS INTEGER) AS n_members FROM found",
)
def a1(t: Tables) -> DataFrame:
    """Findings: noisy-or severity, dominant member, trust class."""
    return X.findings(X.prepared(signals(t))).select("case_id", "anchor", rounded("severity"), "trust_class", "headline", rounded("weight"), "n_members")


@query(
    "A5_supporting_order",
    f"WITH {ready_sql()} SELECT case_id, anchor, string_agg(id, ',' ORDER BY verdict <> 'fail', rank, -confidence, seq) AS supporting FROM ready WHERE verdict <> 'not_applicable' GROUP BY ALL",
)
def a5(t: Tables) -> DataFrame:
    return X.findings(X.prepared(signals(t))).select("case_id", "anchor", F.array_join("supporting", ",").alias("supporting"))


@query(
    "A6_coverage",
    f"WITH {ready_sql()} SELECT case_id, round(coalesce(sum(weight) FILTER (verdict IN ('pass','fail')), 0) / nullif(sum(weight) FILTER (verdict <> 'not_applicable'), 0) + 1e-9, 6) AS coverage FROM ready GROUP BY case_id HAVING coalesce(sum(weight) FILTER (verdict <> 'not_applicable'), 0) > 0",
)
def a6(t: Tables) -> DataFrame:
    """Coverage of cases with any applicable weight."""
    ready = X.prepared(signals(t))
    weighty = ready.groupBy("case_id").agg(F.sum(F.when(F.col("verdict") != "not_applicable", F.col("weight")).otherwise(0.0)).alias("w")).filter("w > 0")
    return X.case_facts(ready).join(weighty, "case_id").select("case_id", rounded("coverage"))


@query(
    "A9_hard_failures",
    f"WITH {ready_sql()} SELECT case_id, count(*) AS n, arg_min(evidence, seq) AS reason FROM ready WHERE hard GROUP BY case_id",
)
def a9(t: Tables) -> DataFrame:
    """First hard failure and their number."""
    hard = X.prepared(signals(t)).filter("hard")
    return hard.groupBy("case_id").agg(F.count("*").alias("n"), F.min_by("evidence", "seq").alias("reason"))


@query("A12_band_counts", f"WITH {verdict_sql()} SELECT doc_type, band, count(*) AS n FROM verdicts GROUP BY ALL")
def a12(t: Tables) -> DataFrame:
    return X.verdicts(signals(t)).groupBy("doc_type", "band").agg(F.count("*").alias("n"))


@query("A14_tamper_score", "SELECT case_id, coalesce(max(confidence) FILTER (verdict = 'fail' AND starts_with(id, 'tamper.')), 0.0) AS tamper_score FROM signals GROUP BY case_id")
def a14(t: Tables) -> DataFrame:
    return X.tamper_score(signals(t))


@query(
    "A15_gate",
    f"""WITH {ready_sql()}, g AS (SELECT case_id, bool_or(hard) AS hard, arg_min(evidence, seq) FILTER (hard) AS hr,
 bool_or(verdict = 'fail' AND {_any(R.ESCALATE_ON_FAIL)}) AS up, arg_min(evidence, seq) FILTER (verdict = 'fail' AND {_any(R.ESCALATE_ON_FAIL)}) AS ur,
 bool_or(id = 'face.match.cosine' AND verdict IN ('pass','fail') AND confidence < 1) AS face, bool_or(id = 'face.liveness.passive' AND verdict IN ('pass','fail') AND confidence < 1) AS live,
 coalesce(max(confidence) FILTER (verdict = 'fail' AND starts_with(id, 'tamper.')), 0) AS tamper FROM ready GROUP BY case_id)
SELECT case_id, CASE WHEN hard THEN 'hard_fail' WHEN up OR face OR live OR tamper > {R.TAMPER_CLEAR_BELOW} THEN 'escalate' ELSE 'clear' END AS decision,
 CASE WHEN hard THEN hr WHEN up THEN ur WHEN face THEN 'Face match falls in the review band' WHEN live THEN 'Passive liveness score is uncertain'
 WHEN tamper > {R.TAMPER_CLEAR_BELOW} THEN printf('Tamper indication %.2f above the clear threshold', tamper) ELSE 'Deterministic checks clear, no escalation triggered' END AS reason FROM g""",
)
def a15(t: Tables) -> DataFrame:
    """Risk gate with its reason."""
    return X.gate(signals(t))


@query(
    "A16_cards",
    f"""WITH {ready_sql()}, {found_sql()}, c AS (SELECT case_id, coalesce(string_agg(id, ',' ORDER BY seq) FILTER (hard), '') AS hard_fails, coalesce(string_agg(id, ',' ORDER BY seq) FILTER (verdict = 'inconclusive'), '') AS coverage_gaps,
 coalesce(string_agg(id, ',' ORDER BY seq) FILTER (verdict = 'pass' AND trust_class = 'cryptographic'), '') AS cryptographic_passes, count(*) FILTER (verdict = 'pass' AND trust_class IN ('probabilistic', 'unverified')) AS passing_collapsed FROM ready GROUP BY case_id),
only1 AS (SELECT r.case_id, r.anchor, bool_or(r.id IN (SELECT h.id FROM ready h WHERE h.case_id = r.case_id AND h.hard)) AS shown FROM ready r WHERE r.verdict <> 'not_applicable' GROUP BY r.case_id, r.anchor HAVING count(*) = 1),
firsts AS (SELECT case_id, anchor, min(seq) AS s FROM ready WHERE verdict <> 'not_applicable' GROUP BY ALL),
f AS (SELECT found.case_id, string_agg(found.anchor, ',' ORDER BY found.rank, -found.severity, firsts.s) AS finding_anchors FROM found JOIN firsts USING (case_id, anchor) LEFT JOIN only1 o ON o.case_id = found.case_id AND o.anchor = found.anchor
 WHERE severity > 0 AND NOT coalesce(o.shown, false) GROUP BY found.case_id)
SELECT c.*, coalesce(f.finding_anchors, '') AS finding_anchors FROM c LEFT JOIN f USING (case_id)""",
)
def a16(t: Tables) -> DataFrame:
    """Evidence cards of every case."""
    out = X.cards(signals(t))
    lists = ["hard_fails", "coverage_gaps", "cryptographic_passes", "finding_anchors"]
    return out.select("case_id", *(F.array_join(c, ",").alias(c) for c in lists), "passing_collapsed")


@query(
    "J1_resolve_patterns",
    f"SELECT DISTINCT doc_type, id, {_weight_sql(R.DEFAULT)} AS weight FROM signals WHERE {_weight_sql(R.DEFAULT)} > 0",
)
def j1(t: Tables) -> DataFrame:
    """Longest-pattern join with rules as data."""
    return X.resolve_patterns(t.signals, R.weight_table(t.spark), "weight", ["doc_type"])


@query("J2_hard_fail_semi", f"SELECT id, doc_type, count(*) AS n FROM signals WHERE {_hard_sql(R.DEFAULT)} GROUP BY ALL")
def j2(t: Tables) -> DataFrame:
    return t.signals.filter(X.is_hard()).groupBy("id", "doc_type").agg(F.count("*").alias("n"))


@query("J3_reliability", f"SELECT id, {_case(R.RELIABILITY, R.RELIABILITY_DEFAULT)} AS reliability, count(*) AS n FROM signals GROUP BY ALL")
def j3(t: Tables) -> DataFrame:
    return t.signals.groupBy("id", X.reliability_of().alias("reliability")).agg(F.count("*").alias("n"))


@query(
    "T3_findings_order",
    f"WITH {ready_sql()}, {found_sql()}, o AS (SELECT case_id, anchor, row_number() OVER (PARTITION BY case_id ORDER BY round(severity, 9) DESC, rank, anchor) AS place FROM found) SELECT case_id, anchor, place FROM o",
)
def t3(t: Tables) -> DataFrame:
    """Findings worst first, more certain classes first among equals."""
    from pyspark.sql import Window

    order = Window.partitionBy("case_id").orderBy(F.round("severity", 9).desc(), "rank", "anchor")
    return X.findings(X.prepared(signals(t))).select("case_id", "anchor", F.row_number().over(order).cast("long").alias("place"))


@query("F24_signal_json", "SELECT case_id, seq, id, verdict, confidence FROM signals")
def f24(t: Tables) -> DataFrame:
    """Signals through their JSON wire form and back."""
    fields = ["id", "verdict", "confidence", "trust_class", "hard_fail", "anchor", "evidence", "latency_ms"]
    wire = t.signals.select("case_id", "seq", F.to_json(F.struct(*fields)).alias("json"))
    form = "id string, verdict string, confidence double, trust_class string, hard_fail boolean, anchor string, evidence string, latency_ms int"
    return wire.select("case_id", "seq", F.from_json("json", form).alias("s")).select("case_id", "seq", "s.id", "s.verdict", "s.confidence")


@query("A27_module_latency", "SELECT case_id, split_part(id, '.', 1) AS module, max(latency_ms) AS latency_ms, count(*) AS n FROM signals GROUP BY ALL")
def a27(t: Tables) -> DataFrame:
    return t.signals.groupBy("case_id", F.split_part("id", F.lit("."), F.lit(1)).alias("module")).agg(F.max("latency_ms").alias("latency_ms"), F.count("*").alias("n"))
