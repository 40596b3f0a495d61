"""From signals to findings, coverage, score and band, for all cases at once.

Rule tables are known when the plan is built and hold some dozen patterns, so a
longest-match lookup is a CASE over the patterns in falling order of length: no
join, and all of it inside whole-stage code generation.  Rules that are data
(thousands of patterns, or rules by tenant) go through resolve_patterns(), which
joins the distinct ids only.

Everything about a case is computed under one partitioning by case_id: signals
are shuffled once, then grouped by (case, anchor) and by case in place.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.plans import rules as R


def like_pattern(signal_id: Column, pattern: str) -> Column:
    """Whether ids match a pattern."""
    if pattern == "*":
        return F.lit(True)
    return F.startswith(signal_id, F.lit(pattern[:-1])) if pattern.endswith(".*") else signal_id == pattern


def longest_match(signal_id: Column, values: Mapping[str, float], default: float) -> Column:
    """The value of the longest pattern that matches; the default if none does."""
    found = None
    for pattern in sorted(values, key=len, reverse=True):
        hit, value = like_pattern(signal_id, pattern), F.lit(float(values[pattern]))
        found = F.when(hit, value) if found is None else found.when(hit, value)
    return F.lit(default) if found is None else found.otherwise(F.lit(default))


def by_doc_type(doc_type: Column, options: Mapping[str, Column], default: Column) -> Column:
    found = None
    for name, value in options.items():
        found = F.when(doc_type == name, value) if found is None else found.when(doc_type == name, value)
    return found.otherwise(default) if found is not None else default


def weight_of(rules: R.RuleSet = R.DEFAULT, doc_type: str = "doc_type", signal_id: str = "id") -> Column:
    options = {doc: longest_match(F.col(signal_id), own, 0.0) for doc, own in rules.weights.items()}
    return by_doc_type(F.col(doc_type), options, F.lit(0.0))


def reliability_of(rules: R.RuleSet = R.DEFAULT, signal_id: str = "id") -> Column:
    return longest_match(F.col(signal_id), rules.reliability, R.RELIABILITY_DEFAULT)


def any_match(signal_id: Column, patterns: Iterable[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | like_pattern(signal_id, p)
    return out


def is_hard(rules: R.RuleSet = R.DEFAULT, doc_type: str = "doc_type", signal_id: str = "id") -> Column:
    options = {doc: any_match(F.col(signal_id), own) for doc, own in rules.hard_fail.items()}
    return by_doc_type(F.col(doc_type), options, F.lit(False))


def trust_rank(column: str = "trust_class") -> Column:
    return F.array_position(F.array(*map(F.lit, R.TRUST_CLASSES)), F.col(column)).cast("int") - 1


def trust_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, R.TRUST_CLASSES)), rank + 1)


def resolve_patterns(ids: DataFrame, table: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Longest-prefix join for rules that are data: distinct (keys, id) of ``ids`` with the value of the longest pattern.

    Every prefix of an id that could be a pattern is spelled out (an id has few
    dots), which turns the prefix condition into equality.
    """
    keys = keys or []
    parts = F.split("id", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(F.array_join(F.slice(parts, F.lit(1), k), "."), F.lit(".*")))
    able = F.array_union(F.array(F.col("id"), F.lit("*")), prefixes)
    asked = ids.select(*keys, "id").distinct().withColumn("pattern", F.explode(able))
    return asked.join(table, [*keys, "pattern"]).groupBy(*keys, "id").agg(F.max_by(value, F.length("pattern")).alias(value))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (structs x1, y1, x2, y2); 0 where they only touch."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    size = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    union = size(a) + size(b) - w * h
    return F.when((w > 0) & (h > 0) & (union > 0), w * h / union).otherwise(F.lit(0.0))


def region_box(anchor: Column) -> Column:
    """The box of an anchor ``region:x1,y1,x2,y2``; null for any other anchor."""
    at = F.split(F.substring(anchor, 8, 200), ",")
    spot = [F.get(at, F.lit(i)).try_cast("double") for i in range(4)]
    box = F.struct(*(v.alias(n) for v, n in zip(spot, ("x1", "y1", "x2", "y2"), strict=True)))
    whole = F.startswith(anchor, F.lit("region:")) & (F.size(at) == 4) & spot[0].isNotNull() & spot[1].isNotNull() & spot[2].isNotNull() & spot[3].isNotNull()
    return F.when(whole, box)


def resolve_anchors(signals: DataFrame, boxes: DataFrame, least: float = 0.30) -> DataFrame:
    """Region anchors become the anchor of the field whose box they overlap most, if by more than ``least``.

    boxes: (case_id, ordinal, field, box). A case's boxes are gathered into one
    small array and joined once; signals without a region don't take part.
    """
    own = boxes.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "field", "box"))).alias("boxes"))
    marked = signals.withColumn("spot", region_box(F.col("anchor")))
    there = marked.filter("spot is not null").join(own, "case_id", "left")

    def better(best: Column, item: Column) -> Column:
        score = iou(F.col("spot"), item["box"])
        return F.when(score > best["score"], F.struct(item["field"].alias("field"), score.alias("score"))).otherwise(best)

    start = F.struct(F.lit(None).cast("string").alias("field"), F.lit(float(least)).alias("score"))
    found = F.aggregate(F.coalesce("boxes", F.array().cast("array<struct<ordinal:int,field:string,box:struct<x1:double,y1:double,x2:double,y2:double>>>")), start, better)
    moved = there.withColumn("anchor", F.coalesce(F.concat(F.lit("field:"), found["field"]), F.col("anchor"))).drop("boxes", "spot")
    return marked.filter("spot is null").drop("spot").unionByName(moved)


def clamp(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def rated(signals: DataFrame, rules: R.RuleSet = R.DEFAULT) -> DataFrame:
    """Signals with weight, reliability, trust rank and hard-fail flag."""
    return (
        signals.withColumn("weight", weight_of(rules))
        .withColumn("rel", reliability_of(rules))
        .withColumn("rank", trust_rank())
        .withColumn("hard", (F.col("verdict") == "fail") & (F.col("hard_fail") | is_hard(rules)))
    )


def prepared(signals: DataFrame, rules: R.RuleSet = R.DEFAULT) -> DataFrame:
    """Rated signals under the one partitioning that all later steps use."""
    return rated(signals, rules).repartition("case_id")


def findings(ready: DataFrame) -> DataFrame:
    """One finding per case and anchor: severity (noisy-or of failures), trust class, headline, supporters, weight."""
    fail = F.col("verdict") == "fail"
    order = F.struct((-F.col("rank")).alias("a"), (F.col("confidence") * F.col("rel")).alias("b"), (-F.col("seq")).alias("c"))
    lead = F.struct("evidence", "region")
    support = F.struct(
        (~fail).alias("k1"), F.col("rank").alias("k2"), (-F.col("confidence")).alias("k3"), "seq", "id", "verdict", "confidence", "trust_class"
    )
    return (
        ready.filter("verdict <> 'not_applicable'")
        .groupBy("case_id", "anchor")
        .agg(
            (1 - F.product(F.when(fail, 1 - clamp(F.col("confidence")) * F.col("rel")).otherwise(F.lit(1.0)))).alias("severity"),
            F.coalesce(F.min(F.when(fail, F.col("rank"))), F.min("rank")).alias("rank"),
            F.coalesce(F.max_by(F.when(fail, lead), F.when(fail, order)), F.max_by(lead, order)).alias("lead"),
            F.sum(F.when(fail, F.col("weight")).otherwise(F.lit(0.0))).alias("weight"),
            F.array_sort(F.collect_list(support)).alias("members"),
            F.min("seq").alias("first_seq"),
        )
        .select(
            "case_id",
            "anchor",
            "severity",
            "rank",
            trust_name(F.col("rank")).alias("trust_class"),
            F.col("lead.evidence").alias("headline"),
            F.col("lead.region").alias("region"),
            "weight",
            F.transform("members", lambda m: m["id"]).alias("supporting"),
            F.size("members").alias("n_members"),
            "first_seq",
        )
    )


def confirming() -> Column:
    """A pass that compares a field with a signature."""
    named = F.startswith("id", F.lit(R.CONFIRMING[0])) | F.startswith("id", F.lit(R.CONFIRMING[1]))
    return (F.col("verdict") == "pass") & F.startswith("anchor", F.lit("field:")) & named


def case_facts(ready: DataFrame) -> DataFrame:
    """Per case: coverage, weight that ran, hard fail with reason, and confirmed fields."""
    w, verdict = F.col("weight"), F.col("verdict")
    applicable, ran = verdict != "not_applicable", verdict.isin("pass", "fail")
    zero = F.lit(0.0)
    total = F.sum(F.when(applicable, w).otherwise(zero))
    done = F.sum(F.when(ran, w).otherwise(zero))
    return ready.groupBy("case_id").agg(
        F.first("doc_type").alias("doc_type"),
        F.when(total > 0, done / F.when(total > 0, total)).otherwise(zero).alias("coverage"),
        done.alias("ran"),
        F.bool_or("hard").alias("hard"),
        F.min_by(F.when(F.col("hard"), F.col("evidence")), F.when(F.col("hard"), F.col("seq"))).alias("hard_reason"),
        F.collect_set(F.when(confirming(), F.col("anchor"))).alias("confirmed"),
    )


def settled(value: Column) -> Column:
    """A sum without the noise of its order, for comparing with thresholds."""
    return F.round(value, 9)


def band_of(score: Column, bands: R.Bands) -> Column:
    score = settled(score)
    return F.when(score < bands.green, "GREEN").when(score < bands.amber, "AMBER").otherwise("RED")


def weighted_score(items: Column, ran: Column) -> Column:
    total = F.aggregate(items, F.lit(0.0), lambda acc, f: acc + f["severity"] * f["weight"])
    return F.when(ran > 0, clamp(total / F.when(ran > 0, ran))).otherwise(F.lit(0.0))


def verdict_columns(rules: R.RuleSet) -> dict[str, Column]:
    """band, score, coverage, reason over the joined case facts and findings."""
    all_items = F.coalesce("findings", F.array().cast("array<struct<anchor:string,severity:double,trust_class:string,weight:double>>"))
    suppressed = lambda f: (f["trust_class"] == "probabilistic") & F.array_contains("confirmed", f["anchor"])
    kept = F.when(F.col("crypto_clean"), F.filter(all_items, lambda f: ~suppressed(f))).otherwise(all_items)
    low = settled(F.col("coverage")) < rules.bands.floor
    plain, final = weighted_score(all_items, F.col("ran")), weighted_score(kept, F.col("ran"))
    score = F.when(F.col("hard"), F.lit(1.0)).when(low, plain).otherwise(final)
    return {
        "band": F.when(F.col("hard"), F.lit("RED")).when(low, F.lit("AMBER")).otherwise(band_of(final, rules.bands)),
        "score": score,
        "coverage": F.col("coverage"),
        "reason": F.when(F.col("hard"), F.col("hard_reason")).when(low, F.lit(R.LOW_COVERAGE)),
        "n_findings": F.size(F.when(F.col("hard") | low, all_items).otherwise(kept)),
    }


def joined(signals: DataFrame, rules: R.RuleSet = R.DEFAULT) -> DataFrame:
    """Per case what a verdict needs: facts and findings from one scan and one shuffle, without a join.

    The facts of a case are sums, minima and disjunctions over its anchors, so they
    ride along while signals are grouped by anchor.
    """
    fail, applicable, zero = F.col("verdict") == "fail", F.col("verdict") != "not_applicable", F.lit(0.0)
    w = F.col("weight")
    slim = rated(signals, rules).select(
        "case_id",
        "anchor",
        "doc_type",
        F.when(fail, 1 - clamp(F.col("confidence")) * F.col("rel")).otherwise(F.lit(1.0)).alias("left"),
        F.when(fail, F.col("rank")).alias("fail_rank"),
        F.when(applicable, F.col("rank")).alias("rank"),
        F.when(fail, w).otherwise(zero).alias("weight"),
        F.when(applicable, w).otherwise(zero).alias("total"),
        F.when(F.col("verdict").isin("pass", "fail"), w).otherwise(zero).alias("ran"),
        F.when(F.col("hard"), F.struct("seq", "evidence")).alias("hard_at"),  # the only text that is shuffled
        confirming().alias("confirmed"),
    )
    per_anchor = slim.repartition("case_id").groupBy("case_id", "doc_type", "anchor").agg(
        (1 - F.product("left")).alias("severity"),
        F.coalesce(F.min("fail_rank"), F.min("rank")).alias("rank"),
        F.sum("weight").alias("weight"),
        F.count("rank").alias("n"),
        F.sum("total").alias("total"),
        F.sum("ran").alias("ran"),
        F.min("hard_at").alias("hard_at"),
        F.bool_or("confirmed").alias("confirmed"),
    )
    crypto = (F.col("rank") == 0) & (F.col("n") > 0)
    found = F.struct("anchor", "severity", trust_name(F.col("rank")).alias("trust_class"), "weight")
    total, ran = F.sum("total"), F.sum("ran")
    return per_anchor.groupBy("case_id").agg(
        F.first("doc_type").alias("doc_type"),
        F.when(total > 0, ran / F.when(total > 0, total)).otherwise(zero).alias("coverage"),
        ran.alias("ran"),
        F.min("hard_at").isNotNull().alias("hard"),
        F.min("hard_at")["evidence"].alias("hard_reason"),
        F.collect_set(F.when(F.col("confirmed"), F.col("anchor"))).alias("confirmed"),
        F.collect_list(F.when(F.col("n") > 0, found)).alias("findings"),
        (F.coalesce(F.bool_or(crypto), F.lit(False)) & (F.coalesce(F.max(F.when(crypto, F.col("severity"))), F.lit(1.0)) <= 0)).alias("crypto_clean"),
    )


def verdicts(signals: DataFrame, rules: R.RuleSet = R.DEFAULT) -> DataFrame:
    """Per case: doc_type, band, score, coverage, reason, n_findings."""
    out = verdict_columns(rules)
    return joined(signals, rules).select("case_id", "doc_type", *(c.alias(n) for n, c in out.items()))


def rescored(signals: DataFrame, rules: R.RuleSet, before: R.RuleSet = R.DEFAULT) -> DataFrame:
    """Verdicts of stored signals under other rules, beside those under the rules before.

    As a re-score has no boxes, region anchors stay as they are; a hard fail carries no findings.
    """
    new = verdicts(signals, rules).withColumn("n_findings", F.when(F.col("band").eqNullSafe("RED") & (F.col("score") == 1.0) & F.col("reason").isNotNull(), 0).otherwise(F.col("n_findings")))
    old = verdicts(signals, before).select("case_id", F.col("band").alias("old_band"), F.round(F.col("score") + 1e-9, 3).alias("old_score"))
    return new.join(old, "case_id").select(
        "case_id", "doc_type", "band", F.round(F.col("score") + 1e-9, 3).alias("score"), F.round(F.col("coverage") + 1e-9, 3).alias("coverage"),
        "reason", "n_findings", "old_band", "old_score", (F.col("band") != F.col("old_band")).alias("changed"),
    )


def operating_points(signals: DataFrame, points: list[R.Bands], rules: R.RuleSet = R.DEFAULT) -> DataFrame:
    """How many cases fall into each band under each operating point, in one pass over the signals."""
    base = joined(signals, rules)
    scored = base.select(*(F.struct(*(c.alias(n) for n, c in verdict_columns(R.RuleSet(rules.weights, rules.hard_fail, rules.reliability, p)).items() if n in ("band",))).alias(f"p{i}") for i, p in enumerate(points)))
    counts = scored.agg(*(F.count_if(F.col(f"p{i}.band") == b).alias(f"p{i}_{b}") for i in range(len(points)) for b in ("GREEN", "AMBER", "RED")))
    cells = ", ".join(f"{p.green}D, {p.amber}D, p{i}_GREEN, p{i}_AMBER, p{i}_RED" for i, p in enumerate(points))
    return counts.selectExpr(f"stack({len(points)}, {cells}) as (green_below, amber_below, n_green, n_amber, n_red)")


def tamper_score(ready: DataFrame) -> DataFrame:
    hit = (F.col("verdict") == "fail") & F.startswith("id", F.lit("tamper."))
    return ready.groupBy("case_id").agg(F.coalesce(F.max(F.when(hit, F.col("confidence"))), F.lit(0.0)).alias("tamper_score"))


def gate(signals: DataFrame, rules: R.RuleSet = R.DEFAULT, clear_below: float = R.TAMPER_CLEAR_BELOW) -> DataFrame:
    """Per case: decision (hard_fail, escalate or clear) and reason."""
    ready = prepared(signals, rules)
    fail = F.col("verdict") == "fail"
    first = lambda hit: F.min_by(F.when(hit, F.col("evidence")), F.when(hit, F.col("seq")))
    unsure = lambda name: F.coalesce(F.bool_or((F.col("id") == name) & F.col("verdict").isin("pass", "fail") & (F.col("confidence") < 1.0)), F.lit(False))
    escalate = fail & any_match(F.col("id"), R.ESCALATE_ON_FAIL)
    tamper = F.coalesce(F.max(F.when(fail & F.startswith("id", F.lit("tamper.")), F.col("confidence"))), F.lit(0.0))
    facts = ready.groupBy("case_id").agg(
        F.bool_or("hard").alias("hard"),
        first(F.col("hard")).alias("hard_reason"),
        F.bool_or(escalate).alias("up"),
        first(escalate).alias("up_reason"),
        unsure("face.match.cosine").alias("face"),
        unsure("face.liveness.passive").alias("live"),
        tamper.alias("tamper"),
    )
    reasons = [
        (F.col("hard"), "hard_fail", F.col("hard_reason")),
        (F.col("up"), "escalate", F.col("up_reason")),
        (F.col("face"), "escalate", F.lit("Face match falls in the review band")),
        (F.col("live"), "escalate", F.lit("Passive liveness score is uncertain")),
        (F.col("tamper") > clear_below, "escalate", F.format_string("Tamper indication %.2f above the clear threshold", F.col("tamper"))),
    ]
    decision = reason = None
    for hit, name, why in reasons:
        decision = F.when(hit, name) if decision is None else decision.when(hit, name)
        reason = F.when(hit, why) if reason is None else reason.when(hit, why)
    return facts.select("case_id", decision.otherwise("clear").alias("decision"), reason.otherwise("Deterministic checks clear, no escalation triggered").alias("reason"))


def cards(signals: DataFrame, rules: R.RuleSet = R.DEFAULT) -> DataFrame:
    """Per case the evidence cards: hard fails, ordered findings, gaps, cryptographic passes, and the count of collapsed passes."""
    ready = prepared(signals, rules)
    verdict, own = F.col("verdict"), F.struct("seq", "id")
    gather = lambda hit: F.transform(F.array_sort(F.collect_list(F.when(hit, own))), lambda s: s["id"])
    per_case = ready.groupBy("case_id").agg(
        gather(F.col("hard")).alias("hard_fails"),
        gather(verdict == "inconclusive").alias("coverage_gaps"),
        gather((verdict == "pass") & (F.col("trust_class") == "cryptographic")).alias("cryptographic_passes"),
        F.count_if((verdict == "pass") & F.col("trust_class").isin("probabilistic", "unverified")).alias("passing_collapsed"),
    )
    ranked = F.struct("rank", (-F.col("severity")).alias("down"), "first_seq", "anchor", "supporting")
    found = findings(ready).filter("severity > 0").groupBy("case_id").agg(F.array_sort(F.collect_list(ranked)).alias("ranked"))
    single = lambda f: (F.size(f["supporting"]) == 1) & F.array_contains("hard_fails", f["supporting"][0])
    empty = F.array().cast("array<string>")
    return per_case.join(found, "case_id", "left").withColumn(
        "finding_anchors", F.coalesce(F.transform(F.filter("ranked", lambda f: ~single(f)), lambda f: f["anchor"]), empty)
    ).drop("ranked")


def client_rows(signals: DataFrame, rules: R.RuleSet = R.DEFAULT) -> DataFrame:
    """Evidence rows as a client orders them: flagged hard fails, each with its anchor's finding folded in, then the other findings.

    Unlike cards() this goes by the signals' own flags and keeps findings without
    severity. Every applicable signal lies in some finding, so nothing is left for rows of gaps or passes.
    """
    ready = prepared(signals, rules)
    flagged = ready.filter((F.col("verdict") == "fail") & F.col("hard_fail"))
    hard = flagged.groupBy("case_id").agg(F.collect_set("id").alias("hard_ids"), F.collect_set("anchor").alias("hard_anchors"))
    rows = findings(ready).join(hard, "case_id", "left")
    folded = (F.col("severity") > 0) & F.coalesce(F.array_contains("hard_anchors", F.col("anchor")), F.lit(False))
    told = F.coalesce(F.size(F.array_except("supporting", "hard_ids")) == 0, F.lit(False))
    shown = rows.filter(~folded & ~told).select("case_id", F.lit("finding").alias("kind"), "anchor", F.lit("").alias("id"), "rank", (-F.col("severity")).alias("down"), "first_seq")
    first = flagged.select("case_id", F.lit("hard_fail").alias("kind"), "anchor", "id", F.lit(-1).alias("rank"), F.lit(0.0).alias("down"), F.col("seq").alias("first_seq"))
    return first.unionByName(shown)
