"""Weak-label evidence: reliabilities times findings, combined by the fuzzy algebra, up to labels and reports.

Input rows carry the 0/1 rule columns, has_<label> of entities and p_<relation> of relations.  Reliabilities are mappings of
at most forty names, given as Python dicts or read by reliabilities().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.fuzzy import active, cap, f_and, f_not, f_or
from ..functions.text import once, squeeze

ACCUMULATED = ["critical_risk_score", "omission_accumulation_score", "testimonial_accumulation_score", "transparency_persuasion_accumulation_score", "soft_accumulation_risk", "weak_labeling_score"]


def reliabilities(metrics: DataFrame, labels: list[str], name: str = "label", value: str = "f1_mean") -> dict[str, float]:
    """Capped reliability of each label, 0 where there is none.  metrics has one row a label."""
    rows = metrics.filter(F.col(name).isin(labels)).select(name, cap(F.col(value)).alias("v")).collect()
    found = {r[name]: r["v"] for r in rows}
    return {x: found.get(x, 0.0) for x in labels}


def base_evidence(rows: DataFrame, ner: dict, relation: dict, rule: dict) -> DataFrame:
    """E_<label> of the 16 entity labels and the four relation evidences."""
    w = lambda table, k: F.lit(min(1.0, max(0.0, float(table.get(k, 0.0)))))
    hit = lambda r: w(rule, r) * F.col(r)
    lexical = {r for r, *_ in fixed.RULES}
    out: dict[str, Column] = {}
    for x in fixed.NER_LABELS:
        own = w(ner, x) * (F.coalesce(F.col(f"has_{x}").try_cast("double"), F.lit(0.0)) >= 0.5).cast("int")
        out[f"E_{x}"] = cap(F.greatest(own, hit(f"LEX_{x}")) if f"LEX_{x}" in lexical else own)
    for name, x, r in (("OUTCOME_GUARANTEED_EVIDENCE", fixed.RE_LABELS[0], "RULE_OUTCOME_GUARANTEED"), ("REQUIREMENT_WAIVED_EVIDENCE", fixed.RE_LABELS[1], "RULE_REQUIREMENT_WAIVED"), ("TESTIMONIAL_SUCCESS_EVIDENCE", fixed.RE_LABELS[2], "RULE_TESTIMONIAL_SUCCESS"), ("HAS_VERIFIABLE_ORG_LINK", fixed.RE_LABELS[3], "RULE_ORG_LINK")):
        out[name] = cap(F.greatest(w(relation, x) * cap(F.col(f"p_{x}")), hit(r)))
    return once(rows, out)


def intermediate_evidence(rows: DataFrame, ner: dict, rule: dict) -> DataFrame:
    c = F.col
    hit = lambda r: F.lit(min(1.0, max(0.0, float(rule.get(r, 0.0))))) * c(r)
    own = F.lit(min(1.0, max(0.0, float(ner.get("PRESSURE_CUE", 0.0))))) * (F.coalesce(c("has_PRESSURE_CUE").try_cast("double"), F.lit(0.0)) >= 0.5).cast("int")
    return once(
        rows,
        {
            "CLAIM_SCOPE": f_or(c("E_PROGRAM_OR_INTAKE"), c("E_OUTCOME"), c("E_COST_CLAIM"), c("E_GENERIC_INSTITUTION"), c("E_REQUIREMENT")),
            "GENERIC_ONLY_INSTITUTION": f_and(c("E_GENERIC_INSTITUTION"), f_not(c("HAS_VERIFIABLE_ORG_LINK"))),
            "BROAD_FREE_CLAIM": f_or(c("E_COST_CLAIM"), hit("LEX_STUDY_FREE"), hit("LEX_NO_TUITION")),
            "MATERIAL_CAVEAT": f_or(c("E_COST_DETAIL"), *[hit(f"RULE_{x}") for x in ("SEMESTER_FEE", "LIVING_COST", "BLOCKED_ACCOUNT", "PROOF_OF_FUNDS", "PUBLIC_PRIVATE_QUALIFIER")]),
            "PRESSURE_INTENSITY": f_or(*[hit(f"RULE_PRESSURE_{x}") * F.lit(k) for x, k in fixed.PRESSURE.items()], own),
            "IMPLICATIVE_PROMISE": f_or(c("E_VAGUE_BENEFIT"), *[hit(f"RULE_{x}") for x in ("FUTURE_PROMISE", "DREAM_JOB", "GLOBAL_CAREER", "LIFE_CHANGING", "BRIGHT_FUTURE")]),
        },
    )


def deception_types(rows: DataFrame, rule: dict) -> DataFrame:
    """E_ and S_ of the seven types."""
    c = F.col
    direct = F.lit(min(1.0, max(0.0, float(rule.get("RULE_DIRECT_OUTCOME_GUARANTEE", 0.0))))) * c("RULE_DIRECT_OUTCOME_GUARANTEE")
    unlinked = f_not(c("HAS_VERIFIABLE_ORG_LINK"))
    out = {
        "GUARANTEED_OUTCOME": f_or(c("OUTCOME_GUARANTEED_EVIDENCE"), direct),
        "ELIGIBILITY_MISREPRESENTATION": c("REQUIREMENT_WAIVED_EVIDENCE"),
        "PRESSURE_TACTICS": c("PRESSURE_INTENSITY"),
        "MISLEADING_TESTIMONIAL": f_and(c("TESTIMONIAL_SUCCESS_EVIDENCE"), unlinked),
        "LACK_OF_TRANSPARENCY": f_and(c("CLAIM_SCOPE"), unlinked),
        "OMISSION": f_and(c("BROAD_FREE_CLAIM"), f_not(c("MATERIAL_CAVEAT"))),
        "IMPLICATIVE_LANGUAGE": c("IMPLICATIVE_PROMISE"),
    }
    rows = once(rows, {f"E_{k}": v for k, v in out.items()})
    return rows.withColumns({f"S_{k}": cap(c(f"E_{k}")) for k in fixed.TYPES})


def accumulate(rows: DataFrame) -> DataFrame:
    """Critical risk, active soft evidence (A_), accumulated soft risk, and the score."""
    soft = ["OMISSION", "MISLEADING_TESTIMONIAL", "LACK_OF_TRANSPARENCY", "IMPLICATIVE_LANGUAGE", "PRESSURE_TACTICS"]
    rows = rows.withColumns({f"A_{k}": active(F.col(f"E_{k}")) for k in soft})
    om, te, tr, im, pr = (F.col(f"A_{k}") for k in soft)
    rows = rows.withColumns(
        {
            "critical_risk_score": f_or(*[F.col(f"E_{k}") for k in fixed.CRITICAL_TYPES]),
            "omission_accumulation_score": f_and(om, f_or(tr, im, pr)),
            "testimonial_accumulation_score": f_and(te, f_or(tr, im, pr)),
            "transparency_persuasion_accumulation_score": f_and(tr, im, pr),
        }
    )
    rows = rows.withColumn("soft_accumulation_risk", f_or(*[F.col(k) for k in ACCUMULATED[1:4]]))
    return once(rows, {"weak_labeling_score": cap(F.greatest("critical_risk_score", "soft_accumulation_risk"))})


def label(rows: DataFrame) -> DataFrame:
    """Triggered types by falling score (declaration breaks ties), counts by tier, channel and framework label."""
    scored = F.array(*[F.struct((-F.col(f"S_{k}")).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(fixed.TYPES)])
    hit = F.array_sort(F.filter(scored, lambda x: x["s"] <= -fixed.SOFT_ACTIVE))
    count = lambda names: F.size(F.filter("__hit", lambda x: x["k"].isin(names)))
    score = F.col("weak_labeling_score")
    rows = rows.withColumn("__hit", hit)
    critical = F.col("critical_risk_score") >= F.col("soft_accumulation_risk")
    rows = rows.withColumns(
        {
            "triggered_deception_types": F.array_join(F.transform("__hit", lambda x: x["k"]), "|"),
            "triggered_type_count": F.size("__hit"),
            "high_risk_type_count": count(fixed.CRITICAL_TYPES),
            "medium_risk_type_count": count(["PRESSURE_TACTICS", "MISLEADING_TESTIMONIAL", "LACK_OF_TRANSPARENCY"]),
            "supporting_type_count": count(["OMISSION", "IMPLICATIVE_LANGUAGE"]),
            "top_deception_type": F.coalesce(F.get("__hit", F.lit(0))["k"], F.lit("NONE")),
            "top_deception_score": F.coalesce(-F.get("__hit", F.lit(0))["s"], F.lit(0.0)),
            "top_risk_channel": F.when(critical, "critical_risk").otherwise("soft_accumulation"),
            "framework_weak_label": F.when(score < fixed.NORMAL_BELOW, "normal").when(score >= fixed.SUSPICIOUS_FROM, "suspicious").otherwise("uncertain"),
            "cumulative_rule_matched": (F.col("soft_accumulation_risk") >= fixed.NORMAL_BELOW).cast("int"),
        }
    )
    return rows.withColumn("cumulative_suspicious_override", (~critical & (score >= fixed.SUSPICIOUS_FROM)).cast("int")).drop("__hit")


def final_label(rows: DataFrame, seed: str = "seed_label") -> DataFrame:
    """original_seed_label, and seed_label as given for labelled rows, else the framework's."""
    s = F.lower(F.trim(F.col("original_seed_label")))
    rows = rows.withColumn("original_seed_label", F.coalesce(F.col(seed).cast("string"), F.lit("")))
    return rows.withColumn(seed, F.when(s.isin("legitimate", "normal", "weak_normal"), "normal").when(s.isin("suspicious", "weak_suspicious"), "suspicious").otherwise(F.coalesce("framework_weak_label", F.lit("normal"))))


def score(rows: DataFrame, ner: dict, relation: dict, rule: dict) -> DataFrame:
    """All of the above for rows with rule columns, has_ and p_ columns."""
    return label(accumulate(deception_types(intermediate_evidence(base_evidence(rows, ner, relation, rule), ner, rule), rule)))


def is_methodology_column(name: str) -> bool:
    return name != "seed_label" and (name.startswith(("E_", "S_", "A_", "RULE_", "LEX_")) or name in METHODOLOGY)


METHODOLOGY = {*ACCUMULATED, "OUTCOME_GUARANTEED_EVIDENCE", "REQUIREMENT_WAIVED_EVIDENCE", "TESTIMONIAL_SUCCESS_EVIDENCE", "HAS_VERIFIABLE_ORG_LINK", "CLAIM_SCOPE", "GENERIC_ONLY_INSTITUTION", "BROAD_FREE_CLAIM", "MATERIAL_CAVEAT", "PRESSURE_INTENSITY", "IMPLICATIVE_PROMISE", "triggered_deception_types", "triggered_type_count", "high_risk_type_count", "medium_risk_type_count", "supporting_type_count", "top_deception_type", "top_deception_score", "top_risk_channel", "framework_weak_label", "cumulative_rule_matched", "cumulative_suspicious_override", "original_seed_label"}


def training_rows(scored: DataFrame) -> DataFrame:
    """Rows labelled normal or suspicious, without methodology columns."""
    rows = scored.filter(F.lower("seed_label").isin("normal", "suspicious"))
    return rows.select(*[c for c in rows.columns if not is_methodology_column(c)])


def missing_features(rows: DataFrame) -> list[str]:
    want = [f"{a}{x}{b}" for x in fixed.NER_LABELS for a, b in (("ner_", ""), ("has_", ""), ("ner_vote_rate_", ""), ("ner_count_", "_mean"))] + [f"{a}{x}" for x in fixed.RE_LABELS for a in ("p_", "re_")] + ["ner_entities", "has_NER", "re_labels", "has_RE"]
    return [c for c in want if c not in rows.columns]


def decision_report(scored: DataFrame) -> DataFrame:
    """section, metric, value: counts of labels by origin, in one pass."""
    legit = F.lower("original_seed_label") == "legitimate"
    is_ = lambda c, x: F.col(c) == x
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    sums = {"rows": F.count(F.lit(1)), "legitimate": n(legit), "unlabelled": n(~legit)}
    for x in ("normal", "uncertain", "suspicious"):
        sums[f"legitimate_{x}"] = n(legit & is_("framework_weak_label", x))
        sums[f"unlabelled_{x}"] = n(~legit & is_("framework_weak_label", x))
    for x in ("normal", "suspicious"):
        sums[f"train_{x}"] = n(is_("seed_label", x))
    sums["removed_uncertain"] = n(~F.col("seed_label").isin("normal", "suspicious"))
    sums["critical_channel"] = n(is_("top_risk_channel", "critical_risk"))
    one = scored.agg(*[v.cast("long").alias(k) for k, v in sums.items()])
    return one.select(F.expr(f"stack({len(sums)}, {', '.join(f'{chr(39)}{k}{chr(39)}, {k}' for k in sums)}) AS (metric, value)")).select(F.lit("summary").alias("section"), "metric", "value")


def false_positive_review(scored: DataFrame, text: str) -> DataFrame:
    """Legitimate posts that the framework doesn't take for normal, with a preview of their text."""
    rows = scored.filter((F.lower("original_seed_label") == "legitimate") & (F.col("framework_weak_label") != "normal"))
    return rows.select("post_id", "framework_weak_label", "weak_labeling_score", "top_deception_type", F.substring(squeeze(F.col(text)), 1, fixed.PREVIEW).alias("preview"))
