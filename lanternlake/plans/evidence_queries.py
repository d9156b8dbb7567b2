"""Queries of rules and weak-label evidence, with their SQL.

Entities and relations of a post are made from its number, the same way on both sides; so are reliabilities.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import evidence as E
from ..operators import predict as P
from ..operators import rules as R
from ..sources.posts import posts, quote, sql
from .text_queries import SQUEEZE, ascii_words

Q: dict = {}
O: dict[str, str] = {}

NER = {x: round(0.5 + 0.03 * i, 2) for i, x in enumerate(fixed.NER_LABELS)}
RELATION = {x: round(0.6 + 0.1 * i, 2) for i, x in enumerate(fixed.RE_LABELS)}
RULE = {r: d for r, *_, d in fixed.RULES}


def query(name: str, oracle: str):
    def add(f):
        Q[name] = f
        O[name] = oracle
        return f

    return add


def flagged(spark, sf):
    p = posts(spark, sf)
    has = {f"has_{x}": ((F.col("ord") * 7 + i) % 9 == 0).cast("int") for i, x in enumerate(fixed.NER_LABELS)}
    p = p.withColumns(has | {f"p_{x}": ((F.col("ord") * 13 + 29 * i) % 100) / 250.0 for i, x in enumerate(fixed.RE_LABELS)})
    names = F.array(*[F.when(F.col(f"has_{x}") == 1, F.lit(x)) for x in fixed.NER_LABELS])
    rels = F.array(*[F.when(F.col(f"p_{x}") >= 0.3, F.lit(x)) for x in fixed.RE_LABELS])
    p = p.withColumns({"ner_labels": F.array_compact(names), "relation_labels": F.array_compact(rels), "seed_label": F.col("given_label")})
    return R.rule_flags(p, "caption_text")


def scored(spark, sf):
    return E.final_label(E.score(flagged(spark, sf), NER, RELATION, RULE))


def _flag(rule: str) -> str:
    return f"CAST(regexp_matches(t, {quote(R.pattern_of(rule))}, 'i') AS INT) AS {rule}"


_ORG = f"""org0 AS (SELECT *, {ascii_words(SQUEEZE.format("caption_text"))} AS s FROM f0),
org1 AS (SELECT *, regexp_extract_all(s, {quote(fixed.NAMED_ORGANISATION)}, 0, 'i') AS ms, CASE WHEN regexp_matches(s, {quote(fixed.NAMED_ORGANISATION)}, 'i') THEN regexp_split_to_array(s, {quote("(?i)" + fixed.NAMED_ORGANISATION)}) ELSE [s] END AS gs FROM org0),
org2 AS (SELECT *, list_transform(range(1, len(ms) + 1), lambda i: coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)) AS st FROM org1),
f1 AS (SELECT * EXCLUDE (s, ms, gs, st), CAST(len(list_filter(range(1, len(ms) + 1), lambda i: regexp_matches(substring(s, CAST(greatest(0, st[i] - 120) AS BIGINT) + 1, CAST(st[i] + length(ms[i]) + 120 - greatest(0, st[i] - 120) AS BIGINT)), {quote(fixed.PROGRAM_OR_OUTCOME)}, 'i'))) > 0 AS INT) AS RULE_ORG_LINK FROM org2)"""
_SKIP = ("RULE_ORG_LINK", "LEX_PRESSURE_CUE")
_F = (
    f"f0 AS (SELECT *, given_label AS seed_label, {ascii_words('caption_text')} AS t, "
    + ", ".join(f"CAST((ord * 7 + {i}) % 9 = 0 AS INT) AS has_{x}" for i, x in enumerate(fixed.NER_LABELS))
    + ", "
    + ", ".join(f"((ord * 13 + {29 * i}) % 100) / 250.0 AS p_{x}" for i, x in enumerate(fixed.RE_LABELS))
    + f" FROM posts), {_ORG}, f AS (SELECT *, {', '.join(_flag(r) for r, *_ in fixed.RULES if r != 'RULE_ORG_LINK')} FROM f1)"
)
_RULES = [r for r, *_ in fixed.RULES]


@query("rule_flags", sql(_F) + f"SELECT post_id, {', '.join(_RULES)} FROM f")
def rule_flags(spark, sf):
    return flagged(spark, sf).select("post_id", *_RULES)


def _target(kind: str, targets: list[str]) -> str:
    return "(" + " OR ".join(f"CAST(p_{x} AS DOUBLE) >= 0.3" if kind == "relation" else f"has_{x} = 1" for x in targets) + ")"


_PRECISION = " UNION ALL ".join(f"SELECT '{r}' AS rule, {d} AS dflt, ord, post_id, {r} AS hit, CAST({_target(k, ts)} AS INT) AS pos FROM f" for r, k, ts, d in fixed.RULES)


@query(
    "rule_precision",
    sql(_F + f", u AS ({_PRECISION}), g AS (SELECT rule, dflt, sum(hit * pos) AS tp, sum(hit * (1 - pos)) AS fp, sum(hit) AS m, sum(pos) AS gp, array_to_string(list_slice(list(post_id ORDER BY ord) FILTER (hit = 1 AND pos = 1), 1, 3), '|') AS a, array_to_string(list_slice(list(post_id ORDER BY ord) FILTER (hit = 1 AND pos = 0), 1, 3), '|') AS b FROM u GROUP BY rule, dflt)")
    + "SELECT rule, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(m AS BIGINT) AS rule_matches, CAST(gp AS BIGINT) AS gold_positive, CAST(CASE WHEN m > 0 THEN tp / m ELSE dflt END AS DOUBLE) AS precision, m = 0 AS used_default, coalesce(a, '') AS example_tp, coalesce(b, '') AS example_fp FROM g",
)
def rule_precision(spark, sf):
    return R.rule_precision(flagged(spark, sf))


def _w(table: dict, k: str) -> str:
    return f"CAST({table.get(k, 0.0)} AS DOUBLE)"


def _hit(r: str) -> str:
    return f"{_w(RULE, r)} * {r}"


_BASE = ", ".join(
    [f"greatest({_w(NER, x)} * has_{x}, {_hit('LEX_' + x)}) AS E_{x}" if f"LEX_{x}" in RULE else f"{_w(NER, x)} * has_{x} AS E_{x}" for x in fixed.NER_LABELS]
    + [f"greatest({_w(RELATION, x)} * CAST(p_{x} AS DOUBLE), {_hit(r)}) AS {n}" for n, x, r in (("OUTCOME_GUARANTEED_EVIDENCE", fixed.RE_LABELS[0], "RULE_OUTCOME_GUARANTEED"), ("REQUIREMENT_WAIVED_EVIDENCE", fixed.RE_LABELS[1], "RULE_REQUIREMENT_WAIVED"), ("TESTIMONIAL_SUCCESS_EVIDENCE", fixed.RE_LABELS[2], "RULE_TESTIMONIAL_SUCCESS"), ("HAS_VERIFIABLE_ORG_LINK", fixed.RE_LABELS[3], "RULE_ORG_LINK"))]
)
_MIDDLE = f"""greatest(E_PROGRAM_OR_INTAKE, E_OUTCOME, E_COST_CLAIM, E_GENERIC_INSTITUTION, E_REQUIREMENT) AS CLAIM_SCOPE,
least(E_GENERIC_INSTITUTION, 1 - HAS_VERIFIABLE_ORG_LINK) AS GENERIC_ONLY_INSTITUTION,
greatest(E_COST_CLAIM, {_hit('LEX_STUDY_FREE')}, {_hit('LEX_NO_TUITION')}) AS BROAD_FREE_CLAIM,
greatest(E_COST_DETAIL, {', '.join(_hit('RULE_' + x) for x in ('SEMESTER_FEE', 'LIVING_COST', 'BLOCKED_ACCOUNT', 'PROOF_OF_FUNDS', 'PUBLIC_PRIVATE_QUALIFIER'))}) AS MATERIAL_CAVEAT,
greatest({_hit('RULE_PRESSURE_STRONG')} * 1.0::DOUBLE, {_hit('RULE_PRESSURE_MEDIUM')} * 0.75::DOUBLE, {_hit('RULE_PRESSURE_WEAK')} * 0.45::DOUBLE, {_w(NER, 'PRESSURE_CUE')} * has_PRESSURE_CUE) AS PRESSURE_INTENSITY,
greatest(E_VAGUE_BENEFIT, {', '.join(_hit('RULE_' + x) for x in ('FUTURE_PROMISE', 'DREAM_JOB', 'GLOBAL_CAREER', 'LIFE_CHANGING', 'BRIGHT_FUTURE'))}) AS IMPLICATIVE_PROMISE"""
_TYPES = f"""greatest(OUTCOME_GUARANTEED_EVIDENCE, {_hit('RULE_DIRECT_OUTCOME_GUARANTEE')}) AS E_GUARANTEED_OUTCOME, REQUIREMENT_WAIVED_EVIDENCE AS E_ELIGIBILITY_MISREPRESENTATION,
PRESSURE_INTENSITY AS E_PRESSURE_TACTICS, least(TESTIMONIAL_SUCCESS_EVIDENCE, 1 - HAS_VERIFIABLE_ORG_LINK) AS E_MISLEADING_TESTIMONIAL, least(CLAIM_SCOPE, 1 - HAS_VERIFIABLE_ORG_LINK) AS E_LACK_OF_TRANSPARENCY,
least(BROAD_FREE_CLAIM, 1 - MATERIAL_CAVEAT) AS E_OMISSION, IMPLICATIVE_PROMISE AS E_IMPLICATIVE_LANGUAGE"""
_SOFT = ["OMISSION", "MISLEADING_TESTIMONIAL", "LACK_OF_TRANSPARENCY", "IMPLICATIVE_LANGUAGE", "PRESSURE_TACTICS"]
_ACC = """greatest(E_GUARANTEED_OUTCOME, E_ELIGIBILITY_MISREPRESENTATION) AS critical_risk_score,
least(A_OMISSION, greatest(A_LACK_OF_TRANSPARENCY, A_IMPLICATIVE_LANGUAGE, A_PRESSURE_TACTICS)) AS omission_accumulation_score,
least(A_MISLEADING_TESTIMONIAL, greatest(A_LACK_OF_TRANSPARENCY, A_IMPLICATIVE_LANGUAGE, A_PRESSURE_TACTICS)) AS testimonial_accumulation_score,
least(A_LACK_OF_TRANSPARENCY, A_IMPLICATIVE_LANGUAGE, A_PRESSURE_TACTICS) AS transparency_persuasion_accumulation_score"""
_S = (
    f"{_F}, e AS (SELECT *, {_BASE} FROM f), i AS (SELECT *, {_MIDDLE} FROM e), d AS (SELECT *, {_TYPES} FROM i), a AS (SELECT *, {', '.join(f'CASE WHEN E_{k} >= 0.35 THEN E_{k} ELSE 0 END AS A_{k}' for k in _SOFT)} FROM d), "
    f"c AS (SELECT *, {_ACC} FROM a), s AS (SELECT *, greatest(omission_accumulation_score, testimonial_accumulation_score, transparency_persuasion_accumulation_score) AS soft_accumulation_risk FROM c), "
    "w AS (SELECT *, greatest(critical_risk_score, soft_accumulation_risk) AS weak_labeling_score FROM s), "
    "l AS (SELECT *, CASE WHEN weak_labeling_score < 0.4 THEN 'normal' WHEN weak_labeling_score >= 0.7 THEN 'suspicious' ELSE 'uncertain' END AS framework_weak_label, CASE WHEN critical_risk_score >= soft_accumulation_risk THEN 'critical_risk' ELSE 'soft_accumulation' END AS top_risk_channel FROM w), "
    "z AS (SELECT * EXCLUDE (seed_label), seed_label AS original_seed_label, CASE WHEN lower(trim(seed_label)) IN ('legitimate', 'normal', 'weak_normal') THEN 'normal' WHEN lower(trim(seed_label)) IN ('suspicious', 'weak_suspicious') THEN 'suspicious' ELSE framework_weak_label END AS seed_label FROM l)"
)


def _rounded(names: list[str]) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def _rounded_sql(names: list[str]) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


_EV1 = [f"E_{x}" for x in fixed.NER_LABELS] + ["OUTCOME_GUARANTEED_EVIDENCE", "REQUIREMENT_WAIVED_EVIDENCE", "TESTIMONIAL_SUCCESS_EVIDENCE", "HAS_VERIFIABLE_ORG_LINK"]
_EV2 = ["CLAIM_SCOPE", "GENERIC_ONLY_INSTITUTION", "BROAD_FREE_CLAIM", "MATERIAL_CAVEAT", "PRESSURE_INTENSITY", "IMPLICATIVE_PROMISE"]
_EV3 = [f"E_{k}" for k in fixed.TYPES]
for _name, _columns in (("evidence_base", _EV1), ("evidence_intermediate", _EV2), ("deception_types", _EV3), ("accumulation", E.ACCUMULATED + [f"A_{k}" for k in _SOFT])):
    Q[_name] = lambda spark, sf, c=_columns: scored(spark, sf).select("post_id", *_rounded(c))
    O[_name] = sql(_S) + f"SELECT post_id, {_rounded_sql(_columns)} FROM z"

_HIT = "list_sort([x for x in [" + ", ".join(f"{{'s': -E_{k}, 'i': {i}, 'k': '{k}'}}" for i, k in enumerate(fixed.TYPES)) + "] if x.s <= -0.35])"


@query(
    "framework_label",
    sql(_S + f", h AS (SELECT *, {_HIT} AS hit FROM z)")
    + "SELECT post_id, framework_weak_label, top_risk_channel, array_to_string([x.k for x in hit], '|') AS triggered_deception_types, CAST(len(hit) AS INT) AS triggered_type_count, CAST(len([x for x in hit if x.k IN ('GUARANTEED_OUTCOME', 'ELIGIBILITY_MISREPRESENTATION')]) AS INT) AS high_risk_type_count, coalesce(hit[1].k, 'NONE') AS top_deception_type, CAST(soft_accumulation_risk >= 0.4 AS INT) AS cumulative_rule_matched, CAST(top_risk_channel = 'soft_accumulation' AND weak_labeling_score >= 0.7 AS INT) AS cumulative_suspicious_override FROM h",
)
def framework_label(spark, sf):
    return scored(spark, sf).select("post_id", "framework_weak_label", "top_risk_channel", "triggered_deception_types", "triggered_type_count", "high_risk_type_count", "top_deception_type", "cumulative_rule_matched", "cumulative_suspicious_override")


@query("final_label", sql(_S) + "SELECT original_seed_label, framework_weak_label, seed_label, count(*) AS n FROM z GROUP BY ALL")
def final_label(spark, sf):
    return scored(spark, sf).groupBy("original_seed_label", "framework_weak_label", "seed_label").agg(F.count(F.lit(1)).alias("n"))


@query("training_projection", sql(_S) + f"SELECT ord, post_id, account_name, caption_text, language, phrase, given_label, seed_label, {', '.join(f'has_{x}' for x in fixed.NER_LABELS)} FROM z WHERE seed_label IN ('normal', 'suspicious')")
def training_projection(spark, sf):
    rows = E.training_rows(scored(spark, sf))
    return rows.drop("ner_labels", "relation_labels", *[f"p_{x}" for x in fixed.RE_LABELS])


_REPORT = ["'rows', count(*)", "'legitimate', count(*) FILTER (lg)", "'unlabelled', count(*) FILTER (NOT lg)"]
for _x in ("normal", "uncertain", "suspicious"):
    _REPORT += [f"'legitimate_{_x}', count(*) FILTER (lg AND framework_weak_label = '{_x}')", f"'unlabelled_{_x}', count(*) FILTER (NOT lg AND framework_weak_label = '{_x}')"]
_REPORT += ["'train_normal', count(*) FILTER (seed_label = 'normal')", "'train_suspicious', count(*) FILTER (seed_label = 'suspicious')", "'removed_uncertain', count(*) FILTER (seed_label NOT IN ('normal', 'suspicious'))", "'critical_channel', count(*) FILTER (top_risk_channel = 'critical_risk')"]


@query("decision_report", sql(_S + ", r AS MATERIALIZED (SELECT *, lower(original_seed_label) = 'legitimate' AS lg FROM z)") + " UNION ALL ".join(f"SELECT 'summary' AS section, {x.replace(', count', ' AS metric, count', 1)} AS value FROM r" for x in _REPORT))
def decision_report(spark, sf):
    return E.decision_report(scored(spark, sf))


@query("false_positive_review", sql(_S) + f"SELECT post_id, framework_weak_label, round(weak_labeling_score, 6) AS weak_labeling_score, substring({SQUEEZE.format('caption_text')}, 1, 350) AS preview FROM z WHERE lower(original_seed_label) = 'legitimate' AND framework_weak_label <> 'normal'")
def false_positive_review(spark, sf):
    return E.false_positive_review(scored(spark, sf), "caption_text").select("post_id", "framework_weak_label", F.round("weak_labeling_score", 6).alias("weak_labeling_score"), "preview")


_SPANS = " UNION ALL ".join(f"SELECT '{x}' AS label, unnest(regexp_extract_all(t, {quote(R.pattern_of('LEX_' + x))}, 0, 'i')) AS m FROM (SELECT {ascii_words('caption_text')} AS t FROM posts)" for x in P.LEXICAL)


@query("lexical_spans", sql(f"s AS ({_SPANS})") + "SELECT label, count(*) AS n, CAST(sum(length(m)) AS BIGINT) AS characters FROM s GROUP BY label")
def lexical_spans(spark, sf):
    found = posts(spark, sf).select(F.explode(P.lexical_spans(F.col("caption_text"))).alias("s")).select("s.*")
    return found.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("end") - F.col("start")).cast("long")).alias("characters"))
