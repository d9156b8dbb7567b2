"""The rule catalogue as flag columns, and the rules' precision on gold records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, search
from ..functions import text as X

#: Rules that aren't one pattern of their own name.
SPECIAL = {
    "LEX_PRESSURE_CUE": ["PRESSURE_STRONG", "PRESSURE_MEDIUM", "PRESSURE_WEAK"],
    "RULE_DIRECT_OUTCOME_GUARANTEE": fixed.OUTCOME_GUARANTEED,
    "RULE_OUTCOME_GUARANTEED": fixed.OUTCOME_GUARANTEED,
    "RULE_REQUIREMENT_WAIVED": fixed.REQUIREMENT_WAIVED,
    "RULE_TESTIMONIAL_SUCCESS": fixed.TESTIMONIAL_SUCCESS,
}

def pattern_of(rule: str) -> str:
    """The rule's pattern; RULE_ORG_LINK has none."""
    own = SPECIAL.get(rule)
    if isinstance(own, list):
        return "|".join(f"(?:{fixed.PATTERNS[p]})" for p in own)
    return own or fixed.PATTERNS[rule.removeprefix("LEX_").removeprefix("RULE_")]


#: Rules that are another rule's flag, or the greatest of several.
DERIVED = {"RULE_DIRECT_OUTCOME_GUARANTEE": ["RULE_OUTCOME_GUARANTEED"], "LEX_PRESSURE_CUE": ["RULE_PRESSURE_STRONG", "RULE_PRESSURE_MEDIUM", "RULE_PRESSURE_WEAK"]}


#: For flags only: a name's further words change nothing, as its last one is a name too.
FURTHER_WORDS = r"(?:\s+[A-Z][A-Za-z]+){0,3}"
#: What a match ends with.  It is looked for before the whole pattern, which may begin at any word.
ENDS = {"RULE_TESTIMONIAL_SUCCESS": r"\b(?:secured|securing|received|receiving|got|achieved|obtained|was\s+admitted|were\s+admitted)\b.{0,100}\b(?:admissions?|visa\s+approval|student\s+visa|study\s+visa|scholarship|admit|offer\s+letter|acceptance\s+letter)\b"}


def hits(text: Column, rules: list[str]) -> Column:
    """Struct of 0/1 flags of rules that aren't derived.  Each pattern runs only on texts that hold the words it needs."""
    patterns = {r: search.ORGANISATION_HINT if r == "RULE_ORG_LINK" else pattern_of(r).replace(FURTHER_WORDS, "") for r in rules}
    return search.flags(text, patterns, ENDS, {"RULE_ORG_LINK": search.organisation_link} if "RULE_ORG_LINK" in rules else {})


def rule_flags(rows: DataFrame, text: str, only: list[str] | None = None) -> DataFrame:
    """rows with one 0/1 column a rule, or for each rule of only.  Patterns that two rules share run once."""
    wanted = [r for r, *_ in fixed.RULES if only is None or r in only]
    tested = list(dict.fromkeys(x for r in wanted for x in DERIVED.get(r, [r])))
    out = X.unpacked(rows, hits(F.col(text), tested))
    derived = {r: F.greatest(*DERIVED[r]) if len(DERIVED[r]) > 1 else F.col(DERIVED[r][0]) for r in wanted if r in DERIVED}
    return out.withColumns(derived).drop(*(x for x in tested if x not in wanted)) if derived else out


def rule_precision(gold: DataFrame, ner: str = "ner_labels", relations: str = "relation_labels", key: str = "post_id", order: str = "ord") -> DataFrame:
    """One row a rule of flagged gold records: tp, fp, matches, positives, precision (the default without matches), and the
    first three keys of each kind.  One pass: rules are unpivoted, counted, and only three examples are kept a rule."""
    has = lambda kind, ts: F.arrays_overlap(F.col(relations if kind == "relation" else ner), F.array(*map(F.lit, ts)))
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(d).alias("default"), F.col(r).alias("hit"), has(kind, ts).cast("int").alias("pos")) for r, kind, ts, d in fixed.RULES])
    rows = gold.select(F.col(key).alias("k"), F.col(order).alias("o"), F.explode(each).alias("x")).select("k", "o", "x.*")
    count = lambda c: F.sum(c.cast("long")).alias
    hit, pos = F.col("hit") == 1, F.col("pos") == 1
    out = rows.groupBy("rule", "default").agg(count(hit & pos)("tp"), count(hit & ~pos)("fp"), count(hit)("rule_matches"), count(pos)("gold_positive"))
    from pyspark.sql import Window

    first = rows.filter(hit).withColumn("i", F.row_number().over(Window.partitionBy("rule", "pos").orderBy("o"))).filter("i <= 3")
    ids = lambda p, name: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("pos") == p, F.struct("i", "k")))), lambda x: x["k"]), "|").alias(name)
    examples = first.groupBy("rule").agg(ids(1, "example_tp"), ids(0, "example_fp"))
    out = out.join(examples, "rule", "left")
    precision = F.when(F.col("rule_matches") > 0, F.col("tp") / F.col("rule_matches")).otherwise(F.col("default"))
    return out.select("rule", "tp", "fp", "rule_matches", "gold_positive", precision.alias("precision"), (F.col("rule_matches") == 0).alias("used_default"), F.coalesce("example_tp", F.lit("")).alias("example_tp"), F.coalesce("example_fp", F.lit("")).alias("example_fp"))
