"""Predictors of spans and relations.

A predictor is a function of a DataFrame and its text column that adds spans (array<struct<start,end,text,label,score>>) and
relation scores p_<relation>; models plug in here.  The lexical one below takes spans and relations from the rule patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, search
from ..functions import text as X
from .rules import hits, pattern_of

#: Labels that have a lexical rule.
LEXICAL = [x for x in fixed.NER_LABELS if any(r == f"LEX_{x}" for r, *_ in fixed.RULES)]


def lexical_spans(text: Column) -> Column:
    """Matches of the labels' patterns, in order of start, end and label."""
    return search.spans(text, {x: pattern_of(f"LEX_{x}") for x in LEXICAL})


def lexical(rows: DataFrame, text: str) -> DataFrame:
    """rows with spans and p_<relation> from the rules."""
    rules = dict(zip(fixed.RE_LABELS, ("RULE_OUTCOME_GUARANTEED", "RULE_REQUIREMENT_WAIVED", "RULE_TESTIMONIAL_SUCCESS", "RULE_ORG_LINK"), strict=True))
    both = rows.withColumns({"__spans": lexical_spans(F.col(text)), "__hits": hits(F.col(text), list(rules.values()))})
    return X.once(both, {"spans": F.col("__spans"), **{f"p_{x}": F.col(f"__hits.{r}").cast("double") for x, r in rules.items()}}).drop("__spans", "__hits")


def with_features(rows: DataFrame, key: str = "post_id") -> DataFrame:
    """rows with has_<label>, vote rates and counts, taken from their spans as those of one model."""
    from .spans import feature_columns, vote_labels

    spans = rows.select(key, F.lit(0).alias("model"), F.explode("spans").alias("s")).select(key, "model", "s.*")
    features = feature_columns(vote_labels(spans, key, 1, 1), key)
    out = rows.join(features, key, "left")
    zero = {c: F.coalesce(F.col(c), F.lit("" if t == "string" else 0)) for c, t in features.dtypes if c != key}
    return out.withColumns(zero)
