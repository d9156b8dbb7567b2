"""The workflow as lazy stages: normalise, split, enrich, label, evaluate.  Files between them are optional checkpoints."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import evidence, metrics, predict, rules, split
from ..sources import files


@dataclass
class Config:
    """Paths and choices of a run."""

    raw: str = ""
    annotations: str = ""
    text: str = "clean_text"
    ner: dict = field(default_factory=lambda: dict.fromkeys(fixed.NER_LABELS, 1.0))
    relation: dict = field(default_factory=lambda: dict.fromkeys(fixed.RE_LABELS, 1.0))
    rule: dict = field(default_factory=lambda: {r: d for r, *_, d in fixed.RULES})
    predictor: Callable[[DataFrame, str], DataFrame] = predict.lexical
    threshold_mode: str = "val_f1"


def normalise(spark: SparkSession, cfg: Config) -> DataFrame:
    return files.normalize(files.read_post_dir(spark, cfg.raw))


def candidates(posts: DataFrame, annotated: DataFrame, key: str = "post_id") -> DataFrame:
    """Posts that nobody has annotated; rows must have the key."""
    missing = [c for c in (key, "seed_label") if c not in posts.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return split.without(posts, annotated, key)


def enrich(posts: DataFrame, cfg: Config) -> DataFrame:
    return predict.with_features(cfg.predictor(posts, cfg.text))


def label(enriched: DataFrame, cfg: Config) -> DataFrame:
    """Evidence, framework label and final label of enriched posts."""
    return evidence.final_label(evidence.score(rules.rule_flags(enriched, cfg.text), cfg.ner, cfg.relation, cfg.rule))


def evaluate(scored: DataFrame, cfg: Config, by: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """The chosen threshold of each group, with the areas under both curves."""
    chosen = metrics.choose_threshold(metrics.threshold_sweep(scored, by, y, score), by, cfg.threshold_mode)
    return chosen.join(metrics.roc_auc(scored, by, y, score), by).join(metrics.average_precision(scored, by, y, score), by)


def run(spark: SparkSession, cfg: Config) -> DataFrame:
    """Raw posts to training rows."""
    posts = normalise(spark, cfg)
    if cfg.annotations:
        posts = candidates(posts, files.read_annotation_keys(spark, cfg.annotations))
    return evidence.training_rows(label(enrich(posts, cfg), cfg)).withColumn("y", F.when(F.lower("seed_label") == "suspicious", 1).otherwise(0))
