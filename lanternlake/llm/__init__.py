"""Operators for large-scale training data.  Nothing else in the library imports this subpackage."""

from __future__ import annotations

from pyspark import cloudpickle

from . import license_scan, line_dedup, lm_scoring, lm_words, near_dedup, packing, quality_classifier, quality_rules, secret_scan, source_mixing, topk_search

for _module in (lm_scoring, lm_words, near_dedup, packing, quality_classifier, topk_search):
    cloudpickle.register_pickle_by_value(_module)  # executors need not have this package on their path


def queries() -> dict:
    return {
        "op1_secret_scan": secret_scan.op1_secret_scan,
        "op2_lm_scoring": lm_scoring.op2_lm_scoring,
        "op3_near_dedup": near_dedup.op3_near_dedup,
        "op4_topk_search": topk_search.op4_topk_search,
        "op5_quality_classifier": quality_classifier.op5_quality_classifier,
        "op6_source_mixing": source_mixing.op6_source_mixing,
        "op7_quality_rules": quality_rules.op7_quality_rules,
        "op8_best_fit_packing": packing.op8_best_fit_packing,
        "op9_license_scan": license_scan.op9_license_scan,
        "op10_line_dedup": line_dedup.op10_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_topk_search": topk_search.ORACLE,
        "op6_source_mixing": source_mixing.ORACLE,
        "op7_quality_rules": quality_rules.ORACLE,
        "op9_license_scan": license_scan.oracle(),
        "op10_line_dedup": line_dedup.ORACLE,
    }
