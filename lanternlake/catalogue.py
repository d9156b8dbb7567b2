"""All queries of the library, by name, and their SQL."""

from __future__ import annotations

from .plans import check_queries, evidence_queries, model_queries, text_queries

PARTS = [text_queries, evidence_queries, model_queries, check_queries]


def queries() -> dict:
    return {name: f for part in PARTS for name, f in part.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for part in PARTS for name, text in part.O.items()}
