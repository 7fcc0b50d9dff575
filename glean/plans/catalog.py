"""Every registered query by name, with the SQL that gives the same rows."""

from __future__ import annotations

from glean.plans import chunk_queries, dataset_queries, evaluation_queries, model_queries, score_queries, source_queries, text_queries, tuning_queries  # noqa: F401
from glean.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
