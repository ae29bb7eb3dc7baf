"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citeloom.plans import q_eval, q_more, q_rules, q_search, q_text, q_train  # noqa: F401
from citeloom.plans.registry import QUERIES, SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """BM25 retrieval over the papers, evaluated against the gold papers."""
    return QUERIES["bm25_evaluated"](spark, d)
