"""Every registered query, with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.plans import corpus_queries, form_queries, pipelines, relational_queries, vector_queries, workspace_queries  # noqa: F401
from quern.plans.bind import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns end to end."""
    return QUERIES["v4_patterns"](spark, sf_dir)
