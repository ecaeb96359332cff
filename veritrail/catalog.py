"""All registered queries outside the optional subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import q_answers, q_entities, q_features, q_metrics, q_ml, q_plugins, q_reports, q_retrieval, q_selection, q_sources, q_text  # noqa: F401
from .plans.registry import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship_answer_scores"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
