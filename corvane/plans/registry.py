"""All queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.plans import corpora, graphs, retrieval, texts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return retrieval.QUERIES | graphs.QUERIES | texts.QUERIES | corpora.QUERIES


def oracle_sql() -> dict[str, str]:
    return retrieval.SQL | graphs.SQL | texts.SQL | corpora.SQL
