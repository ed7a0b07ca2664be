"""All registered queries of the document operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.plans import document_queries, function_queries  # noqa: F401  both register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(document_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(document_queries.SQL)
