"""Every registered query by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


from turnloom.plans import (  # noqa: E402,F401
    duplicates, evaluation_sets, operations, replay, retrieval, scoring, text_and_guard)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Chunk retrieval, window and accounting for every conversation."""
    return QUERIES["conversation_contexts"](spark, folder)
