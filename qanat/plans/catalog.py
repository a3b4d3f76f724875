"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from qanat.plans import contract_queries, conversation_queries, dialogue_queries, eval_queries, gate_queries, plan_queries, release_queries, stream_queries  # noqa: F401
from qanat.plans.registry import ORACLES, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
