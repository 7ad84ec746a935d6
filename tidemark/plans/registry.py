"""All queries of the library, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import content, decisions, evaluation, ingestion, operations, relational, study, upkeep

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in (study, evaluation, relational, decisions, content, ingestion, operations, upkeep):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
