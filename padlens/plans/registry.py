"""Every registered query of the library and its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from padlens.plans import audit_queries, gesture_queries, metric_queries, more_queries, report_queries, session_queries, stream_queries

_MODULES = [metric_queries, gesture_queries, session_queries, more_queries, report_queries, stream_queries, audit_queries]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["e1_operating_metrics"](spark, sf_dir)
