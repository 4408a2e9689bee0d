"""Every query of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeloom.plans import attribution, configured, inference, metrics, numerics, operations, relations, rendering, sampling, scenes, selection, storage, streams, text_metrics, timeline, turn_periods, versioning

MODULES = [turn_periods, selection, metrics, timeline, text_metrics, sampling, relations, versioning, rendering, inference, numerics, scenes, streams, configured, attribution, storage, operations]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
