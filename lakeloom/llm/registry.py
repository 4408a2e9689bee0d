"""Every query of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm import chunking, grouped_splits, mixing, packing, speaker_turns, split_overlap, token_budget

MODULES = [token_budget, speaker_turns, grouped_splits, split_overlap, packing, mixing, chunking]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
