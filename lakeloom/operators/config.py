"""Declared sources as one plan: scan, filters in a fixed order, limits, repeats and a weighted, seeded interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.operators import sampling, selection

SOURCE_KEYS = {"name", "dataset", "version", "splits", "tasks", "clean", "include", "exclude", "holdout", "min_duration", "max_duration", "where", "samples", "reps", "weight"}


def checked(sources: list[dict]) -> list[dict]:
    """Declarations with defaults; unknown keys, repeated names, and weights that aren't on all or none are errors."""
    names = [s.get("name") for s in sources]
    if not sources or None in names or len(set(names)) != len(names):
        raise ValueError("sources need different names")
    for s in sources:
        if odd := set(s) - SOURCE_KEYS:
            raise ValueError(f"{s['name']}: unknown {sorted(odd)}")
        if "weight" in s and (s.keys() & {"samples", "reps"} or not float(s["weight"]) > 0 or float(s["weight"]) == float("inf")):
            raise ValueError(f"{s['name']}: a weight is positive and finite, and excludes samples and reps")
    if len({"weight" in s for s in sources}) > 1:
        raise ValueError("weights are on all sources or on none")
    return [{"reps": 1, "samples": None, "clean": False} | s for s in sources]


def source_rows(records: DataFrame, s: dict, ids: dict[str, DataFrame]) -> DataFrame:
    """One source's rows. Records have id, task, dataset_id, version, split, duration, metadata; named id lists come from ``ids``.

    Filters run in this order: scan, clean, exclude and include, hold-out, duration, condition; ``samples`` counts rows
    that are left, so it is applied later.
    """
    rows = records
    for key, column in (("dataset", "dataset_id"), ("version", "version")):
        if key in s:
            rows = rows.where(F.col(column) == s[key])
    for key, column in (("splits", "split"), ("tasks", "task")):
        if key in s:
            rows = rows.where(F.col(column).isin(s[key]))
    if s["clean"]:
        rows = rows.where(selection.clean_pass(F.col("metadata")))
    if "exclude" in s:
        rows = selection.exclude_ids(rows, ids[s["exclude"]])
    if "include" in s:
        rows = selection.include_ids(rows, ids[s["include"]])
    if "holdout" in s:
        rows = selection.exclude_ids(rows, ids[s["holdout"]].select(F.col("key").alias("source_record_id")), "source_record_id")
    if "min_duration" in s:
        rows = rows.where(F.col("duration") >= s["min_duration"])
    if "max_duration" in s:
        rows = rows.where(F.col("duration") <= s["max_duration"])
    return rows.where(s["where"]) if "where" in s else rows


def plan(records: DataFrame, sources: list[dict], epoch: int, seed: int, ids: dict[str, DataFrame] | None = None) -> DataFrame:
    """(source, id, rep, at) of one epoch: each source's due rows, repeated, all interleaved by weight in order of ``at``.

    Without weights a source's weight is its number of draws. Two shuffles, by source and range; no row is collected.
    """
    made = None
    for s in checked(sources):
        rows = source_rows(records, s, ids or {}).select("id", F.lit(s["name"]).alias("source"), F.lit(s["samples"]).cast("long").alias("samples"), F.lit(s["reps"]).alias("reps"), F.lit(float(s.get("weight", 0))).alias("weight"))
        made = rows if made is None else made.unionByName(rows)
    due = sampling.rotated(sampling.numbered(made, "source", ["id"]), F.col("samples"), F.col("reps"), epoch)
    due = due.withColumn("draw", F.concat_ws("#", "id", "rep"))
    sizes = due.groupBy("source").agg(F.count("*").alias("draws"))
    weighted = due.join(F.broadcast(sizes), "source").withColumn("weight", F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.col("draws")))
    return sampling.interleaved(weighted, "source", F.col("weight"), seed + epoch, "draw").select("source", "id", "rep", "at")
