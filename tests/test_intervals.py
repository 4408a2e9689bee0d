"""Run bitmaps, periods and gaps against brute force over units."""

import random

import numpy as np
import pytest

from lakeloom.operators.intervals import SHARD, active_counts, pack_runs, periods_and_gaps, run_bitmaps, sliced, to_units, unpack_runs
from lakeloom.plans.turn_periods import latest_turns, p2_found

SCHEMA = "entity string, start long, end long"


def brute(rows):
    out = set()
    for entity in {r[0] for r in rows if r[0] is not None}:
        spans = sorted((s, e) for x, s, e in rows if x == entity and s is not None and e is not None and e > s)
        merged = []
        for s, e in spans:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(entity, "period", s, e) for s, e in merged} | {(entity, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


def found(spark, rows):
    return {tuple(r) for r in periods_and_gaps(run_bitmaps(spark.createDataFrame(rows, SCHEMA))).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_random_intervals(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(600):
        s = rng.randrange(-SHARD, 4 * SHARD)
        rows.append((rng.choice(["a", "b", "c"]), s, s + rng.choice([0, -5, 1, 10, 700, SHARD, 3 * SHARD]) * (rng.random() < 0.3 or 1)))
    rows += rows[:50]
    assert found(spark, rows) == brute(rows)


def test_shard_edges(spark):
    rows = [("a", 0, SHARD), ("a", SHARD, 2 * SHARD), ("b", 5, SHARD), ("b", 2 * SHARD, 2 * SHARD + 1), ("c", SHARD - 1, SHARD + 1), ("d", 3, 3), (None, 1, 9), ("d", None, 4), ("d", 9, None)]
    assert found(spark, rows) == brute(rows) == {("a", "period", 0, 2 * SHARD), ("b", "period", 5, SHARD), ("b", "gap", SHARD, 2 * SHARD), ("b", "period", 2 * SHARD, 2 * SHARD + 1), ("c", "period", SHARD - 1, SHARD + 1)}


def test_empty(spark):
    assert found(spark, []) == set()
    assert active_counts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_containers():
    s, e = np.array([0, 7, 65535]), np.array([5, 65534, 65536])
    a, b = unpack_runs(pack_runs(s, e))
    assert a.tolist() == s.tolist() and b.tolist() == e.tolist()


def test_active_counts(spark):
    rows = [("a", 0, 10), ("a", 5, 20), ("a", SHARD - 1, SHARD + 3), ("a", SHARD, SHARD + 1), ("b", 1, 2)]
    got = {r["entity"]: (r["covered"], r["overlapped"]) for r in active_counts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"a": (24, 6), "b": (1, 0)}


def test_slices_cover_exactly(spark):
    df = sliced(spark.createDataFrame([("a", -10, 3 * SHARD + 5)], SCHEMA))
    assert sum(r["hi"] - r["lo"] for r in df.collect()) == 3 * SHARD + 15 and df.count() == 5


def test_units(spark):
    rows = [(0.005,), (1.234,), (float("nan"),), (float("inf"),), (None,), (-0.5,), (1e12,)]
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.createDataFrame(rows, "x double").select(to_units(F.col("x"))).collect()]
    assert got == [1, 123, None, None, None, -50, None]


def test_latest_delivery(spark):
    import datetime as dt

    t = [dt.datetime(2026, 1, k) for k in (1, 2, 3)]
    rows = [(1, "w", 0.0, 1.0, t[0], "x"), (1, "w", 5.0, 6.0, t[2], "x"), (1, "w", 2.0, 3.0, t[1], "x"), (2, "w", 9.0, 8.0, t[0], "x"), (None, "w", 7.0, 7.5, t[0], "x"), (None, "w", 8.0, 8.5, None, "x"), (3, None, 0.0, 1.0, t[0], "x"), (4, "w", None, 1.0, t[0], "x")]
    df = spark.createDataFrame(rows, "turn_id long, window_id string, start_sec double, end_sec double, ingested_at timestamp, entity string")
    got = {tuple(r) for r in latest_turns(df).collect()}
    assert got == {("w", 500, 600), ("w", 900, 800), ("w", 700, 750), ("w", 800, 850), (None, 0, 100), ("w", None, 100)}


def test_long_breaks_are_not_gaps(spark, tmp_path):
    import datetime as dt

    t = dt.datetime(2026, 1, 1)
    rows = [(1, "w", 0.0, 1.0, t), (2, "w", 601.0, 602.0, t), (3, "w", 1202.01, 1203.0, t)]
    spark.createDataFrame(rows, "turn_id long, window_id string, start_sec double, end_sec double, ingested_at timestamp").write.parquet(str(tmp_path / "turns.parquet"))
    got = {tuple(r) for r in p2_found(spark, str(tmp_path)).collect()}
    assert ("w", "gap", 100, 60100) in got and len([r for r in got if r[1] == "gap"]) == 1
