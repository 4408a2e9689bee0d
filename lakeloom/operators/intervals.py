"""Interval algebra on exact time units with compressed run bitmaps.

Time is cut into shards of ``2 ** SHARD_BITS`` units. Each (entity, shard) has one bitmap held as a run
container: sorted, disjoint (first unit, length - 1) pairs of 16-bit numbers. A container can't pass
``2 ** (SHARD_BITS - 1)`` runs, whatever the number of intervals, so no task ever holds an unbounded group:
intervals are reduced to one (longest) run per first unit *before* they are brought together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.session import checkpointed

SHARD_BITS = 16
SHARD = 1 << SHARD_BITS
BITMAP_SCHEMA = "entity string, shard long, first long, head_end long, tail_start long, last long, runs int, bitmap binary"


def to_units(seconds: Column, per_second: int = 100, below_s: float = 1e9) -> Column:
    """Whole units of a time in seconds, rounded half away from zero; null for null, NaN, and times of ``below_s`` (by
    default 31 years) or more in size, which no recording has and whose shards couldn't be listed."""
    x = seconds.cast("double")
    ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(below_s))
    return F.when(ok, F.round(x * per_second).cast("long"))


def sliced(intervals: DataFrame) -> DataFrame:
    """(entity, start, end) in units, end exclusive -> one row per shard touched: (entity, shard, lo, hi), 0 <= lo < hi <= SHARD.

    Rows with a null entity or bound, or an end not after the start, cover nothing and give no row.
    """
    ok = intervals.where("entity is not null and start < end")
    at = ok.select("entity", "start", "end", F.explode(F.expr(f"sequence(shiftright(start, {SHARD_BITS}), shiftright(end - 1, {SHARD_BITS}))")).alias("shard"))
    base = F.col("shard") * SHARD
    return at.select(
        "entity",
        "shard",
        F.greatest(F.col("start") - base, F.lit(0)).cast("int").alias("lo"),
        F.least(F.col("end") - base, F.lit(SHARD)).cast("int").alias("hi"),
    )


def _union_runs(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals sorted by ``lo``; touching ones are joined."""
    top = np.maximum.accumulate(hi)
    new = np.r_[True, lo[1:] > top[:-1]]
    return lo[new], top[np.r_[np.flatnonzero(new)[1:] - 1, len(lo) - 1]]


def pack_runs(start: np.ndarray, end: np.ndarray) -> bytes:
    """The run container of sorted disjoint runs: uint16 pairs (first unit, length - 1)."""
    out = np.empty(2 * len(start), "<u2")
    out[0::2], out[1::2] = start, end - start - 1
    return out.tobytes()


def unpack_runs(bitmap: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(bitmap, "<u2").astype(np.int64)
    return x[0::2], x[0::2] + x[1::2] + 1


def _build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (entity, shard, lo) -> one row per bitmap. What a batch leaves open is carried as runs."""
    rest: pd.DataFrame | None = None

    def rows(p: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        lo, hi = p["lo"].to_numpy(np.int64), p["hi"].to_numpy(np.int64)
        entity, shard = p["entity"].to_numpy(), p["shard"].to_numpy()
        out = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            s, e = _union_runs(lo[a:b], hi[a:b])
            base = int(shard[a]) * SHARD
            out.append((entity[a], shard[a], base + s[0], base + e[0], base + s[-1], base + e[-1], len(s), pack_runs(s, e)))
        return pd.DataFrame(out, columns=["entity", "shard", "first", "head_end", "tail_start", "last", "runs", "bitmap"])

    for p in batches:
        if rest is not None:
            p = pd.concat([rest, p], ignore_index=True)
        if not len(p):
            continue
        entity, shard = p["entity"].to_numpy(), p["shard"].to_numpy()
        cuts = np.r_[0, np.flatnonzero((entity[1:] != entity[:-1]) | (shard[1:] != shard[:-1])) + 1]
        s, e = _union_runs(p["lo"].to_numpy(np.int64)[cuts[-1] :], p["hi"].to_numpy(np.int64)[cuts[-1] :])
        rest = pd.DataFrame({"entity": [entity[-1]] * len(s), "shard": [shard[-1]] * len(s), "lo": s, "hi": e})
        if len(cuts) > 1:
            yield rows(p.iloc[: cuts[-1]], cuts)
    if rest is not None and len(rest):
        yield rows(rest, np.array([0, len(rest)]))


def run_bitmaps(intervals: DataFrame) -> DataFrame:
    """The union bitmap of each (entity, shard) of ``intervals`` (entity, start, end).

    Two shuffles: a partial aggregation to the longest run per first unit (map-side combine, so a hot entity or a
    hot shard shrinks to at most SHARD rows before it is gathered), then one by (entity, shard).
    """
    reduced = sliced(intervals).groupBy("entity", "shard", "lo").agg(F.max("hi").alias("hi"))
    together = reduced.repartition("entity", "shard").sortWithinPartitions("entity", "shard", "lo")
    return together.select("entity", "shard", "lo", "hi").mapInPandas(_build, BITMAP_SCHEMA)


def _inner(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Set runs that touch no shard edge, and the clear runs between set runs."""
    for p in batches:
        entities, kinds, starts, ends = [], [], [], []
        for entity, shard, bitmap in zip(p["entity"], p["shard"], p["bitmap"]):
            s, e = unpack_runs(bitmap)
            base = int(shard) * SHARD
            inner = (s > 0) & (e < SHARD)
            n, g = int(inner.sum()), len(s) - 1
            entities += [entity] * (n + g)
            kinds += ["period"] * n + ["gap"] * g
            starts += [s[inner] + base, e[:-1] + base]
            ends += [e[inner] + base, s[1:] + base]
        if entities:
            yield pd.DataFrame({"entity": entities, "kind": kinds, "start": np.concatenate(starts), "end": np.concatenate(ends)})


def periods_and_gaps(bitmaps: DataFrame) -> DataFrame:
    """(entity, kind, start, end): maximal set runs ('period') and the clear runs between two of them ('gap').

    Most rows come from a bitmap alone. Only runs that touch a shard edge are stitched, in a window per entity
    over at most two rows a shard: its size follows the time an entity spans, never the number of its intervals.
    The bitmaps feed three branches, so they are built once and checkpointed.
    """
    bitmaps = checkpointed(bitmaps)
    inner = bitmaps.select("entity", "shard", "bitmap").mapInPandas(_inner, "entity string, kind string, start long, end long")
    edge = bitmaps.drop("bitmap")
    base, stop = F.col("shard") * SHARD, (F.col("shard") + 1) * SHARD
    w = Window.partitionBy("entity").orderBy("shard")
    spans = edge.withColumn("before", F.lag("last").over(w))
    between = spans.where("first > before").select("entity", F.lit("gap").alias("kind"), F.col("before").alias("start"), F.col("first").alias("end"))
    head = F.when(F.col("first") == base, F.struct(F.col("first").alias("start"), F.col("head_end").alias("end")))
    tail = F.when((F.col("last") == stop) & ((F.col("runs") > 1) | (F.col("first") != base)), F.struct(F.col("tail_start").alias("start"), F.col("last").alias("end")))
    pieces = edge.select("entity", F.explode(F.filter(F.array(head, tail), lambda x: x.isNotNull())).alias("p")).select("entity", "p.start", "p.end")
    by_start = Window.partitionBy("entity").orderBy("start")
    island = F.sum(F.when(F.col("start") == F.col("touch"), 0).otherwise(1)).over(by_start.rowsBetween(Window.unboundedPreceding, 0))
    stitched = (
        pieces.withColumn("touch", F.lag("end").over(by_start))
        .withColumn("island", island)
        .groupBy("entity", "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .select("entity", F.lit("period").alias("kind"), "start", "end")
    )
    return inner.unionByName(between).unionByName(stitched)


def active_counts(intervals: DataFrame) -> DataFrame:
    """(entity, covered, overlapped): units in which at least one, and at least two, intervals are active.

    A sweep inside each (entity, shard): the counts of starts and ends per unit are summed map-side first.
    """
    deltas = sliced(intervals).select("entity", "shard", F.explode(F.array(F.struct(F.col("lo").alias("t"), F.lit(1).alias("d")), F.struct(F.col("hi").alias("t"), F.lit(-1).alias("d")))).alias("x"))
    steps = deltas.groupBy("entity", "shard", F.col("x.t").alias("t")).agg(F.sum("x.d").alias("d"))
    w = Window.partitionBy("entity", "shard").orderBy("t")
    spans = steps.select("entity", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("active"), (F.lead("t").over(w) - F.col("t")).alias("length"))
    return spans.groupBy("entity").agg(
        F.coalesce(F.sum(F.when(F.col("active") >= 1, F.col("length"))), F.lit(0)).cast("long").alias("covered"),
        F.coalesce(F.sum(F.when(F.col("active") >= 2, F.col("length"))), F.lit(0)).cast("long").alias("overlapped"),
    )
