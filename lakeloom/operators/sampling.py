"""Draw plans: caps, rotation, weighted interleaving, replay windows, batches and their resumable order.

Positions are arithmetic on stable row numbers, so a plan is a function of (seed, epoch) and needs no state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.draws import hash_order, u
from lakeloom.operators.ordering import ordered_positions
from lakeloom.session import broadcast_within


def numbered(rows: DataFrame, source: str, order: list) -> DataFrame:
    """With ``ix``, each row's number in its source, and ``n``, the source's size."""
    sizes = broadcast_within(rows.groupBy(source).agg(F.count("*").alias("n")))
    return ordered_positions(rows, [source], order).join(sizes, source)


def rotated(rows: DataFrame, samples: Column, reps: Column, epoch: int) -> DataFrame:
    """Of each source (columns ix, n) the ``samples`` rows that are due in an epoch, ``reps`` times.

    The start moves by ``samples`` an epoch and wraps; without ``samples`` all rows are due.
    """
    cap = F.least(F.coalesce(samples, F.col("n")), F.col("n"))
    shards = F.ceil(F.col("n") / cap)
    start = F.pmod(F.lit(epoch), shards) * cap
    due = rows.where(F.pmod(F.col("ix") - start, F.col("n")) < cap)
    return due.withColumn("rep", F.explode(F.sequence(F.lit(1), reps)))


def interleaved(rows: DataFrame, source: str, weight: Column, seed: int, key: str) -> DataFrame:
    """All rows, with ``at``: sources advance in hash order at rates in proportion to their weights.

    The k-th row of a source comes at (k + u) / weight. Every row is drawn once; a source that is exhausted leaves.
    """
    k = ordered_positions(rows, [source], [hash_order(seed, "mux", F.col(key)), F.col(key)], "k")
    return k.withColumn("at", (F.col("k") + u(seed, "mux-time", F.col(key))) / weight).drop("k")


def replay_positions(quotas: DataFrame, windows: int, epoch: int, full: bool = False) -> DataFrame:
    """(source, quota, n) -> (source, draw, window, cycle, offset) of one epoch.

    A source walks permutations of its rows without replacement, across epochs; ``full`` starts each epoch on a fresh one.
    """
    per = F.col("quota") * windows
    start = F.lit(epoch) * (F.ceil(per / F.col("n")) * F.col("n") if full else per)
    draws = quotas.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), (per - 1).cast("long")))).withColumn("position", start + F.col("draw"))
    return draws.select("source", "draw", F.floor(F.col("draw") / F.col("quota")).alias("window"), F.floor(F.col("position") / F.col("n")).alias("cycle"), F.pmod("position", F.col("n")).alias("offset"))


def replayed(positions: DataFrame, rows: DataFrame, source: str, key: str, seed: int) -> DataFrame:
    """The row at each position: the offset-th of its source in the hash order of the cycle."""
    cycles = positions.select("source", "cycle").distinct()
    shuffled = cycles.join(rows.select(F.col(source).alias("source"), key), "source")
    order = ordered_positions(shuffled, ["source", "cycle"], [hash_order(seed, "replay", F.col("cycle"), F.col(key)), F.col(key)], "offset")
    return positions.join(order, ["source", "cycle", "offset"])


def full_coverage_windows(quotas: DataFrame) -> DataFrame:
    return quotas.agg(F.max(F.ceil(F.col("n") / F.col("quota"))).alias("windows"))


def duration_bin(cost: Column, longest: Column, bins: int) -> Column:
    return F.least(F.lit(bins - 1), F.floor(cost / (longest / bins))).cast("int")


def _greedy(padded: bool, max_cost: float, max_samples: int):
    def cut(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["cost", "id"] if padded else ["at", "id"])
        batch, n, total, out = 0, 0, 0.0, []
        for c in p["cost"]:
            size = c * (n + 1) if padded else total + c
            if n and (n >= max_samples or size > max_cost):
                batch, n, total = batch + 1, 0, 0.0
            n, total = n + 1, total + c
            out.append(batch)
        return p.assign(batch=out)[["id", "slots", "buffer", "bin", "cost", "batch"]]

    return cut


BATCH_SCHEMA = "id string, slots int, buffer long, bin int, cost double, batch int"


def bucket_batches(rows: DataFrame, buffer_size: int, bins: int, max_cost: float, max_samples: int) -> DataFrame:
    """(id, at, slots, cost) -> batches of one slot count and duration bin, closed in arrival order.

    Buckets are formed inside each buffer of ``buffer_size`` draws, which bounds the group a task sees.
    """
    numbered_rows = ordered_positions(rows, ["slots"], ["at", "id"]).withColumn("buffer", F.floor(F.col("ix") / buffer_size))
    longest = rows.agg(F.max("cost").alias("longest"))
    binned = numbered_rows.crossJoin(F.broadcast(longest)).withColumn("bin", duration_bin(F.col("cost"), F.col("longest"), bins))
    return binned.select("id", "at", "slots", "buffer", "bin", "cost").groupBy("slots", "buffer", "bin").applyInPandas(_greedy(False, max_cost, max_samples), BATCH_SCHEMA)


def sorted_batches(rows: DataFrame, window: int, max_cost: float, max_samples: int) -> DataFrame:
    """(id, at, slots, cost) -> batches of ascending cost within windows of ``window`` draws; the padded size, cost of the
    longest times number, stays within ``max_cost``. One row over it is a batch of its own."""
    placed = ordered_positions(rows, ["slots"], ["at", "id"]).withColumn("buffer", F.floor(F.col("ix") / window)).withColumn("bin", F.lit(0))
    return placed.select("id", "at", "slots", "buffer", "bin", "cost").groupBy("slots", "buffer").applyInPandas(_greedy(True, max_cost, max_samples), BATCH_SCHEMA)


def balanced_updates(batches: DataFrame, world_size: int, accumulation: int, seed: int) -> DataFrame:
    """(batch_id, n, longest) -> (batch_id, update, row, rank, position): batches by padded size in groups of
    ``world_size * accumulation``, odd rows of complete groups reversed, groups in hash order."""
    size = world_size * accumulation
    p = ordered_positions(batches, [], [F.round(F.col("n") * F.col("longest"), 9), F.col("batch_id")], "k").withColumn("update", F.floor(F.col("k") / size)).withColumn("in_group", F.pmod("k", F.lit(size)))
    whole = F.count("*").over(Window.partitionBy("update")) == size
    row = F.floor(F.col("in_group") / world_size)
    column = F.pmod("in_group", F.lit(world_size))
    p = p.withColumn("whole", whole).withColumn("row", row).withColumn("rank", F.when(F.col("whole") & (row % 2 == 1), world_size - 1 - column).otherwise(column))
    shuffled = ordered_positions(p.select("update").distinct(), [], [hash_order(seed, "groups", F.col("update"))], "place")
    return p.join(shuffled, "update").select("batch_id", "place", "row", "rank")


def with_tail(batches: DataFrame, world_size: int, drop_last: bool) -> DataFrame:
    """(position, …): a multiple of ``world_size`` of batches, the last ones dropped or the first repeated."""
    total = batches.agg(F.count("*").alias("total"))
    b = batches.crossJoin(F.broadcast(total))
    rest = F.pmod("total", F.lit(world_size))
    if drop_last:
        return b.where(F.col("position") < F.col("total") - rest).drop("total")
    need = F.when(rest > 0, world_size - rest).otherwise(0)
    copies = F.floor((need - F.col("position") - 1) / F.col("total")) + 1
    more = b.where(F.col("position") < need).withColumn("position", F.explode(F.transform(F.sequence(F.lit(1), copies), lambda c: F.col("total") + F.col("position") + (c - 1) * F.col("total"))))
    return b.drop("total").unionByName(more.drop("total"))


def of_rank(batches: DataFrame, rank: int, world_size: int) -> DataFrame:
    return batches.where(F.pmod("position", F.lit(world_size)) == rank)


def in_hash_order(rows: DataFrame, key: str) -> DataFrame:
    """Rows with ``position`` in the order of their key's SHA-256."""
    return ordered_positions(rows, [], [F.sha2(F.col(key).cast("string"), 256), F.col(key)], "position")


def resumed(batches: DataFrame, consumed: int) -> DataFrame:
    """The plan from a cursor on."""
    return batches.where(F.col("position") >= consumed)


def migrated_cursor(consumed: int, old_world: int, new_world: int) -> int:
    """Micro-batches each rank of a new world has behind it; an error if they don't divide."""
    planned = consumed * old_world
    if planned % new_world:
        raise ValueError(f"{planned} planned batches can't be split over {new_world} ranks")
    return planned // new_world


def advance_cursor(epoch: int, consumed: int, length: int, signature: str, saved: str) -> tuple[int, int]:
    """(epoch, consumed) to go on from; a finished epoch leads to the next, another plan is an error."""
    if signature != saved:
        raise ValueError("the cursor belongs to another plan")
    return (epoch + 1, 0) if consumed >= length else (epoch, consumed)


def hotword_list(rows: DataFrame, pool: DataFrame, seed: int, prompt: float, miss: float, most: int) -> DataFrame:
    """(id, pool, hotwords) and (pool, word) -> (id, offered): with probability ``prompt`` the real words, each missed with
    ``miss``, and up to a drawn number of others, in hash order; else ``N/A``.

    Others are drawn by number in the sorted pool, so a record meets only the words it draws, however large the pool.
    """
    words = ordered_positions(pool.where("word is not null").distinct(), ["pool"], ["word"])
    sizes = words.groupBy("pool").agg(F.count("*").alias("size"))
    own = F.filter(F.array_distinct("hotwords"), lambda w: w.isNotNull())
    kept = F.filter("own", lambda w: u(seed, "miss", F.col("id"), w) >= miss)
    x = rows.withColumn("own", own).withColumn("kept", kept)
    count = F.floor(u(seed, "count", F.col("id")) * (F.greatest(F.lit(most) - F.size("kept"), F.lit(0)) + 1)).cast("int")
    tries = x.join(broadcast_within(sizes), "pool").where(count > 0).select("id", "pool", "own", "size", F.explode(F.sequence(F.lit(0), count - 1)).alias("j"))
    tries = tries.select("id", "pool", "own", F.floor(u(seed, "distract", "id", "j") * F.col("size")).cast("long").alias("ix"))
    drawn = tries.join(words.select("pool", "ix", "word"), ["pool", "ix"]).where(~F.array_contains("own", F.col("word"))).groupBy("id").agg(F.collect_set("word").alias("drawn"))
    j = x.join(drawn, "id", "left").withColumn("every", F.concat("kept", F.coalesce("drawn", F.array().cast("array<string>"))))
    shuffled = F.array_sort(F.transform("every", lambda w: F.struct(u(seed, "shuffle", F.col("id"), w).alias("r"), w.alias("w"))))
    said = F.array_join(F.transform(shuffled, lambda s: s["w"]), ", ")
    return j.select("id", F.when((u(seed, "prompt", F.col("id")) < prompt) & (said != ""), said).otherwise("N/A").alias("offered"))


def merged_batches(batches: DataFrame, key: str, longest: Column, order: Column, merge: int, window: int) -> DataFrame:
    """(key, step, place): batches in order, ``merge`` at a time as one step. Within windows of ``window`` batches, a
    multiple of ``merge``, those of similar longest duration are paired, so every window keeps its batches.

    Positions come from range partitions; a window is one small group.
    """
    if window % merge:
        raise ValueError("a window must hold whole steps")
    at = ordered_positions(batches.select(F.col(key), longest.alias("_longest"), order.alias("_order")), [], ["_order"]).withColumn("_window", F.floor(F.col("ix") / window))
    i = F.row_number().over(Window.partitionBy("_window").orderBy("_longest", "ix")) - 1
    return at.withColumn("_i", i).select(key, (F.col("_window") * (window // merge) + F.floor(F.col("_i") / merge)).alias("step"), F.pmod("_i", F.lit(merge)).alias("place"))
