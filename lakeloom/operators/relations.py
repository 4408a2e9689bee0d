"""Joins with checks, keyed lookups and set comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.ordering import ordered_positions


def salted_join(big: DataFrame, small: DataFrame, on: list[str], spread: list[str], salts: int = 8, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small``, the rows of each key spread by the hash of ``spread`` over ``salts`` tasks, so that a
    key with a third of all rows makes no task of that size; ``small`` is copied to each. Inner or left join."""
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def one_to_one(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, in_a, in_b): keys that aren't exactly once on both sides; no row if the tables match."""
    x = a.groupBy(key).agg(F.count("*").alias("in_a"))
    y = b.groupBy(key).agg(F.count("*").alias("in_b"))
    return x.join(y, key, "full").select(key, F.coalesce("in_a", F.lit(0)).alias("in_a"), F.coalesce("in_b", F.lit(0)).alias("in_b")).where("in_a <> 1 or in_b <> 1")


def paired(a: DataFrame, b: DataFrame, key: str, value: str, ok: str, same_keys: bool = False) -> DataFrame:
    """(key, value_a, value_b) of keys that succeeded (``ok``) on both sides. With ``same_keys`` keys that only one side has, or
    that repeat on one, are an error that names some; otherwise they drop out."""
    if same_keys:
        odd = [tuple(r) for r in one_to_one(a, b, key).limit(5).collect()]
        if odd:
            raise ValueError(f"keys (key, in a, in b) that don't match one to one: {odd}")
    x = a.where(ok).select(key, F.col(value).alias(f"{value}_a"))
    return x.join(b.where(ok).select(key, F.col(value).alias(f"{value}_b")), key)


def slots_located(records: DataFrame, index: DataFrame) -> DataFrame:
    """(id, pos, name, cut_id, duration, missing) of each slot, with its cut's duration where the slot gives none."""
    slots = records.select("id", F.posexplode("audio_slots").alias("pos", "slot")).select("id", "pos", "slot.name", "slot.ref.cut_id", F.col("slot.ref.duration").alias("own"))
    known = index.select("cut_id", F.col("duration").alias("cut_s"), F.lit(True).alias("known"))
    return slots.join(known, "cut_id", "left").select("id", "pos", "name", "cut_id", F.coalesce("own", "cut_s").alias("duration"), F.col("known").isNull().alias("missing"))


def equality_report(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(column, differing): how many rows with one key differ null-safely in each column."""
    j = a.select(key, *[F.col(c).alias(f"a_{c}") for c in columns]).join(b.select(key, *[F.col(c).alias(f"b_{c}") for c in columns]), key)
    sums = j.agg(*[F.sum((~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).cast("long")).alias(c) for c in columns])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(0)).alias("differing")) for c in columns])).alias("x")).select("x.*")


def checked_lookup(asked: DataFrame, rows: DataFrame, key: str, named: int = 10) -> DataFrame:
    """The rows of the asked keys, each once however often it is asked; keys without a row are an error that names the
    first few."""
    keys = asked.select(key).distinct()
    gone = [r[0] for r in keys.join(rows.select(key), key, "left_anti").orderBy(key).limit(named).collect()]
    if gone:
        raise KeyError(f"no row for {gone}")
    return rows.join(keys, key, "left_semi")


def in_ranges(points: DataFrame, ranges: DataFrame, at: str) -> DataFrame:
    """Rows with the range [start, stop) that holds their ``at``; ranges are one row per source, so they are bounded."""
    return points.join(F.broadcast(ranges), (F.col(at) >= F.col("start")) & (F.col(at) < F.col("stop")))


def roots(parents: DataFrame, child: str, parent: str, depth: int = 20) -> DataFrame:
    """(child, root, steps, cyclic) by following parent pointers; a chain longer than ``depth`` is a cycle."""
    edges = parents.select(F.col(child).alias("c"), F.col(parent).alias("p"))
    now = edges.select(F.col("c").alias(child), F.col("c").alias("root"), F.col("p").alias("up"), F.lit(0).alias("steps"))
    for _ in range(depth):
        if now.where("up is not null").limit(1).count() == 0:
            break
        step = now.join(edges.select(F.col("c").alias("up"), F.col("p").alias("next"), F.lit(True).alias("known")), "up", "left")
        now = step.select(child, F.coalesce("up", "root").alias("root"), "next", F.when(F.col("up").isNotNull(), F.col("steps") + 1).otherwise(F.col("steps")).alias("steps")).withColumnRenamed("next", "up")
    return now.select(child, "root", "steps", F.col("up").isNotNull().alias("cyclic"))


def last_write(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the last by ``order``."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("row")).select(key, "row.*")


def shards(rows: DataFrame, unit: str, seed: int, epoch: int, count: int) -> DataFrame:
    """(unit, shard): units of storage shuffled by seed and epoch and dealt to ``count`` readers in turn, numbered by range
    partitions of their hash."""
    units = rows.select(unit).distinct()
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.col(unit).cast("string")), 256)
    return ordered_positions(units.withColumn("_order", order), [], ["_order"]).select(unit, F.pmod("ix", F.lit(count)).cast("int").alias("shard"))
