"""Row numbers in a total order without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.session import broadcast_within, checkpointed

IN_PARTITION = (1 << 33) - 1


def ordered_positions(rows: DataFrame, groups: list[str], order: list[Column | str], name: str = "ix") -> DataFrame:
    """Rows with ``name``, their number from 0 in the order within their group. ``order`` must be total.

    Rows are range-partitioned by group and order and sorted there; a row's place in its partition, less the first place
    of its group there, plus the rows of the group in partitions before, is its number. Only counts per partition and
    group are summed, so a hot group is spread over as many partitions as it needs.
    """
    by = [F.col(o) if isinstance(o, str) else o for o in order]
    keys = [F.col(g) for g in groups]
    placed = rows.repartitionByRange(*keys, *by).sortWithinPartitions(*keys, *by)
    placed = checkpointed(placed.withColumn("_pid", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(IN_PARTITION)))
    g = [F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(f"_g{i}") for i, c in enumerate(groups)]
    names = [f"_g{i}" for i in range(len(groups))]
    counts = placed.groupBy(*g, "_pid").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    w = Window.partitionBy(*names).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*names, F.col("_pid").alias("_p"), (F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_first")).alias("_offset"))
    on = F.col("_pid") == F.col("_p")
    for i, c in enumerate(groups):
        on = on & (F.coalesce(F.col(c).cast("string"), F.lit("\0")) == F.col(f"_g{i}"))
    return placed.join(broadcast_within(offsets), on).withColumn(name, F.col("_at") + F.col("_offset")).drop("_pid", "_at", "_p", "_offset", *names)


def sums_before(rows: DataFrame, groups: list[str], order: str, value: str, name: str) -> DataFrame:
    """Rows with ``name``, the sum of ``value`` over those of their group that come before in the order, which must be total.

    As in ``ordered_positions`` rows are range-partitioned; sums run within a partition and start from the sums of those
    before, so a hot group is spread. Groups' values must not be null.
    """
    placed = rows.repartitionByRange(*groups, order).withColumn("_pid", F.spark_partition_id())
    placed = checkpointed(placed)
    per = placed.groupBy(*groups, "_pid").agg(F.sum(value).alias("_sum"))
    w = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select(*groups, "_pid", F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*groups, "_pid").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(broadcast_within(base), [*groups, "_pid"]).withColumn(name, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_pid", "_base")


def quantiles(rows: DataFrame, groups: list[str], value: str, at: list[float]) -> DataFrame:
    """(groups, q0, q1, …): interpolated quantiles of the values that aren't null; a group without any has no row.

    Values are numbered in range partitions, so no group's values are gathered; only the two rows beside each quantile
    are looked at.
    """
    placed = ordered_positions(rows.select(*groups, F.col(value).cast("double").alias("_value")).where("_value is not null"), groups, ["_value"], "_ix")
    sizes = placed.groupBy(*[F.col(g).alias(f"_s{i}") for i, g in enumerate(groups)]).agg(F.count("*").alias("_size"))
    on = F.lit(True)
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"_s{i}"))
    j = placed.join(broadcast_within(sizes), on) if groups else placed.crossJoin(F.broadcast(sizes))
    spot = [F.lit(q) * (F.col("_size") - 1) for q in at]
    beside = [x for s in spot for x in (F.floor(s), F.ceil(s))]
    near = j.where(F.array_contains(F.array(*beside), F.col("_ix")))
    out = []
    for i, s in enumerate(spot):
        low, high = F.max(F.when(F.col("_ix") == F.floor(s), F.col("_value"))), F.max(F.when(F.col("_ix") == F.ceil(s), F.col("_value")))
        out.append((low + (high - low) * F.max(s - F.floor(s))).alias(f"q{i}"))
    return near.groupBy(*groups).agg(*out)
