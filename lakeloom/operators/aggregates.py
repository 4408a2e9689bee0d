"""Scores and statistics: pooled, macro and weighted rates, rank statistics, shares, digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.ordering import ordered_positions, sums_before
from lakeloom.session import broadcast_within


def rate(errors: Column, units: Column) -> Column:
    """Pooled rate: the sum of errors by the sum of units; null without units."""
    return F.try_divide(F.sum(errors).cast("double"), F.sum(units).cast("double"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Over rows that have both."""
    both = value.isNotNull() & weight.isNotNull()
    return F.try_divide(F.sum(F.when(both, value * weight)), F.sum(F.when(both, weight)))


def macro(rows: DataFrame, cells: list[str], groups: list[str], value: Column, name: str = "macro") -> DataFrame:
    """The plain mean over cells of a value per cell; null cells don't count."""
    return rows.groupBy(*groups, *cells).agg(value.alias("cell")).groupBy(*groups).agg(F.avg("cell").alias(name))


def one_method(method: Column) -> Column:
    """Whether all rows were scored by one method; different ones can't be pooled."""
    return F.count_distinct(method) <= 1


def precision_recall(matched: Column, predicted: Column, reference: Column) -> list[Column]:
    """Precision, recall and F1 of summed counts; each null where undefined."""
    m, p, r = F.sum(matched).cast("double"), F.sum(predicted), F.sum(reference)
    return [F.try_divide(m, p).alias("precision"), F.try_divide(m, r).alias("recall"), F.try_divide(2 * m, p + r).alias("f1")]


def edge_bucket(value: Column, edges: list[float]) -> Column:
    """``<e`` for the first edge above the value, ``>=last`` beyond; null for null."""
    out = F.lit(f">={edges[-1]:g}")
    for e in reversed(edges):
        out = F.when(value < e, F.lit(f"<{e:g}")).otherwise(out)
    return F.when(value.isNotNull(), out)


def nearest_rank(rows: DataFrame, groups: list[str], value: str, q: float, tie: list[str] = []) -> DataFrame:
    """The value at rank round(q * (n - 1)), half to even, without gathering a group: rows are numbered by range partitions."""
    ranked = ordered_positions(rows.where(F.col(value).isNotNull()).select(*groups, value, *tie), groups, [value, *tie], "_rn")
    sizes = ranked.groupBy(*[F.col(g).alias(f"_s{i}") for i, g in enumerate(groups)]).agg(F.count("*").alias("_n"))
    on = F.lit(True)
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"_s{i}"))
    j = ranked.join(broadcast_within(sizes), on) if groups else ranked.crossJoin(F.broadcast(sizes))
    return j.where(F.col("_rn") == F.bround(F.lit(q) * (F.col("_n") - 1)).cast("long")).select(*groups, F.col(value).alias("at_rank"))


def spread(value: Column) -> list[Column]:
    return [F.min(value).alias("lowest"), F.max(value).alias("highest"), (F.max(value) - F.min(value)).alias("range"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")]


def auc(rows: DataFrame, groups: list[str], positive: Column, score: Column) -> DataFrame:
    """P(score of a positive > of a negative), ties half; null where a side is empty.

    Ranks come from counts per distinct score, summed over range partitions, so a group's scores are in no one task. A
    null group counts as a group of its own.
    """
    per = rows.where(score.isNotNull() & positive.isNotNull()).groupBy(*groups, score.alias("score")).agg(F.sum(positive.cast("long")).alias("p"), F.sum((~positive).cast("long")).alias("n"))
    keys = [f"_g{i}" for i in range(len(groups))]
    keyed = per.select(*groups, *[F.coalesce(F.col(g).cast("string"), F.lit("\0")).alias(k) for g, k in zip(groups, keys)], "score", "p", "n")
    per = sums_before(keyed, keys, "score", "n", "below").drop(*keys)
    return per.withColumn("won", F.col("p") * (F.col("below") + F.col("n") * 0.5)).groupBy(*groups).agg(F.try_divide(F.sum("won"), (F.sum("p") * F.sum("n")).cast("double")).alias("auc"))


def share_distance(rows: DataFrame, group: str, label: str) -> DataFrame:
    """Half the sum of absolute differences between each group's label shares and the shares over all rows."""
    local = rows.groupBy(group, label).agg(F.count("*").alias("n"))
    sizes = local.groupBy(group).agg(F.sum("n").alias("size"))
    overall = local.groupBy(label).agg(F.sum("n").alias("all_n"))
    total = overall.agg(F.sum("all_n").alias("total"))
    shared = local.join(sizes, group).join(overall, label).crossJoin(F.broadcast(total))
    p, q = F.col("n") / F.col("size"), F.col("all_n") / F.col("total")
    # Labels a group lacks add their whole overall share: 1 - the sum of q over the labels it has.
    return shared.groupBy(group).agg((0.5 * (F.sum(F.abs(p - q)) + 1 - F.sum(q))).alias("distance"))


def common_subset(rows: DataFrame, id_col: str, run_col: str, ok: Column) -> DataFrame:
    """Ids that are present and ``ok`` in every run."""
    runs = rows.select(run_col).distinct().agg(F.count("*").alias("runs"))
    per = rows.groupBy(id_col).agg(F.count_distinct(run_col).alias("seen"), F.min(ok.cast("int")).alias("all_ok"))
    return per.crossJoin(F.broadcast(runs)).where("seen = runs and all_ok = 1").select(id_col)


def transitions(base: DataFrame, other: DataFrame, key: str, flag: str) -> DataFrame:
    """Rows flagged in both runs, introduced, fixed, or in neither; a missing row isn't flagged."""
    j = base.select(key, F.col(flag).alias("a")).join(other.select(key, F.col(flag).alias("b")), key, "full")
    a, b = F.coalesce("a", F.lit(False)), F.coalesce("b", F.lit(False))
    kind = F.when(a & b, "kept").when(b, "introduced").when(a, "fixed").otherwise("clean")
    return j.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def content_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Count, xor and sum of row hashes: equal for equal rows in any order and partitioning."""
    h = F.xxhash64(*columns)
    return rows.agg(F.count("*").alias("rows"), F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(38,0)")).alias("total"))


def portable_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Count, xor and sum of the first 60 bits of each row's SHA-256: the same in any engine, order and partitioning."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns])
    h = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")
    return rows.agg(F.count("*").alias("rows"), F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("total"))


def list_digest(items: Column) -> Column:
    """SHA-256 of a list in its order."""
    return F.sha2(F.concat_ws(",", items), 256)


def first_match(value: Column, families: list[tuple[str, str]], other: str = "other") -> Column:
    """The name of the first pattern that matches."""
    return reduce(lambda out, f: F.when(value.rlike(f[1]), F.lit(f[0])).otherwise(out), reversed(families), F.lit(other))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; inside lambdas Spark would compute it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
