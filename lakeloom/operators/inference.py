"""Resampling, selection rules, folds and fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.draws import u
from lakeloom.operators.aggregates import let
from lakeloom.operators.ordering import quantiles


# The distribution function of a Poisson variable of mean 1, up to all 52 bits of a draw but 2e-13.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253, 0.999998874797402, 0.9999998885745217, 0.9999999899522336, 0.9999999991683892, 0.9999999999364022, 0.9999999999954802, 0.9999999999997)


def paired_bootstrap(units: DataFrame, draws: int, seed: int, strata: list[str] = [], key: str = "key") -> DataFrame:
    """(key, diff, n) -> (difference, low, high): the sum of differences by the sum of units over resampled keys.

    Each draw takes each key as often as a Poisson variable of mean 1 of a hash of draw and key says: the bootstrap of a
    table of any size in one pass, summed map-side, without ranks or a join. With ``strata`` the rates are averaged over
    strata. A draw in which no unit is taken has no rate.
    """
    drawn = units.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    # The draw is computed once a row, and no filter is pushed down that would compute it again.
    times = let(u(seed, "boot", *strata, "draw", key), lambda x: sum(((x >= F.lit(p)).cast("int") for p in POISSON), F.lit(0)))
    drawn = drawn.withColumn("times", times)
    rates = drawn.groupBy("draw", *strata).agg(F.try_divide(F.sum(F.col("times") * F.col("diff")), F.sum(F.col("times") * F.col("n"))).alias("r")).groupBy("draw").agg(F.avg("r").alias("r"))
    point = units.groupBy(*strata).agg((F.sum("diff") / F.sum("n")).alias("r")).agg(F.avg("r").alias("difference"))
    return point.crossJoin(rates.agg(F.percentile("r", 0.025).alias("low"), F.percentile("r", 0.975).alias("high")))


def decide(steps: DataFrame, tolerance: float, patience: int, smoothing: int) -> DataFrame:
    """(step, target, retention) rows with a baseline at the least step -> (step, eligible, stop, smooth).

    Eligible while retention stays within the baseline plus ``tolerance``; stop once the last ``patience`` rows all fail;
    ``smooth`` is the mean target of ``smoothing`` consecutive eligible rows that end here.
    """
    w = Window.orderBy("step")
    base = F.first("retention").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    e = steps.withColumn("eligible", F.col("retention") <= base + tolerance)
    last = w.rowsBetween(-(patience - 1), 0)
    run = w.rowsBetween(-(smoothing - 1), 0)
    return e.select(
        "step",
        "eligible",
        ((F.count("*").over(last) == patience) & (F.max(F.col("eligible").cast("int")).over(last) == 0)).alias("stop"),
        F.when((F.count("*").over(run) == smoothing) & (F.min(F.col("eligible").cast("int")).over(run) == 1), F.avg("target").over(run)).alias("smooth"),
    )


def threshold_sweep(rows: DataFrame, positive: Column, score: Column, rates: list[float]) -> DataFrame:
    """(rate, threshold, caught): thresholds at fixed rejection rates of positives, and the share of negatives below."""
    cuts = quantiles(rows.where(positive).select(score.alias("score")), [], "score", rates).select(F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), F.col(f"q{i}").alias("threshold")) for i, r in enumerate(rates)])).alias("c")).select("c.*")
    j = rows.where(~positive).select(score.alias("score")).crossJoin(F.broadcast(cuts))
    return j.groupBy("rate", "threshold").agg(F.avg((F.col("score") < F.col("threshold")).cast("double")).alias("caught"))


def half_split_fit(rows: DataFrame, group: str, x: str, y: str, half: Column) -> DataFrame:
    """(group, slope, intercept, error): lines fitted on the first half of each group, the global line where a group has
    no slope, and the mean absolute error on the second half."""
    first = rows.where(half)
    own = first.groupBy(group).agg(F.regr_slope(y, x).alias("s"), F.regr_intercept(y, x).alias("i"))
    whole = first.agg(F.regr_slope(y, x).alias("gs"), F.regr_intercept(y, x).alias("gi"))
    rest = rows.where(~half).join(own, group, "left").crossJoin(F.broadcast(whole))
    slope, intercept = F.coalesce("s", "gs"), F.when(F.col("s").isNotNull(), F.col("i")).otherwise(F.col("gi"))
    return rest.groupBy(group).agg(F.max(slope).alias("slope"), F.max(intercept).alias("intercept"), F.avg(F.abs(F.col(y) - (slope * F.col(x) + intercept))).alias("error"))


def fitted_probe(rows: DataFrame, features: list[str], label: str, fold: str, folds: int) -> DataFrame:
    """Out-of-fold scores (id, label, score) of a balanced, standardized, L2-regularized logistic model per fold."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    out = None
    for k in range(folds):
        train = rows.where(F.col(fold) != k)
        share = train.agg(F.avg(F.col(label).cast("double"))).first()[0]
        weighted = train.withColumn("w", F.when(F.col(label) == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9)))
        stages = [VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), LogisticRegression(featuresCol="x", labelCol=label, weightCol="w", regParam=0.01, maxIter=20)]
        scored = Pipeline(stages=stages).fit(weighted).transform(rows.where(F.col(fold) == k)).select("id", label, vector_to_array("probability")[1].alias("score"))
        out = scored if out is None else out.unionByName(scored)
    return out
