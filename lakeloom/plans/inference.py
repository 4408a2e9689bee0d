"""Queries of resampling, decisions and fits, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.functions.draws import u_sql
from lakeloom.operators import inference as I
from lakeloom.operators.aggregates import auc, edge_bucket
from lakeloom.plans.views import RECORDS_SQL, TIMED_SQL, records, timed_records
from lakeloom.sources.tables import table


def _parts(spark, d, strata=False):
    l = table(spark, d, "lineitem")
    g = [F.col("l_linestatus")] if strata else []
    return l.groupBy(*g, F.col("l_suppkey").alias("key")).agg(F.round(F.sum((F.col("l_discount") - F.col("l_tax")) * F.col("l_quantity")), 6).alias("diff"), F.sum("l_quantity").alias("n"))


def window_bootstrap(spark, d):
    """200 draws over keys."""
    b = I.paired_bootstrap(_parts(spark, d), 200, 17)
    return b.select(*[F.round(c, 6).alias(c) for c in ("difference", "low", "high")])


def cluster_bootstrap(spark, d):
    """Q2: 100 draws over keys within each condition, rates averaged."""
    b = I.paired_bootstrap(_parts(spark, d, True), 100, 18, ["l_linestatus"])
    return b.select(*[F.round(c, 6).alias(c) for c in ("difference", "low", "high")])


def _steps(spark, d):
    o = table(spark, d, "orders").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("step")).agg(F.round(F.avg("o_totalprice"), 4).alias("target"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("double")), 6).alias("retention"))
    return o


def checkpoint_decision(spark, d):
    """Eligible months, stops and smoothed targets."""
    return I.decide(_steps(spark, d), 0.02, 3, 2).select("step", "eligible", "stop", F.round("smooth", 4).alias("smooth"))


def metric_by_spec(spark, d):
    """Q5, Q6: a metric by prefix, label and group, and its gap to all rows."""
    l = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    g = l.where(F.col("p_type").startswith("S")).groupBy("p_type").agg((F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity")).alias("rate"))
    whole = l.agg((F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity")).alias("all_rate"))
    return g.crossJoin(F.broadcast(whole)).select("p_type", F.round("rate", 6).alias("rate"), F.round(F.col("rate") - F.col("all_rate"), 6).alias("gap"))


def rejection_sweep(spark, d):
    """Q7: thresholds at 5, 10 and 20 % rejection."""
    s = I.threshold_sweep(table(spark, d, "lineitem"), F.col("l_returnflag") == "R", F.col("l_extendedprice"), [0.05, 0.1, 0.2])
    return s.select("rate", F.round("threshold", 4).alias("threshold"), F.round("caught", 6).alias("caught"))


def length_fit(spark, d):
    """Price by quantity fitted per flag on even orders, scored on odd ones."""
    f = I.half_split_fit(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice", F.col("l_orderkey") % 2 == 0)
    return f.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("error", 2).alias("error"))


def run_comparison(spark, d):
    """Two halves of the orders as two runs, month by month."""
    o = table(spark, d, "orders").withColumn("m", F.to_date(F.date_trunc("month", "o_orderdate")))
    a = o.where("o_orderkey % 2 = 0").groupBy("m").agg(F.avg("o_totalprice").alias("a"))
    b = o.where("o_orderkey % 2 = 1").groupBy("m").agg(F.avg("o_totalprice").alias("b"))
    return a.join(b, "m").agg(F.count("*").alias("steps"), F.round(F.avg("a") / F.avg("b"), 6).alias("mean_ratio"), F.round(F.median("a") / F.median("b"), 6).alias("median_ratio"), F.round(F.avg(F.abs(F.col("a") - F.col("b")) / F.col("b")), 6).alias("relative"))


def confusion_groups(spark, d):
    """Hits, misses, false alarms and rejects."""
    p, r = F.col("l_discount") > 0.05, F.col("l_tax") > 0.04
    kind = F.when(p & r, "hit").when(~p & r, "miss").when(p & ~r, "false_alarm").otherwise("reject")
    return table(spark, d, "lineitem").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def edge_buckets(spark, d):
    """E18."""
    return timed_records(spark, d).groupBy(edge_bucket(F.col("duration"), [2.0, 5.0, 10.0, 30.0]).alias("bucket")).agg(F.count("*").alias("n"))


def role_fit(spark, d):
    """Orders whose sorted quantities fit sorted budgets place by place."""
    q = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_quantity")).alias("q"))
    budget = F.array(*[F.lit(float(x)) for x in (10, 25, 40, 45, 50, 50, 50)])
    fits = F.forall(F.zip_with("q", F.slice(budget, F.lit(1), F.size("q")), lambda a, b: a <= b), lambda x: x)
    return q.where(F.size("q") <= 7).groupBy(fits.alias("fits")).agg(F.count("*").alias("n"))


def probe_auc(spark, d):
    """Out-of-fold area of a probe that tells expensive lines by quantity, discount and tax."""
    l = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), "l_quantity", "l_discount", "l_tax", (F.col("l_extendedprice") > 40000).cast("int").alias("y"))
    l = l.withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(3)))
    return auc(I.fitted_probe(l, ["l_quantity", "l_discount", "l_tax"], "y", "fold", 3).withColumn("g", F.lit("all")), ["g"], F.col("y") == 1, F.col("score")).select("g", F.round("auc", 3).alias("auc"))


QUERIES = {f.__name__: f for f in [window_bootstrap, cluster_bootstrap, checkpoint_decision, metric_by_spec, rejection_sweep, length_fit, run_comparison, confusion_groups, edge_buckets, role_fit, probe_auc]}

_PARTS = "p AS (SELECT {g} l_suppkey AS key, round(sum((l_discount - l_tax) * l_quantity), 6) AS diff, sum(l_quantity) AS n FROM lineitem GROUP BY ALL)"


def _boot(strata, draws, seed):
    g = "l_linestatus, " if strata else ""
    keys = ("l_linestatus",) if strata else ()
    times = " + ".join(f"(x >= {p!r})::INT" for p in I.POISSON)
    return f"""WITH {_PARTS.format(g=g)}, d AS (SELECT *, {u_sql(seed, 'boot', *keys, 'draw', 'key')} AS x FROM (SELECT *, unnest(range(0, {draws})) AS draw FROM p)), w AS (SELECT *, {times} AS times FROM d),
r AS (SELECT draw, avg(r) AS r FROM (SELECT {g} draw, sum(times * diff) / sum(times * n) AS r FROM w WHERE times > 0 GROUP BY ALL) GROUP BY draw),
o AS (SELECT avg(r) AS difference FROM (SELECT {g} sum(diff) / sum(n) AS r FROM p GROUP BY ALL))
SELECT round(any_value(o.difference), 6) AS difference, round(quantile_cont(r.r, 0.025), 6) AS low, round(quantile_cont(r.r, 0.975), 6) AS high FROM r, o"""


SQL = {
    "window_bootstrap": _boot(False, 200, 17),
    "cluster_bootstrap": _boot(True, 100, 18),
    "checkpoint_decision": """WITH s AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS step, round(avg(o_totalprice), 4) AS target, round(avg((o_orderstatus = 'F')::INT), 6) AS retention FROM orders GROUP BY ALL),
e AS (SELECT *, retention <= (SELECT arg_min(retention, step) FROM s) + 0.02 AS eligible FROM s)
SELECT step, eligible, count(*) OVER (ORDER BY step ROWS 2 PRECEDING) = 3 AND NOT bool_or(eligible) OVER (ORDER BY step ROWS 2 PRECEDING) AS stop, CASE WHEN count(*) OVER (ORDER BY step ROWS 1 PRECEDING) = 2 AND bool_and(eligible) OVER (ORDER BY step ROWS 1 PRECEDING) THEN round(avg(target) OVER (ORDER BY step ROWS 1 PRECEDING), 4) END AS smooth FROM e""",
    "metric_by_spec": "WITH l AS (SELECT l.*, p_type FROM lineitem l JOIN part ON p_partkey = l_partkey), w AS (SELECT sum(l_discount * l_quantity) / sum(l_quantity) AS a FROM l) SELECT p_type, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS rate, round(sum(l_discount * l_quantity) / sum(l_quantity) - any_value(a), 6) AS gap FROM l, w WHERE p_type LIKE 'S%' GROUP BY p_type",
    "rejection_sweep": "WITH c AS (SELECT unnest([0.05, 0.1, 0.2])::DOUBLE AS rate, unnest((SELECT quantile_cont(l_extendedprice, [0.05, 0.1, 0.2]) FROM lineitem WHERE l_returnflag = 'R')) AS threshold) SELECT rate, round(threshold, 4) AS threshold, round(avg((l_extendedprice < threshold)::INT), 6) AS caught FROM c CROSS JOIN lineitem WHERE l_returnflag <> 'R' GROUP BY rate, threshold",
    "length_fit": "WITH f AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY ALL) SELECT l_returnflag, round(max(s), 4) AS slope, round(max(i), 2) AS intercept, round(avg(abs(l_extendedprice - (s * l_quantity + i))), 2) AS error FROM lineitem JOIN f USING (l_returnflag) WHERE l_orderkey % 2 <> 0 GROUP BY ALL",
    "run_comparison": "WITH o AS (SELECT *, date_trunc('month', o_orderdate) AS m FROM orders), a AS (SELECT m, avg(o_totalprice) AS a FROM o WHERE o_orderkey % 2 = 0 GROUP BY m), b AS (SELECT m, avg(o_totalprice) AS b FROM o WHERE o_orderkey % 2 = 1 GROUP BY m) SELECT count(*) AS steps, round(avg(a) / avg(b), 6) AS mean_ratio, round(median(a) / median(b), 6) AS median_ratio, round(avg(abs(a - b) / b), 6) AS relative FROM a JOIN b USING (m)",
    "confusion_groups": "SELECT CASE WHEN l_discount > 0.05 AND l_tax > 0.04 THEN 'hit' WHEN l_tax > 0.04 THEN 'miss' WHEN l_discount > 0.05 THEN 'false_alarm' ELSE 'reject' END AS kind, count(*) AS n FROM lineitem GROUP BY ALL",
    "edge_buckets": f"WITH {TIMED_SQL} SELECT CASE WHEN duration < 2 THEN '<2' WHEN duration < 5 THEN '<5' WHEN duration < 10 THEN '<10' WHEN duration < 30 THEN '<30' WHEN duration IS NOT NULL THEN '>=30' END AS bucket, count(*) AS n FROM timed GROUP BY ALL",
    "role_fit": "WITH q AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem), f AS (SELECT l_orderkey, bool_and(l_quantity <= [10, 25, 40, 45, 50, 50, 50][k]) AS fits FROM q WHERE n <= 7 GROUP BY l_orderkey) SELECT fits, count(*) AS n FROM f GROUP BY ALL",
}
