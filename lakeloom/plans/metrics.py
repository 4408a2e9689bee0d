"""Queries of the aggregates, each with its SQL. Order lines stand for scored samples: quantity for units, discounted
quantity for errors, the flag and status for dataset and condition."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions.alignment import batched, repeated_grams
from lakeloom.operators import aggregates as A
from lakeloom.operators.ordering import ordered_positions, quantiles
from lakeloom.plans.views import FIRST_TURNS_SQL, INDEX_SQL, RECORDS_SQL, TIMED_SQL, TURNS_SQL, index, records, timed_records, turns
from lakeloom.session import checkpointed
from lakeloom.sources.tables import table

def errors():
    return F.col("l_discount") * F.col("l_quantity")


def units():
    return F.col("l_quantity")


def pooled_rate(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(A.rate(errors(), units()), 6).alias("rate"), F.round(F.sum(units()), 2).alias("units"))


def utterance_weighted(spark, d):
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.round(A.weighted_mean(F.col("l_discount"), F.col("l_quantity")), 6).alias("mean"))


def attribution_coverage(spark, d):
    """A3: coverage and accuracy where one method scored."""
    o = table(spark, d, "orders")
    known = F.col("o_orderstatus") != "P"
    return o.groupBy("o_orderpriority").agg(A.one_method(F.substring("o_orderstatus", 1, 1)).alias("poolable"), F.round(F.avg(known.cast("double")), 6).alias("coverage"), F.round(F.try_divide(F.sum((F.col("o_orderstatus") == "F").cast("double")), F.sum(known.cast("double"))), 6).alias("accuracy"))


def boundary_scores(spark, d):
    """A4: precision, recall and F1 of turn times, and the mean error of matched bounds, by split: first deliveries as
    predictions of the latest, matched where both bounds are within a quarter of a second."""
    a = turns(spark, d, first=True).select("turn_id", F.col("s").alias("ps"), F.col("e").alias("pe"), F.col("split").alias("predicted_split"))
    b = turns(spark, d).select("turn_id", "s", "e", "split")
    j = b.join(a, "turn_id", "full").withColumn("split", F.coalesce("split", "predicted_split"))
    off = F.greatest(F.abs(F.col("s") - F.col("ps")), F.abs(F.col("e") - F.col("pe")))
    matched = F.coalesce((off <= 25).cast("int"), F.lit(0))
    scores = A.precision_recall(matched, F.col("ps").isNotNull().cast("int"), F.col("s").isNotNull().cast("int"))
    error = (F.abs(F.col("s") - F.col("ps")) + F.abs(F.col("e") - F.col("pe"))) / 200.0
    return j.groupBy("split").agg(*[F.round(c, 6).alias(n) for c, n in zip(scores, ["precision", "recall", "f1"])], F.round(F.avg(F.when(matched == 1, error)), 6).alias("boundary_mae"))


def grouping_sets(spark, d):
    """Rates by dataset, by condition, by both, and over all."""
    t = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", errors().alias("e"), units().alias("u"))
    t.createOrReplaceTempView("lakeloom_scored")
    return spark.sql("SELECT l_returnflag AS dataset, l_linestatus AS condition, CAST(grouping_id(l_returnflag, l_linestatus) AS INT) AS level, round(sum(e) / sum(u), 6) AS rate, count(*) AS n FROM lakeloom_scored GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ())")


def condition_keys(spark, d):
    """Speakers and level out of a path-like key."""
    k = F.concat(F.lit("eval_"), F.pmod("o_custkey", F.lit(3)) + 1, F.lit("spk_"), F.lower(F.substring("o_orderpriority", 3, 4)), F.lit("/cer"))
    return table(spark, d, "orders").groupBy(F.regexp_extract(k, r"_(\d+)spk_", 1).cast("int").alias("speakers"), F.regexp_extract(k, r"spk_([a-z ]+)/", 1).alias("level")).agg(F.count("*").alias("n"))


def meeting_summary(spark, d):
    """Windows by bucket of speakers: coverage, gaps and shares of conditions."""
    s = table(spark, d, "label_stats").where("overlap_time is not null")
    return s.groupBy(F.when(F.col("speakers") <= 2, "2").when(F.col("speakers") <= 4, "3-4").otherwise("5+").alias("bucket")).agg(
        F.count("*").alias("windows"), F.round(F.avg("speech_cov"), 6).alias("coverage"), F.round(A.weighted_mean(F.col("overlap_time"), F.col("duration_s")), 6).alias("overlap"), F.round(F.avg((F.col("gap_median_s") > 1).cast("double")), 6).alias("slow_share"), F.round(F.sum("duration_s"), 2).alias("seconds"))


def macro_average(spark, d):
    """Mean of datasets' pooled rates."""
    return A.macro(table(spark, d, "lineitem"), ["l_suppkey"], ["l_returnflag"], A.rate(errors(), units())).withColumn("macro", F.round("macro", 6))


def miss_and_false_alarm(spark, d):
    """Error rate over all, misses over positives only, false alarms over negatives only."""
    pos = F.col("l_linestatus") == "O"
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.round(A.rate(F.when(pos, errors()), F.when(pos, units())), 6).alias("cer"),
        F.round(F.try_divide(F.sum((pos & (F.col("l_discount") == 0)).cast("double")), F.sum(pos.cast("double"))), 6).alias("miss"),
        F.round(F.try_divide(F.sum((~pos & (F.col("l_tax") > 0.05)).cast("double")), F.sum((~pos).cast("double"))), 6).alias("false_alarm"))


def contingency(spark, d):
    """High values of one event type against another per user, and users high in all types."""
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg((F.max("value") > 200).alias("high"))
    return A.transitions(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), "user_id", "high")


def common_users(spark, d):
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg((F.max("value") > 100).alias("high"))
    return A.common_subset(e, "user_id", "event_type", F.col("high"))


def value_spread(spark, d):
    """Spread and interpolated percentiles."""
    e = table(spark, d, "events")
    at = quantiles(e, ["event_type"], "value", [0.5, 0.9])
    sums = e.groupBy("event_type").agg(*[F.round(c, 4).alias(n) for c, n in zip(A.spread(F.col("value")), ["lowest", "highest", "range", "mean", "sd"])])
    return sums.join(at, "event_type").select(*sums.columns, F.round("q0", 4).alias("p50"), F.round("q1", 4).alias("p90"))


def nearest_rank_percentile(spark, d):
    """A19."""
    return A.nearest_rank(table(spark, d, "events"), ["event_type"], "value", 0.95, ["event_id"])


def category_histogram(spark, d):
    """Records by task, flagged language and gender vocabulary."""
    return records(spark, d).groupBy("task", "language").agg(F.count("*").alias("n"))


def mixing_distance(spark, d):
    """How far each day's mix of event types is from the overall one."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return A.share_distance(e, "day", "event_type").select("day", F.round("distance", 6).alias("distance"))


def distinct_sources(spark, d):
    """Distinct datasets, padding and used share of each window of 64 records in hash order."""
    r = timed_records(spark, d).where("duration is not null").select("id", "dataset_id", "duration", "task", F.sha2("id", 256).alias("h"))
    r = ordered_positions(r, ["task"], ["h"]).withColumn("update", F.floor(F.col("ix") / 64))
    return r.groupBy("task", "update").agg(F.count_distinct("dataset_id").alias("datasets"), F.round(1 - F.sum("duration") / (F.max("duration") * F.count("*")), 6).alias("padding"))


def exact_hours(spark, d):
    """Exact decimal sums of durations."""
    return index(spark, d).groupBy("root_alias").agg(F.sum(F.col("duration").cast("decimal(20,6)")).cast("double").alias("seconds"), F.sum("num_frames").alias("frames"))


def mixed_duration(spark, d):
    """The end of the last track of each window."""
    return table(spark, d, "turns").where("start_sec is not null and end_sec is not null").groupBy("window_id").agg(F.round(F.max(F.col("start_sec") + F.greatest(F.col("end_sec") - F.col("start_sec"), F.lit(0))), 4).alias("seconds"))


def duration_precedence(spark, d):
    """The best source of each record's duration: its own span, then its cut, then its frames."""
    i = table(spark, d, "audio_index").groupBy("cut_id").agg(F.max("duration").alias("nominal"), F.max(F.col("num_frames") / F.col("sample_rate")).alias("framed"))
    from lakeloom.operators.selection import main_slot

    m = records(spark, d).select("id", main_slot(F.col("audio_slots"))["ref"].alias("ref")).select("id", "ref.cut_id", "ref.duration").join(i, "cut_id", "left")
    kind = F.when(F.col("duration").isNotNull(), "reported").when(F.col("nominal").isNotNull(), "nominal").when(F.col("framed").isNotNull(), "framed").otherwise("missing")
    return m.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce("duration", "nominal", "framed")), 3).alias("seconds"))


def family_chart(spark, d):
    """Of each nation's suppliers the one with most balance, the top 20 nations by it."""
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.max_by("s_suppkey", F.struct("s_acctbal", "s_suppkey")).alias("best"), F.round(F.max("s_acctbal"), 2).alias("most"), F.count("*").alias("n"))
    return s.orderBy(F.desc("most"), "s_nationkey").limit(20)


def auc_rank(spark, d):
    """A29."""
    return A.auc(table(spark, d, "lineitem"), ["l_linestatus"], F.col("l_returnflag") == "R", F.col("l_extendedprice")).select("l_linestatus", F.round("auc", 6).alias("auc"))


def auc_pooled(spark, d):
    """Areas of each ship year weighted by their pairs."""
    t = table(spark, d, "lineitem").withColumn("year", F.year("l_shipdate"))
    areas = A.auc(t, ["year"], F.col("l_returnflag") == "R", F.col("l_discount"))
    pairs = t.groupBy("year").agg((F.sum((F.col("l_returnflag") == "R").cast("double")) * F.sum((F.col("l_returnflag") != "R").cast("double"))).alias("pairs"))
    return areas.join(pairs, "year").agg(F.round(A.weighted_mean(F.col("auc"), F.col("pairs")), 6).alias("pooled"))


def hotword_pool(spark, d):
    """The distinct hotwords of each dataset and language in order, a row each, so that no pool is gathered."""
    w = records(spark, d).select("dataset_id", "language", F.explode("hotwords").alias("word")).where("word is not null").distinct()
    return ordered_positions(w, ["dataset_id", "language"], ["word"]).select("dataset_id", "language", "word", "ix")


def ordered_digest(spark, d):
    """SHA-256 over each order's lines in order."""
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))
    return l.select("l_orderkey", A.list_digest(F.transform("x", lambda s: F.concat_ws("-", s["l_linenumber"], s["l_partkey"], s["l_suppkey"]))).alias("digest"))


def level_report(spark, d):
    """Loudness-like percentiles by task and presence, and the share of empty rows below the p10 of the others."""
    r = timed_records(spark, d).withColumn("empty", F.coalesce(F.trim("target"), F.lit("")) == "")
    at = checkpointed(quantiles(r, ["task", "empty"], "duration", [0.1, 0.5]))
    p10 = F.broadcast(at.where("not empty").select("task", F.col("q0").alias("p10")))
    sums = r.join(p10, "task").groupBy("task", "empty").agg(F.count("*").alias("n"), F.round(F.avg((F.col("duration") < F.col("p10")).cast("double")), 6).alias("below"))
    return sums.join(F.broadcast(at.select("task", "empty", "q1")), ["task", "empty"], "left").select("task", "empty", "n", F.round("q1", 4).alias("p50"), "below")


def repeated_character_ngrams(spark, d):
    """The share of repeated character 8-grams of the normalised text of every document with text, whatever its language."""
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", F.round(batched(repeated_grams, "double")("text", F.lit(8)), 6).alias("repeated"))


def kernel_families(spark, d):
    """Rows by the first matching name pattern."""
    fam = A.first_match(F.col("p_name"), [("ring", "ring|band"), ("red", "^red "), ("widget", "widget$")])
    return table(spark, d, "part").groupBy(fam.alias("family")).agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"))


def confidence_features(spark, d):
    """Mean, mean of the worst quarter, minimum and head mean of a vector, and the gate."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    low = F.slice(F.array_sort(x), 1, F.greatest(F.lit(1), F.floor(F.size(x) / 4)).cast("int"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    head = mean(F.slice(x, 1, 16))
    return table(spark, d, "embeddings").select("vec_id", F.round(mean(x), 5).alias("mean"), F.round(mean(low), 5).alias("worst_quarter"), F.round(F.array_min(x), 5).alias("lowest"), F.round(head, 5).alias("head"), (F.round(head, 5) < -0.01).alias("rejected"))


def benchmark_pivot(spark, d):
    """A table of rates by condition."""
    p = table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.round(F.sum(errors()) / F.sum(units()), 6))
    return p.select("l_returnflag", F.col("F").alias("rate_f"), F.col("O").alias("rate_o"))


QUERIES = {f.__name__: f for f in [pooled_rate, utterance_weighted, attribution_coverage, boundary_scores, grouping_sets, condition_keys, meeting_summary, macro_average, miss_and_false_alarm, contingency, common_users, value_spread, nearest_rank_percentile, category_histogram, mixing_distance, distinct_sources, exact_hours, mixed_duration, duration_precedence, family_chart, auc_rank, auc_pooled, hotword_pool, ordered_digest, level_report, repeated_character_ngrams, kernel_families, confidence_features, benchmark_pivot]}

_E, _U = "l_discount * l_quantity", "l_quantity"
_AUC = "SELECT {g}, sum(p * (below + n * 0.5)) / nullif(sum(p) * sum(n), 0) AS auc FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY {g} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT {g}, {s} AS score, sum((l_returnflag = 'R')::INT) AS p, sum((l_returnflag <> 'R')::INT) AS n FROM {t} GROUP BY ALL)) GROUP BY ALL"
_PLAIN = r"array_to_string(regexp_extract_all(lower(translate(nfc_normalize(text), '{wide}', '{narrow}')), '[\x{{3040}}-\x{{30ff}}\x{{3400}}-\x{{9fff}}\x{{ac00}}-\x{{d7af}}]|[\p{{L}}\p{{N}}]'), '')".format(wide="".join(chr(0xFEE0 + k) for k in range(33, 127)), narrow="".join(chr(k) for k in range(33, 127)).replace("'", "''"))
SQL = {
    "repeated_character_ngrams": f"WITH p AS (SELECT doc_id, string_split({_PLAIN}, '') AS c, length({_PLAIN}) AS n FROM documents WHERE text IS NOT NULL), g AS (SELECT doc_id, n - 7 AS total, CASE WHEN n > 7 THEN len(list_distinct(list_transform(range(1, n - 6), lambda i: array_to_string(c[i:i + 7], '')))) END AS kinds FROM p) SELECT doc_id, CASE WHEN total > 0 THEN round(1 - kinds / total, 6) ELSE 0.0 END AS repeated FROM g",
    "pooled_rate": f"SELECT l_returnflag, round(sum({_E}) / sum({_U}), 6) AS rate, round(sum({_U}), 2) AS units FROM lineitem GROUP BY ALL",
    "utterance_weighted": "SELECT l_linestatus, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean FROM lineitem GROUP BY ALL",
    "attribution_coverage": "SELECT o_orderpriority, count(DISTINCT o_orderstatus) <= 1 AS poolable, round(avg((o_orderstatus <> 'P')::INT), 6) AS coverage, round(sum((o_orderstatus = 'F')::INT) / nullif(sum((o_orderstatus <> 'P')::INT), 0), 6) AS accuracy FROM orders GROUP BY ALL",
    "boundary_scores": f"WITH {TURNS_SQL}, {FIRST_TURNS_SQL}, j AS (SELECT coalesce(t.split, f.split) AS split, t.s, t.e, f.s AS ps, f.e AS pe FROM t FULL JOIN f ON f.turn_id = t.turn_id), m AS (SELECT *, coalesce((greatest(abs(s - ps), abs(e - pe)) <= 25)::INT, 0) AS ok FROM j) SELECT split, round(sum(ok) / count(ps), 6) AS precision, round(sum(ok) / count(s), 6) AS recall, round(2 * sum(ok) / (count(ps) + count(s)), 6) AS f1, round(avg(CASE WHEN ok = 1 THEN (abs(s - ps) + abs(e - pe)) / 200 END), 6) AS boundary_mae FROM m GROUP BY split",
    "grouping_sets": f"SELECT l_returnflag AS dataset, l_linestatus AS condition, CAST(grouping(l_returnflag, l_linestatus) AS INTEGER) AS level, round(sum({_E}) / sum({_U}), 6) AS rate, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ())",
    "condition_keys": "SELECT CAST(o_custkey % 3 + 1 AS INTEGER) AS speakers, regexp_extract(lower(substr(o_orderpriority, 3, 4)), '^([a-z ]+)$', 1) AS level, count(*) AS n FROM orders GROUP BY ALL",
    "meeting_summary": "SELECT CASE WHEN speakers <= 2 THEN '2' WHEN speakers <= 4 THEN '3-4' ELSE '5+' END AS bucket, count(*) AS windows, round(avg(speech_cov), 6) AS coverage, round(sum(overlap_time * duration_s) / sum(CASE WHEN overlap_time IS NOT NULL THEN duration_s END), 6) AS overlap, round(avg((gap_median_s > 1)::INT), 6) AS slow_share, round(sum(duration_s), 2) AS seconds FROM label_stats WHERE overlap_time IS NOT NULL GROUP BY ALL",
    "macro_average": f"SELECT l_returnflag, round(avg(r), 6) AS macro FROM (SELECT l_returnflag, l_suppkey, sum({_E}) / sum({_U}) AS r FROM lineitem GROUP BY ALL) GROUP BY ALL",
    "miss_and_false_alarm": f"SELECT l_returnflag, round(sum(CASE WHEN p THEN {_E} END) / sum(CASE WHEN p THEN {_U} END), 6) AS cer, round(sum((p AND l_discount = 0)::INT) / sum(p::INT), 6) AS miss, round(sum((NOT p AND l_tax > 0.05)::INT) / sum((NOT p)::INT), 6) AS false_alarm FROM (SELECT *, l_linestatus = 'O' AS p FROM lineitem) GROUP BY ALL",
    "contingency": "WITH e AS (SELECT user_id, event_type, max(value) > 200 AS high FROM events GROUP BY ALL), j AS (SELECT coalesce(a.high, false) AS a, coalesce(b.high, false) AS b FROM (SELECT * FROM e WHERE event_type = 'click') a FULL JOIN (SELECT * FROM e WHERE event_type = 'purchase') b USING (user_id)) SELECT CASE WHEN a AND b THEN 'kept' WHEN b THEN 'introduced' WHEN a THEN 'fixed' ELSE 'clean' END AS kind, count(*) AS n FROM j GROUP BY ALL",
    "common_users": "WITH e AS (SELECT user_id, event_type, max(value) > 100 AS high FROM events GROUP BY ALL) SELECT user_id FROM e GROUP BY user_id HAVING bool_and(high) AND count(*) = (SELECT count(DISTINCT event_type) FROM events)",
    "value_spread": "SELECT event_type, round(min(value), 4) AS lowest, round(max(value), 4) AS highest, round(max(value) - min(value), 4) AS range, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd, round(median(value), 4) AS p50, round(quantile_cont(value, 0.9), 4) AS p90 FROM events GROUP BY ALL",
    "nearest_rank_percentile": "SELECT event_type, value AS at_rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) WHERE rn = round_even(0.95 * (n - 1), 0)",
    "category_histogram": f"WITH {RECORDS_SQL} SELECT task, language, count(*) AS n FROM records GROUP BY ALL",
    "mixing_distance": "WITH l AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL), q AS (SELECT event_type, sum(n) / (SELECT sum(n) FROM l) AS q FROM l GROUP BY ALL), days AS (SELECT day, sum(n) AS size FROM l GROUP BY ALL) SELECT d.day, round(0.5 * sum(abs(coalesce(l.n / d.size, 0) - q.q)), 6) AS distance FROM days d CROSS JOIN q LEFT JOIN l ON l.day = d.day AND l.event_type = q.event_type GROUP BY d.day",
    "distinct_sources": f"WITH {TIMED_SQL}, n AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY task ORDER BY sha256(id)) - 1) / 64) AS BIGINT) AS update FROM timed WHERE duration IS NOT NULL) SELECT task, update, count(DISTINCT dataset_id) AS datasets, round(1 - sum(duration) / (max(duration) * count(*)), 6) AS padding FROM n GROUP BY ALL",
    "exact_hours": f"WITH {INDEX_SQL} SELECT root_alias, CAST(sum(CAST(duration AS DECIMAL(20,6))) AS DOUBLE) AS seconds, CAST(sum(num_frames) AS BIGINT) AS frames FROM idx GROUP BY ALL",
    "mixed_duration": "SELECT window_id, round(max(start_sec + greatest(end_sec - start_sec, 0)), 4) AS seconds FROM turns WHERE start_sec IS NOT NULL AND end_sec IS NOT NULL GROUP BY ALL",
    "duration_precedence": f"WITH {TIMED_SQL}, i AS (SELECT cut_id, max(duration) AS nominal, max(num_frames / sample_rate) AS framed FROM audio_index GROUP BY ALL), m AS (SELECT f.main.ref.duration AS own, i.nominal, i.framed FROM flat f LEFT JOIN i ON i.cut_id = f.main.ref.cut_id) SELECT CASE WHEN own IS NOT NULL THEN 'reported' WHEN nominal IS NOT NULL THEN 'nominal' WHEN framed IS NOT NULL THEN 'framed' ELSE 'missing' END AS kind, count(*) AS n, round(sum(coalesce(own, nominal, framed)), 3) AS seconds FROM m GROUP BY ALL",
    "family_chart": "SELECT s_nationkey, arg_max(s_suppkey, (s_acctbal, s_suppkey)) AS best, round(max(s_acctbal), 2) AS most, count(*) AS n FROM supplier GROUP BY ALL ORDER BY most DESC, s_nationkey LIMIT 20",
    "auc_rank": "SELECT l_linestatus, round(auc, 6) AS auc FROM (" + _AUC.format(g="l_linestatus", s="l_extendedprice", t="lineitem") + ")",
    "auc_pooled": "WITH t AS (SELECT *, year(l_shipdate) AS year FROM lineitem), a AS (" + _AUC.format(g="year", s="l_discount", t="t") + "), p AS (SELECT year, sum((l_returnflag = 'R')::INT) * sum((l_returnflag <> 'R')::INT) AS pairs FROM t GROUP BY ALL) SELECT round(sum(auc * pairs) / sum(pairs), 6) AS pooled FROM a JOIN p USING (year)",
    "hotword_pool": f"WITH {RECORDS_SQL}, w AS (SELECT DISTINCT dataset_id, language, unnest(hotwords) AS w FROM records) SELECT dataset_id, language, w AS word, row_number() OVER (PARTITION BY dataset_id, language ORDER BY w) - 1 AS ix FROM w WHERE w IS NOT NULL",
    "ordered_digest": "SELECT l_orderkey, sha256(string_agg(concat_ws('-', l_linenumber, l_partkey, l_suppkey), ',' ORDER BY l_linenumber, l_partkey, l_suppkey)) AS digest FROM lineitem GROUP BY ALL",
    "level_report": f"WITH {TIMED_SQL}, r AS (SELECT *, coalesce(trim(target), '') = '' AS empty FROM timed), p AS (SELECT task, quantile_cont(duration, 0.1) AS p10 FROM r WHERE NOT empty GROUP BY ALL) SELECT task, empty, count(*) AS n, round(quantile_cont(duration, 0.5), 4) AS p50, round(avg((duration < p10)::INT), 6) AS below FROM r JOIN p USING (task) GROUP BY ALL",
    "kernel_families": "SELECT CASE WHEN regexp_matches(p_name, 'ring|band') THEN 'ring' WHEN regexp_matches(p_name, '^red ') THEN 'red' WHEN regexp_matches(p_name, 'widget$') THEN 'widget' ELSE 'other' END AS family, count(*) AS n, round(sum(p_retailprice), 2) AS total FROM part GROUP BY ALL",
    "confidence_features": "WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings) SELECT vec_id, round(list_sum(x) / len(x), 5) AS mean, round(list_avg(list_sort(x)[1:greatest(1, len(x) // 4)]), 5) AS worst_quarter, round(list_min(x), 5) AS lowest, round(list_avg(x[1:16]), 5) AS head, round(list_avg(x[1:16]), 5) < -0.01 AS rejected FROM x",
    "benchmark_pivot": f"SELECT l_returnflag, round(sum(CASE WHEN l_linestatus = 'F' THEN {_E} END) / sum(CASE WHEN l_linestatus = 'F' THEN {_U} END), 6) AS rate_f, round(sum(CASE WHEN l_linestatus = 'O' THEN {_E} END) / sum(CASE WHEN l_linestatus = 'O' THEN {_U} END), 6) AS rate_o FROM lineitem GROUP BY ALL",
}
