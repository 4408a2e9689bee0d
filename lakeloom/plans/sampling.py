"""Queries of the draw plans, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions.draws import categorical, hash_sql, log_uniform, u, u_sql
from lakeloom.operators import sampling as S
from lakeloom.operators.ordering import ordered_positions
from lakeloom.operators.selection import largest_remainder
from lakeloom.plans.views import RECORDS_SQL, TIMED_SQL, records, timed_records
from lakeloom.sources.tables import table


def shard_rotation(spark, d):
    """40 rows of each dataset are due in epoch 3, twice."""
    r = S.numbered(records(spark, d).select("id", "dataset_id"), "dataset_id", ["id"])
    return S.rotated(r, F.lit(40), F.lit(2), 3).select("dataset_id", "id", "rep")


def weighted_mux(spark, d):
    """All records, their sources interleaved by target share."""
    w = table(spark, d, "mix_targets").select(F.col("source").alias("dataset_id"), "target_share")
    r = records(spark, d).select("id", "dataset_id").join(F.broadcast(w), "dataset_id")
    return S.interleaved(r, "dataset_id", F.col("target_share"), 42, "id").select("id", "dataset_id", F.round("at", 6).alias("at"))


def _quotas(spark, d):
    n = records(spark, d).groupBy("dataset_id").agg(F.count("*").alias("n"))
    q = largest_remainder(table(spark, d, "mix_targets").select("source", F.col("target_share").alias("weight")), 100, ["source"])
    return q.join(n, q["source"] == n["dataset_id"]).where("quota > 0").select("source", "quota", "n")


def replay_plan(spark, d):
    """Epoch 2 of 5 windows of 100 draws."""
    p = S.replay_positions(_quotas(spark, d), 5, 2)
    return S.replayed(p, records(spark, d).select("id", "dataset_id"), "dataset_id", "id", 9).select("source", "draw", "window", "cycle", "offset", "id")


def full_coverage(spark, d):
    """B5."""
    return S.full_coverage_windows(_quotas(spark, d))


def _costed(spark, d):
    r = timed_records(spark, d).where("duration is not null")
    return r.select("id", u(1, "arrival", "id").alias("at"), F.when(F.col("task") == "target_speaker_asr", 2).otherwise(1).alias("slots"), F.least("duration", F.lit(30.0)).alias("cost"))


def bucket_keys(spark, d):
    """Rows per slot count and duration bin."""
    c = _costed(spark, d)
    longest = c.agg(F.max("cost").alias("longest"))
    return c.crossJoin(F.broadcast(longest)).groupBy("slots", S.duration_bin(F.col("cost"), F.col("longest"), 8).alias("bin")).agg(F.count("*").alias("n"), F.round(F.sum("cost"), 3).alias("seconds"))


def bucket_batching(spark, d):
    """B6."""
    return S.bucket_batches(_costed(spark, d), 500, 8, 120.0, 16).groupBy("slots", "buffer", "bin", "batch").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 3).alias("seconds"))


def sorted_packing(spark, d):
    """Batches by sorted cost, their padded size and the share of padding."""
    return S.sorted_batches(_costed(spark, d), 500, 120.0, 16).groupBy("slots", "buffer", "batch").agg(F.count("*").alias("n"), F.round(F.count("*") * F.max("cost"), 3).alias("padded"), F.round(1 - F.sum("cost") / (F.count("*") * F.max("cost")), 6).alias("padding"))


def _order_batches(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("batch_id")).agg(F.count("*").alias("n"), F.max("l_quantity").alias("longest"))


def balance(spark, d):
    """Snake order inside updates of 4 x 2 batches."""
    return S.balanced_updates(_order_batches(spark, d), 4, 2, 3)


def rank_partition(spark, d):
    """The batches of rank 1 of 7, the first ones repeated to fill up."""
    b = S.in_hash_order(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    return S.of_rank(S.with_tail(b, 7, False), 1, 7)


def resume_suffix(spark, d):
    """What is left after a cursor saved by 4 ranks at 30 is taken over by 8, last batches dropped."""
    b = S.in_hash_order(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    consumed = S.migrated_cursor(30, 4, 8) * 8
    return S.resumed(S.with_tail(b, 8, True), consumed)


def _rewards(spark, d):
    """Four samples of each record with a reward of 0, 1 or -1 by hash, records with text seldom at 0."""
    r = records(spark, d).select("id", "dataset_id", (F.coalesce(F.trim("target"), F.lit("")) != "").alias("present")).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(3))))
    x = u(8, "reward", "id", "sample")
    return r.withColumn("reward", F.when(x < 0.5, 1).when(x < F.when(F.col("present"), 0.6).otherwise(0.9), 0).otherwise(-1))


def mined_prompts(spark, d):
    """The prompts of a plan: of sources that are only mined the records whose samples' rewards differ, each drawn as
    often as a hash says; of the others every record once by replay, less what is mined there too."""
    varied = _rewards(spark, d).groupBy("id", "dataset_id").agg(F.count_distinct("reward").alias("kinds")).where("kinds > 1")
    only = u(8, "mined-only", "dataset_id") < 0.4
    mined = varied.withColumn("draws", F.floor(u(8, "mined", "id") * 3).cast("long")).where("draws > 0")
    replayed = records(spark, d).where(~only).join(mined.select("id"), "id", "left_anti").select("id", F.lit("replay").alias("origin"), F.lit(1).cast("long").alias("draws"))
    return replayed.unionByName(mined.select("id", F.lit("mined").alias("origin"), "draws"))


def contrast_groups(spark, d):
    """Records all of whose samples decide presence wrongly (reward -1), with the last of them, and by direction: text
    missed where there is some, or written where there is none."""
    g = _rewards(spark, d).groupBy("id", "present").agg(F.bool_and(F.col("reward") == -1).alias("wrong"), F.max("sample").alias("last"))
    return g.where("wrong").select("id", "last", F.when(F.col("present"), "missed").otherwise("false_alarm").alias("direction"))


def hotword_lists(spark, d):
    """Offered hotwords."""
    r = records(spark, d).where("hotwords is not null").select("id", "dataset_id", "hotwords")
    pool = r.select(F.col("dataset_id").alias("pool"), F.explode("hotwords").alias("word")).distinct()
    return S.hotword_list(r.select("id", F.col("dataset_id").alias("pool"), "hotwords"), pool, 4, 0.7, 0.2, 8)


def enrollment_draws(spark, d):
    """How many targets, absent or not, a crop length and its start per record."""
    r = timed_records(spark, d).where("task = 'target_speaker_asr' and duration is not null")
    length = F.least(log_uniform(2, "crop", 2.0, 8.0, "id"), F.col("duration"))
    return r.select("id", (categorical(u(2, "k", "id"), [0.5, 0.3, 0.2]) + 1).alias("targets"), (u(2, "absent", "id") < 0.15).alias("absent"), F.round(length, 4).alias("crop"), F.round(u(2, "start", "id") * (F.col("duration") - length), 4).alias("start"))


def think_choice(spark, d):
    """Documented thoughts for three classes of draws."""
    r = records(spark, d).where("task = 'asr'").select("id", "target", u(6, "think", "id").alias("p"))
    notes = table(spark, d, "audio_records").where("labels is not null").groupBy("id").agg(F.max("labels").alias("note"))
    j = r.join(notes, "id", "left")
    kind = F.when(F.col("note").isNull(), "none").when(F.col("p") < 0.5, "on").when(F.col("p") < 0.8, "empty").otherwise("off")
    return j.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def source_draws(spark, d):
    """One source of all with a weight for each record, by least -ln(u) / weight."""
    w = table(spark, d, "mix_targets").where("target_share > 0").select("source", "target_share")
    scored = records(spark, d).select("id").crossJoin(F.broadcast(w)).withColumn("k", -F.log(u(10, "source", "id", "source") + 1e-12) / F.col("target_share"))
    return scored.groupBy("id").agg(F.min_by("source", "k").alias("source"))


def stratified_folds(spark, d):
    """Five folds, each class dealt out in hash order."""
    r = records(spark, d).select("id", "task", F.sha2("id", 256).alias("h"))
    return ordered_positions(r, ["task"], ["h"]).select("id", "task", F.pmod("ix", F.lit(5)).cast("int").alias("fold"))


def task_grid(spark, d):
    """The cells of dataset, language and repeat that have enough records."""
    r = records(spark, d)
    cells = r.select("dataset_id").distinct().crossJoin(F.broadcast(r.where("language in ('zh', 'en', 'de')").select("language").distinct())).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(2))))
    ok = r.groupBy("dataset_id", "language").agg(F.count("*").alias("n")).where("n >= 20")
    return cells.join(ok, ["dataset_id", "language"], "left_semi")


QUERIES = {f.__name__: f for f in [shard_rotation, weighted_mux, replay_plan, full_coverage, bucket_keys, bucket_batching, sorted_packing, balance, rank_partition, resume_suffix, mined_prompts, contrast_groups, hotword_lists, enrollment_draws, think_choice, source_draws, stratified_folds, task_grid]}

_QUOTAS = "q0 AS (SELECT source, target_share * 100.0 / sum(target_share) OVER () AS exact FROM mix_targets), q1 AS (SELECT *, CAST(floor(exact) AS BIGINT) AS base FROM q0), q2 AS (SELECT source, base + CASE WHEN row_number() OVER (ORDER BY round(exact - base, 9) DESC, source) <= 100 - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM q1), sizes AS (SELECT dataset_id AS source, count(*) AS n FROM records GROUP BY ALL), quotas AS (SELECT source, quota, n FROM q2 JOIN sizes USING (source) WHERE quota > 0)"
_COSTED = f"{TIMED_SQL}, costed AS (SELECT id, CASE WHEN task = 'target_speaker_asr' THEN 2 ELSE 1 END AS slots, least(duration, 30.0) AS cost FROM timed WHERE duration IS NOT NULL)"
_BUFFERS = f"{_COSTED}, placed AS (SELECT *, (row_number() OVER (PARTITION BY slots ORDER BY {u_sql(1, 'arrival', 'id')}, id) - 1) // 500 AS buffer, {u_sql(1, 'arrival', 'id')} AS at_ FROM costed)"
# Greedy cuts, one step a row: over the sum of costs, or over the padded size as costs ascend.
_GREEDY = "cut AS (SELECT slots, buffer, bin, i, cost, 0 AS batch, 1 AS n, cost AS total FROM o WHERE i = 1 UNION ALL SELECT o.slots, o.buffer, o.bin, o.i, o.cost, CASE WHEN {full} THEN c.batch + 1 ELSE c.batch END, CASE WHEN {full} THEN 1 ELSE c.n + 1 END, CASE WHEN {full} THEN o.cost ELSE c.total + o.cost END FROM cut c JOIN o ON o.slots = c.slots AND o.buffer = c.buffer AND o.bin = c.bin AND o.i = c.i + 1)"
_CAT = "CASE WHEN {x} < 0.5 THEN 1 WHEN {x} < 0.8 THEN 2 ELSE 3 END"
_REWARDS = f"w AS (SELECT *, CASE WHEN x < 0.5 THEN 1 WHEN x < CASE WHEN present THEN 0.6 ELSE 0.9 END THEN 0 ELSE -1 END AS reward FROM (SELECT *, {u_sql(8, 'reward', 'id', 'sample')} AS x FROM (SELECT id, dataset_id, coalesce(trim(target), '') <> '' AS present, unnest(range(0, 4)) AS sample FROM records)))"
SQL = {
    "shard_rotation": f"WITH {RECORDS_SQL}, r AS (SELECT id, dataset_id, row_number() OVER (PARTITION BY dataset_id ORDER BY id) - 1 AS ix, count(*) OVER (PARTITION BY dataset_id) AS n FROM records), c AS (SELECT *, least(40, n) AS cap FROM r), s AS (SELECT *, (3 % CAST(ceil(n / cap) AS BIGINT)) * cap AS start FROM c) SELECT dataset_id, id, unnest([1, 2]) AS rep FROM s WHERE ((ix - start) % n + n) % n < cap",
    "weighted_mux": f"WITH {RECORDS_SQL}, r AS (SELECT id, dataset_id, target_share FROM records JOIN mix_targets ON source = dataset_id), m AS (SELECT id, dataset_id, (row_number() OVER (PARTITION BY dataset_id ORDER BY {hash_sql(42, 'mux', 'id')}, id) - 1 + {u_sql(42, 'mux-time', 'id')}) / target_share AS at_ FROM r) SELECT id, dataset_id, round(at_, 6) AS \"at\" FROM m",
    "replay_plan": f"WITH {RECORDS_SQL}, {_QUOTAS}, d AS (SELECT source, quota, n, unnest(range(0, CAST(quota * 5 AS BIGINT))) AS draw FROM quotas), p AS (SELECT source, draw, CAST(floor(draw / quota) AS BIGINT) AS w, CAST(floor((2 * quota * 5 + draw) / n) AS BIGINT) AS cycle, CAST((2 * quota * 5 + draw) % n AS BIGINT) AS off FROM d), o AS (SELECT c.source, c.cycle, r.id, row_number() OVER (PARTITION BY c.source, c.cycle ORDER BY sha256(concat_ws(':', '9', 'replay', CAST(c.cycle AS VARCHAR), r.id)), r.id) - 1 AS off FROM (SELECT DISTINCT source, cycle FROM p) c JOIN records r ON r.dataset_id = c.source) SELECT p.source, p.draw, p.w AS \"window\", p.cycle, p.off AS \"offset\", o.id FROM p JOIN o USING (source, cycle, off)",
    "full_coverage": f"WITH {RECORDS_SQL}, {_QUOTAS} SELECT CAST(max(ceil(n / quota)) AS BIGINT) AS windows FROM quotas",
    "bucket_keys": f"WITH {_COSTED} SELECT slots, CAST(least(7, floor(cost / ((SELECT max(cost) FROM costed) / 8))) AS INTEGER) AS bin, count(*) AS n, round(sum(cost), 3) AS seconds FROM costed GROUP BY ALL",
    "bucket_batching": f"WITH RECURSIVE {_BUFFERS}, b AS (SELECT *, CAST(least(7, floor(cost / ((SELECT max(cost) FROM costed) / 8))) AS INTEGER) AS bin FROM placed), o AS (SELECT *, row_number() OVER (PARTITION BY slots, buffer, bin ORDER BY at_, id) AS i FROM b), {_GREEDY.format(full='(c.n >= 16 OR c.total + o.cost > 120.0)')} SELECT slots, buffer, bin, batch, count(*) AS n, round(sum(cost), 3) AS seconds FROM cut GROUP BY ALL",
    "sorted_packing": f"WITH RECURSIVE {_BUFFERS}, o AS (SELECT *, 0 AS bin, row_number() OVER (PARTITION BY slots, buffer ORDER BY cost, id) AS i FROM placed), {_GREEDY.format(full='(c.n >= 16 OR o.cost * (c.n + 1) > 120.0)')} SELECT slots, buffer, batch, count(*) AS n, round(count(*) * max(cost), 3) AS padded, round(1 - sum(cost) / (count(*) * max(cost)), 6) AS padding FROM cut GROUP BY ALL",
    "balance": f"WITH b AS (SELECT l_orderkey AS batch_id, count(*) AS n, max(l_quantity) AS longest FROM lineitem GROUP BY ALL), k AS (SELECT *, row_number() OVER (ORDER BY round(n * longest, 9), batch_id) - 1 AS k FROM b), g AS (SELECT *, k // 8 AS up, k % 8 AS i, count(*) OVER (PARTITION BY k // 8) = 8 AS whole FROM k), o AS (SELECT up, row_number() OVER (ORDER BY {hash_sql(3, 'groups', 'up')}) - 1 AS place FROM (SELECT DISTINCT up FROM g)) SELECT batch_id, place, i // 4 AS row, CASE WHEN whole AND (i // 4) % 2 = 1 THEN 3 - i % 4 ELSE i % 4 END AS rank FROM g JOIN o USING (up)",
    "rank_partition": "WITH b AS (SELECT o_orderkey, row_number() OVER (ORDER BY sha256(CAST(o_orderkey AS VARCHAR))) - 1 AS p FROM orders), t AS (SELECT count(*) AS total FROM b), a AS (SELECT o_orderkey, p FROM b UNION ALL SELECT o_orderkey, p + total FROM b, t WHERE p < (7 - total % 7) % 7) SELECT o_orderkey, p AS position FROM a WHERE p % 7 = 1",
    "resume_suffix": "WITH b AS (SELECT o_orderkey, row_number() OVER (ORDER BY sha256(CAST(o_orderkey AS VARCHAR))) - 1 AS p FROM orders), t AS (SELECT count(*) AS total FROM b) SELECT o_orderkey, p AS position FROM b, t WHERE p < total - total % 8 AND p >= 120",
    "mined_prompts": f"WITH {RECORDS_SQL}, {_REWARDS}, v AS (SELECT id FROM w GROUP BY id HAVING count(DISTINCT reward) > 1), m AS (SELECT id, CAST(floor({u_sql(8, 'mined', 'id')} * 3) AS BIGINT) AS draws FROM v) SELECT id, 'mined' AS origin, draws FROM m WHERE draws > 0 UNION ALL SELECT id, 'replay', 1 FROM records WHERE NOT ({u_sql(8, 'mined-only', 'dataset_id')} < 0.4) AND id NOT IN (SELECT id FROM m WHERE draws > 0)",
    "contrast_groups": f"WITH {RECORDS_SQL}, {_REWARDS} SELECT id, max(sample) AS last, CASE WHEN present THEN 'missed' ELSE 'false_alarm' END AS direction FROM w GROUP BY id, present HAVING bool_and(reward = -1)",
    "hotword_lists": f"""WITH {RECORDS_SQL}, r AS (SELECT id, dataset_id, hotwords FROM records WHERE hotwords IS NOT NULL), pw AS (SELECT dataset_id, w, row_number() OVER (PARTITION BY dataset_id ORDER BY w) - 1 AS ix, count(*) OVER (PARTITION BY dataset_id) AS n FROM (SELECT DISTINCT dataset_id, unnest(hotwords) AS w FROM r) WHERE w IS NOT NULL),
own AS (SELECT DISTINCT id, unnest(hotwords) AS w FROM r), kept AS (SELECT id, w FROM own WHERE w IS NOT NULL AND {u_sql(4, 'miss', 'id', 'w')} >= 0.2), sizes AS (SELECT dataset_id, max(n) AS n FROM pw GROUP BY ALL),
room AS (SELECT r.id, r.dataset_id, s.n, CAST(floor({u_sql(4, 'count', 'r.id')} * (greatest(8 - (SELECT count(*) FROM kept k WHERE k.id = r.id), 0) + 1)) AS BIGINT) AS c FROM r JOIN sizes s USING (dataset_id)),
tries AS (SELECT id, dataset_id, n, unnest(range(0, c)) AS j FROM room), drawn AS (SELECT DISTINCT t.id, p.w FROM tries t JOIN pw p ON p.dataset_id = t.dataset_id AND p.ix = CAST(floor({u_sql(4, 'distract', 't.id', 't.j')} * t.n) AS BIGINT) WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.id = t.id AND o.w = p.w)),
said AS (SELECT id, string_agg(w, ', ' ORDER BY {u_sql(4, 'shuffle', 'id', 'w')}, w) AS s FROM (SELECT * FROM kept UNION ALL SELECT * FROM drawn) GROUP BY id)
SELECT r.id, CASE WHEN {u_sql(4, 'prompt', 'r.id')} < 0.7 AND s IS NOT NULL THEN s ELSE 'N/A' END AS offered FROM r LEFT JOIN said USING (id)""",
    "enrollment_draws": f"WITH {TIMED_SQL}, x AS (SELECT id, duration, least(exp(ln(2.0) + {u_sql(2, 'crop', 'id')} * (ln(8.0) - ln(2.0))), duration) AS length FROM timed WHERE task = 'target_speaker_asr' AND duration IS NOT NULL) SELECT id, {_CAT.format(x=u_sql(2, 'k', 'id'))} AS targets, {u_sql(2, 'absent', 'id')} < 0.15 AS absent, round(length, 4) AS crop, round({u_sql(2, 'start', 'id')} * (duration - length), 4) AS start FROM x",
    "think_choice": f"WITH {RECORDS_SQL}, j AS (SELECT r.id, {u_sql(6, 'think', 'r.id')} AS p, n.note FROM records r LEFT JOIN (SELECT id, max(labels) AS note FROM audio_records WHERE labels IS NOT NULL GROUP BY id) n USING (id) WHERE r.task = 'asr') SELECT CASE WHEN note IS NULL THEN 'none' WHEN p < 0.5 THEN 'on' WHEN p < 0.8 THEN 'empty' ELSE 'off' END AS kind, count(*) AS n FROM j GROUP BY ALL",
    "source_draws": f"WITH {RECORDS_SQL} SELECT id, arg_min(source, k) AS source FROM (SELECT id, source, -ln({u_sql(10, 'source', 'id', 'source')} + 1e-12) / target_share AS k FROM records CROSS JOIN mix_targets WHERE target_share > 0) GROUP BY id",
    "stratified_folds": f"WITH {RECORDS_SQL} SELECT id, task, (row_number() OVER (PARTITION BY task ORDER BY sha256(id)) - 1) % 5 AS fold FROM records",
    "task_grid": f"WITH {RECORDS_SQL}, ok AS (SELECT dataset_id, language FROM records WHERE language IN ('zh', 'en', 'de') GROUP BY ALL HAVING count(*) >= 20) SELECT dataset_id, language, unnest([0, 1, 2]) AS repeat FROM ok",
}
