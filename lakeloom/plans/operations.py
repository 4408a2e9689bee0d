"""Queries of tasks, attempts, overviews, recipe arms, embedding jobs and synchronised logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions.draws import u, u_sql
from lakeloom.operators import operations as O
from lakeloom.operators.similarity import unit
from lakeloom.plans.views import RECORDS_SQL, records
from lakeloom.session import scratch
from lakeloom.sources.tables import table
from lakeloom.streaming import tail as Z


def task_order(spark, d):
    """Tasks that import each dataset version, index it once it and its ancestor are imported, and publish a dataset
    once all its versions are indexed; a third of all are done by hash."""
    c = table(spark, d, "dataset_catalog").select(F.concat_ws("@", "dataset_id", "version").alias("ref"), "dataset_id", "derived_from")
    name = lambda step, x: F.concat(F.lit(f"{step} "), x)
    tasks = c.select(F.explode(F.array(name("import", F.col("ref")), name("index", F.col("ref")), name("publish", F.col("dataset_id")))).alias("task")).distinct()
    needs = c.select(name("index", F.col("ref")).alias("task"), name("import", F.col("ref")).alias("needed"))
    needs = needs.unionByName(c.where("derived_from is not null").select(name("import", F.col("ref")).alias("task"), name("index", F.col("derived_from")).alias("needed")))
    needs = needs.unionByName(c.select(name("publish", F.col("dataset_id")).alias("task"), name("index", F.col("ref")).alias("needed")))
    done = tasks.where(u(41, "done", "task") < 0.33)
    return O.runnable(O.task_levels(tasks, needs), needs, done)


def root_attempts(spark, d):
    """The roots of the audio index with the record delivered last from any of their cuts."""
    i = table(spark, d, "audio_index").select("cut_id", "root_alias").where("root_alias is not null").distinct()
    tries = table(spark, d, "audio_records").select("id", "ingested_at", F.explode("audio_slots.ref.cut_id").alias("cut_id")).join(i, "cut_id").select("root_alias", "id", "ingested_at").where("ingested_at is not null")
    return O.latest_attempt(i.select("root_alias").distinct(), tries, "root_alias", "ingested_at", "id")


def overview_state(spark, d):
    """An overview of datasets as of February beside what they hold now."""
    r = table(spark, d, "audio_records").select("dataset_id", "ingested_at", "id").where("dataset_id is not null")
    count = lambda x: x.groupBy("dataset_id").agg(F.concat_ws("/", F.count("*"), F.count_distinct("id")).alias("digest"))
    return O.overview_changes(count(r.where("ingested_at < timestamp '2026-02-01 00:00:00'")), count(r), "dataset_id", "digest")


def recipe_quotas(spark, d):
    """Windows of 1,000 of a control arm without replay and of arms that replay a fifth and a half of trained sources."""
    w = table(spark, d, "mix_targets").select("source", F.col("target_share").alias("weight"), (u(42, "trained", "source") < 0.5).alias("trained"))
    return O.recipe_arms(w, 1000, {"control": 0.0, "fifth": 0.2, "half": 0.5})


def embedding_job(spark, d):
    """Vectors at length 1 in half the size, by shard; shards that are done are skipped, as are vectors of no length."""
    e = table(spark, d, "embeddings").where("embedding is not null").select("vec_id", F.pmod("vec_id", F.lit(8)).alias("shard"), unit(F.col("embedding")).alias("v"))
    done = spark.createDataFrame([(s,) for s in (1, 4)], "shard long")
    todo = e.join(F.broadcast(done), "shard", "left_anti")
    half = F.transform("v", lambda x: F.rint(x * 2048) / 2048)
    length = F.sqrt(F.aggregate(half, F.lit(0.0), lambda s, x: s + x * x))
    return todo.select("shard", length.alias("n")).where("n > 0").groupBy("shard").agg(F.count("*").alias("vectors"), F.round(F.avg("n"), 3).alias("length"))


def synced_log(spark, d):
    """Z3: users' events as a stream brought them against the table, in which every seventeenth user is lost: which users'
    last states aren't there, differ, or aren't purchases."""
    e = Z.stream(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    here = Z.drain(Z.deduplicated(e, "event_id", "ts", "60 days"))
    state = lambda x: x.select(F.col("user_id").alias("key"), F.col("event_type").alias("state"), F.struct("ts", "event_id").alias("at"))
    there = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    there = there.where(F.pmod("user_id", F.lit(17)) != 0)
    return O.terminal_check(state(here), state(there), ["purchase"]).groupBy("error").agg(F.count("*").alias("users"))


def bounded_pipeline(spark, d):
    """All orders in eight files, taken one file at a time so that little is held at once; each row once, in eight
    batches."""
    at = scratch(spark, "streams")
    table(spark, d, "orders").select("o_orderkey").repartition(8, "o_orderkey").write.parquet(f"{at}/in")
    rows = spark.readStream.schema("o_orderkey long").option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    Z.consumed_batches(rows, F.pmod("o_orderkey", F.lit(8)), f"{at}/out")
    got = spark.read.parquet(f"{at}/out")
    return got.agg(F.count_distinct("epoch").alias("batches"), F.count("*").alias("rows"), F.count_distinct("o_orderkey").alias("orders"))


QUERIES = {f.__name__: f for f in [task_order, root_attempts, overview_state, recipe_quotas, embedding_job, synced_log, bounded_pipeline]}


def _quota(arm: str, trained: bool, size: int) -> str:
    side = "" if trained else "NOT "
    return f"SELECT '{arm}' AS arm, source, base + CASE WHEN row_number() OVER (ORDER BY round(exact - base, 9) DESC, source) <= {size} - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM (SELECT *, CAST(floor(exact) AS BIGINT) AS base FROM (SELECT source, target_share * {float(size)} / sum(target_share) OVER () AS exact FROM m WHERE {side}trained))"


_ARMS = " UNION ALL ".join(_quota(a, t, n) for a, k in (("control", 0), ("fifth", 200), ("half", 500)) for t, n in ((True, k), (False, 1000 - k)))
SQL = {
    "task_order": f"""WITH RECURSIVE c AS (SELECT dataset_id || '@' || version AS ref, dataset_id, derived_from FROM dataset_catalog), tasks AS (SELECT 'import ' || ref AS task FROM c UNION SELECT 'index ' || ref FROM c UNION SELECT 'publish ' || dataset_id FROM c),
needs AS (SELECT 'index ' || ref AS task, 'import ' || ref AS needed FROM c UNION SELECT 'import ' || ref, 'index ' || derived_from FROM c WHERE derived_from IS NOT NULL UNION SELECT 'publish ' || dataset_id, 'index ' || ref FROM c),
w AS (SELECT task, 0 AS level FROM tasks UNION SELECT n.task, w.level + 1 FROM w JOIN needs n ON n.needed = w.task WHERE w.level < 50), done AS (SELECT task FROM tasks WHERE {u_sql(41, 'done', 'task')} < 0.33)
SELECT t.task, max(w.level) AS level, (SELECT count(*) FROM needs n WHERE n.task = t.task AND n.needed NOT IN (SELECT task FROM tasks)) AS missing, CASE WHEN t.task IN (SELECT task FROM done) THEN 'done' WHEN t.task IN (SELECT task FROM needs WHERE needed NOT IN (SELECT task FROM done)) THEN 'blocked' ELSE 'ready' END AS state FROM tasks t JOIN w ON w.task = t.task GROUP BY t.task""",
    "root_attempts": "WITH i AS (SELECT DISTINCT cut_id, root_alias FROM audio_index WHERE root_alias IS NOT NULL), s AS (SELECT id, ingested_at, unnest(audio_slots).ref.cut_id AS cut_id FROM audio_records), t AS (SELECT root_alias, id, ingested_at FROM s JOIN i USING (cut_id) WHERE ingested_at IS NOT NULL) SELECT r.root_alias, arg_max(t.id, (t.ingested_at, t.id)) AS latest, count(t.id) AS attempts FROM (SELECT DISTINCT root_alias FROM i) r LEFT JOIN t USING (root_alias) GROUP BY r.root_alias",
    "overview_state": "WITH r AS (SELECT dataset_id, ingested_at, id FROM audio_records WHERE dataset_id IS NOT NULL), a AS (SELECT dataset_id, count(*) || '/' || count(DISTINCT id) AS was FROM r WHERE ingested_at < TIMESTAMP '2026-02-01 00:00:00' GROUP BY ALL), b AS (SELECT dataset_id, count(*) || '/' || count(DISTINCT id) AS now FROM r GROUP BY ALL) SELECT dataset_id, CASE WHEN was IS NULL THEN 'new' WHEN now IS NULL THEN 'gone' WHEN was = now THEN 'current' ELSE 'stale' END AS state FROM a FULL JOIN b USING (dataset_id)",
    "recipe_quotas": f"WITH m AS (SELECT source, target_share, {u_sql(42, 'trained', 'source')} < 0.5 AS trained FROM mix_targets) {_ARMS}",
    "embedding_job": "WITH e AS (SELECT vec_id % 8 AS shard, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL AND vec_id % 8 NOT IN (1, 4)), n AS (SELECT shard, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e), h AS (SELECT shard, sqrt(list_sum(list_transform(v, lambda x: power(round_even(x / n * 2048, 0) / 2048, 2)))) AS l FROM n WHERE n > 0) SELECT shard, count(*) AS vectors, round(avg(l), 3) AS length FROM h WHERE l > 0 GROUP BY shard",
    "synced_log": "WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY ALL), x AS (SELECT CASE WHEN user_id % 17 = 0 THEN 'missing' WHEN state <> 'purchase' THEN 'open' END AS error FROM l) SELECT error, count(*) AS users FROM x WHERE error IS NOT NULL GROUP BY ALL",
    "bounded_pipeline": "SELECT 8 AS batches, count(*) AS rows, count(DISTINCT o_orderkey) AS orders FROM orders",
}
