"""The whole way from declared sources to an epoch's plan, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions.draws import hash_sql, u_sql
from lakeloom.operators import config
from lakeloom.operators.selection import main_slot
from lakeloom.plans.views import CLEAN_SQL, RECORDS_SQL, TIMED_SQL, index, records
from lakeloom.sources.tables import table

SOURCES = [
    {"name": "calls", "dataset": "harbourdesk_calls", "splits": ["train"], "clean": True, "max_duration": 60.0, "samples": 100, "reps": 2},
    {"name": "read", "dataset": "tidepool_read", "tasks": ["asr"], "exclude": "evaluated", "min_duration": 2.0},
    {"name": "talks", "dataset": "lanternlecture", "where": "language = 'en'", "samples": 30},
]


def epoch_plan(spark, d):
    """Q-A, S1, S17, B1, B2, T2, F1 to F6: epoch 1 of three declared sources."""
    r = records(spark, d).withColumn("main", main_slot(F.col("audio_slots")))
    cuts = index(spark, d).select(F.col("cut_id").alias("c"), F.col("duration").alias("cut_s"))
    r = r.join(cuts, F.col("main.ref.cut_id") == F.col("c"), "left").withColumn("duration", F.coalesce("main.ref.duration", "cut_s"))
    evaluated = table(spark, d, "audio_records").where("split in ('dev', 'eval')").select("id")
    return config.plan(r, SOURCES, 1, 42, {"evaluated": evaluated}).select("source", "id", "rep", F.round("at", 6).alias("at"))


QUERIES = {"epoch_plan": epoch_plan}
SQL = {
    "epoch_plan": f"""WITH {TIMED_SQL}, s AS (SELECT 'calls' AS source, id, 100 AS cap, 2 AS reps FROM timed WHERE dataset_id = 'harbourdesk_calls' AND split = 'train' AND coalesce(clean, false) AND duration <= 60.0
UNION ALL SELECT 'read', id, NULL, 1 FROM timed WHERE dataset_id = 'tidepool_read' AND task = 'asr' AND id NOT IN (SELECT id FROM audio_records WHERE split IN ('dev', 'eval')) AND duration >= 2.0
UNION ALL SELECT 'talks', id, 30, 1 FROM timed WHERE dataset_id = 'lanternlecture' AND language = 'en'),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id) - 1 AS ix, count(*) OVER (PARTITION BY source) AS n FROM s), c AS (SELECT *, least(coalesce(cap, n), n) AS c FROM n), e AS (SELECT *, (1 % CAST(ceil(n / c) AS BIGINT)) * c AS start FROM c),
due AS (SELECT source, id, unnest(range(1, reps + 1)) AS rep FROM e WHERE ((ix - start) % n + n) % n < c), k AS (SELECT *, id || '#' || rep AS draw, count(*) OVER (PARTITION BY source) AS w FROM due)
SELECT source, id, CAST(rep AS INTEGER) AS rep, round((row_number() OVER (PARTITION BY source ORDER BY {hash_sql(43, 'mux', 'draw')}, draw) - 1 + {u_sql(43, 'mux-time', 'draw')}) / w, 6) AS "at" FROM k""",
}
