"""Queries of the streams, held against the same answer in batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.plans.views import TIMED_SQL, timed_records
from lakeloom.streaming import tail as Z


def _events(spark, d):
    return Z.stream(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def event_tail(spark, d):
    """The log's events, each once, by type and value class."""
    kept = Z.drain(Z.deduplicated(_events(spark, d), "event_id", "ts", "60 days"))
    return kept.groupBy("event_type", (F.col("value") > 100).alias("high")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def tumbling_counts(spark, d):
    """Hourly counts with a watermark; an addition to what was asked."""
    w = _events(spark, d).withWatermark("ts", "1 day").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return Z.drain(w, "complete").select(F.unix_micros("w.start").alias("start_us"), "event_type", "n")


def preview_times(spark, d):
    """When previews of each user's session are due, an hour of events standing for a second."""
    e = _events(spark, d).select(F.col("user_id").alias("session"), (F.unix_micros("ts") / 3.6e9).alias("at"))
    return Z.drain(Z.preview_schedule(e, 24.0)).select("session", F.round("at", 4).alias("at"))


def window_layout(spark, d):
    """Fixed windows and balanced chunks of each record."""
    r = timed_records(spark, d).where("duration is not null")
    w = Z.stable_windows(F.col("duration"))
    c = Z.balanced_chunks(F.col("duration"))
    return r.select("id", F.size(w).alias("windows"), F.round(F.get(w, F.size(w) - 1)["e"] - F.get(w, F.size(w) - 1)["s"], 3).alias("tail"), c["n"].alias("chunks"), F.round(c["length"], 4).alias("length"))


QUERIES = {f.__name__: f for f in [event_tail, tumbling_counts, preview_times, window_layout]}
SQL = {
    "event_tail": "SELECT event_type, value > 100 AS high, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "tumbling_counts": "SELECT epoch_us(time_bucket(INTERVAL 6 HOURS, ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY ALL",
    "preview_times": "WITH RECURSIVE e AS (SELECT user_id AS session, epoch_us(ts) / 3.6e9 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), w AS (SELECT session, i, t AS last, true AS due FROM e WHERE i = 1 UNION ALL SELECT e.session, e.i, CASE WHEN e.t - w.last >= 24 THEN e.t ELSE w.last END, e.t - w.last >= 24 FROM w JOIN e ON e.session = w.session AND e.i = w.i + 1) SELECT session, round(last, 4) AS at FROM w WHERE due",
    "window_layout": f"WITH {TIMED_SQL}, n AS (SELECT id, duration, greatest(CAST(floor(duration / 6) AS BIGINT) - CASE WHEN duration % 6 <= 1 THEN 1 ELSE 0 END, 0) AS n, greatest(ceil(duration / 27), 1) AS c FROM timed WHERE duration IS NOT NULL) SELECT id, n + CASE WHEN n * 6 < duration THEN 1 ELSE 0 END AS windows, round(CASE WHEN n * 6 < duration THEN duration - n * 6 ELSE 6 END, 3) AS tail, CAST(c AS INTEGER) AS chunks, round(duration / c, 4) AS length FROM n",
}
