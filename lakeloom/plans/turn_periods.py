"""Problem 2: continuous periods of speech and the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.intervals import active_counts, periods_and_gaps, run_bitmaps, to_units
from lakeloom.sources.tables import table

LONGEST_GAP_CS = 60_000


def latest_turns(turns: DataFrame) -> DataFrame:
    """(entity, start, end) in hundredths of a second of the latest delivery of each turn_id.

    Of deliveries with one ingested_at the smallest values win, nulls first, so ties have one result. Rows without
    turn_id can't be redeliveries of each other and all count. A null ingested_at is earlier than any other.
    """
    t = turns.select(
        "turn_id",
        F.col("window_id").alias("entity"),
        to_units(F.col("start_sec")).alias("start"),
        to_units(F.col("end_sec")).alias("end"),
        F.coalesce(F.col("ingested_at").cast("timestamp"), F.lit("0001-01-01").cast("timestamp")).alias("at"),
    )
    version = F.struct("at", *[F.struct(F.col(c).isNull().cast("int"), c) for c in ("entity", "start", "end")])
    best = t.where("turn_id is not null").groupBy("turn_id").agg(F.max(version).alias("v"))
    kept = best.select("v.col2.entity", "v.col3.start", "v.col4.end")
    return kept.unionByName(t.where("turn_id is null").select("entity", "start", "end"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(window_id, kind, start_cs, end_cs): periods covered by turns, and silences of up to 600 s between two of them."""
    found = periods_and_gaps(run_bitmaps(latest_turns(table(spark, sf_dir, "turns"))))
    return found.where((F.col("kind") == "period") | (F.col("end") - F.col("start") <= LONGEST_GAP_CS)).select(
        F.col("entity").alias("window_id"), "kind", F.col("start").alias("start_cs"), F.col("end").alias("end_cs")
    )


def p2_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per window the covered and overlapped time beside the latest published label_stats.overlap_time."""
    sums = active_counts(latest_turns(table(spark, sf_dir, "turns")))
    published = table(spark, sf_dir, "label_stats").where("window_id is not null").groupBy("window_id").agg(F.max(F.struct("published_at", "overlap_time")).alias("s"))
    return sums.join(published, sums["entity"] == published["window_id"], "left").select(
        F.col("entity").alias("window_id"),
        F.col("covered").alias("speech_cs"),
        F.col("overlapped").alias("overlap_cs"),
        F.round(F.col("overlapped") / F.col("covered"), 4).alias("overlap_share"),
        F.col("s.overlap_time").alias("published_share"),
    )


QUERIES = {"p2_found": p2_found, "p2_overlap": p2_overlap}

_LATEST = """
latest AS (
  SELECT window_id, CAST(round(start_sec * 100) AS BIGINT) AS s, CAST(round(end_sec * 100) AS BIGINT) AS e
  FROM (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY ingested_at DESC) AS rn FROM turns) WHERE rn = 1
),
ok AS (SELECT * FROM latest WHERE s IS NOT NULL AND e IS NOT NULL AND e > s)
"""
SQL = {
    "p2_found": f"""
WITH {_LATEST},
marked AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY window_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM ok),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY window_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM marked),
periods AS (SELECT window_id, min(s) AS s, max(e) AS e FROM numbered GROUP BY window_id, island),
gaps AS (SELECT window_id, e AS s, lead(s) OVER (PARTITION BY window_id ORDER BY s) AS e FROM periods)
SELECT window_id, 'period' AS kind, s AS start_cs, e AS end_cs FROM periods
UNION ALL SELECT window_id, 'gap', s, e FROM gaps WHERE e - s <= {LONGEST_GAP_CS}
""",
    "p2_overlap": f"""
WITH {_LATEST},
steps AS (SELECT window_id, t, sum(d) AS d FROM (SELECT window_id, s AS t, 1 AS d FROM ok UNION ALL SELECT window_id, e, -1 FROM ok) GROUP BY window_id, t),
spans AS (SELECT window_id, sum(d) OVER (PARTITION BY window_id ORDER BY t) AS active, lead(t) OVER (PARTITION BY window_id ORDER BY t) - t AS length FROM steps),
sums AS (SELECT window_id, coalesce(sum(CASE WHEN active >= 1 THEN length END), 0) AS c, coalesce(sum(CASE WHEN active >= 2 THEN length END), 0) AS o FROM spans GROUP BY window_id),
published AS (SELECT window_id, overlap_time FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY published_at DESC, overlap_time DESC NULLS LAST) AS rn FROM label_stats WHERE window_id IS NOT NULL) WHERE rn = 1)
SELECT s.window_id, CAST(c AS BIGINT) AS speech_cs, CAST(o AS BIGINT) AS overlap_cs, round(o / c, 4) AS overlap_share, p.overlap_time AS published_share
FROM sums s LEFT JOIN published p ON p.window_id = s.window_id
""",
}
