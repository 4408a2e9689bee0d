"""Queries of scene plans and sequential cuts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.operators import scenes as C
from lakeloom.plans.views import RECORDS_SQL, TURNS_SQL, records, turns
from lakeloom.sources.tables import table


_MODES = ["alternate", "burst", "short", "full"]


def scene_extents(spark, d):
    """Extents of windows as scenes, by mode."""
    t = turns(spark, d).where("speaker is not null").select("window_id", "speaker", ((F.col("e") - F.col("s")) / 100.0).alias("seconds"))
    return C.scene_extents(t, F.when(F.pmod(F.length("window_id"), F.lit(2)) == 0, "alternate").otherwise("burst"), 0.5).select("window_id", F.round("extent", 3).alias("extent"))


def scene_builds(spark, d):
    """Scenes of all windows, by mode."""
    mode = F.element_at(F.array(*[F.lit(m) for m in _MODES]), F.pmod(F.length("window_id"), F.lit(4)) + 1)
    return C.scene_starts(turns(spark, d), mode, 50)


def gap_cuts(spark, d):
    """W13."""
    return C.gap_windows(turns(spark, d), 3000)


def quiet_points(spark, d):
    """Cuts of vectors as energy curves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame({"vec_id": p["vec_id"], "cuts": [" ".join(map(str, C.quiet_cuts(np.square(np.asarray(v, float)), 16, 4))) for v in p["embedding"]]})

    return table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, cuts string")


def meeting_plan(spark, d):
    """Every window as a template, filled from all turns of the voice of each speaker's rank."""
    t = turns(spark, d).where("speaker is not null and chars is not null")
    m = t.select(F.expr("cast(substring(speaker, 2) as int)").alias("grp"), F.col("turn_id").alias("utt"), ((F.col("e") - F.col("s")) / 100.0).alias("duration"), "chars")
    return C.meeting_plans(t.select("window_id", "speaker", "s", "e", "chars"), m)


def room_groups(spark, d):
    """Rooms with at least ten positions, by the rule of their ids."""
    i = table(spark, d, "audio_index").select("cut_id").distinct()
    return i.groupBy(F.regexp_extract("cut_id", r"^(.*\d{3})\d{2}$", 1).alias("room")).agg(F.count("*").alias("positions")).where("room <> '' and positions >= 3")


def diarization_errors(spark, d):
    """Missed, false and confused time of the first deliveries against the latest, collar 0.25 s."""
    bounds = [F.round(F.col(c) * 100).cast("long").alias(n) for c, n in (("start_sec", "s"), ("end_sec", "e"))]
    t = table(spark, d, "turns").where("speaker is not null").select("turn_id", "window_id", F.upper(F.regexp_replace("speaker", "[^0-9]", "")).alias("speaker"), "ingested_at", *bounds).where("e > s")
    x = t.groupBy("turn_id").agg(F.min_by(F.struct("window_id", "speaker", "s", "e"), "ingested_at").alias("first"), F.max_by(F.struct("window_id", "speaker", "s", "e"), "ingested_at").alias("last"))
    sides = x.select(F.explode(F.array(F.struct(F.lit("ref").alias("side"), F.col("last").alias("t")), F.struct(F.lit("hyp").alias("side"), F.col("first").alias("t")))).alias("u")).select("u.side", "u.t.*")

    return C.diarization(sides, 25)


def duplicate_lines(spark, d):
    """A37."""
    return C.repeated_lines(turns(spark, d).where("speaker is not null"))


def session_lines(spark, d):
    """E5: lines of targets with the header each belongs to carried forward, unmatched ones joined to it."""
    r = records(spark, d).where("task = 'speaker_attributed_asr' and target is not null").select("id", F.posexplode(F.split("target", "\n")).alias("pos", "line"))
    head = F.when(F.col("line").rlike(r"^\[S\d+\]\[\d"), F.col("pos"))
    r = r.withColumn("head", F.last(head, ignorenulls=True).over(Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))).where("head is not null")
    return r.groupBy("id", "head").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ").alias("text"))


def latency_metrics(spark, d):
    """Per user the lag from each purchase to the next event, and the gaps between events."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, d, "events").withColumn("lag_s", (F.lead(us).over(w) - us) / 1e6)
    return e.groupBy("user_id").agg(F.round(F.avg(F.when(F.col("event_type") == "purchase", F.col("lag_s"))), 3).alias("after_purchase"), F.round(F.percentile("lag_s", 0.9), 3).alias("p90"))


QUERIES = {f.__name__: f for f in [scene_extents, scene_builds, gap_cuts, quiet_points, meeting_plan, room_groups, diarization_errors, duplicate_lines, session_lines, latency_metrics]}

_SPEECH = "SELECT window_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(new) OVER (PARTITION BY window_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY window_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM t)) GROUP BY window_id, i"
SQL = {
    "gap_cuts": f"WITH RECURSIVE {TURNS_SQL}, speech AS ({_SPEECH}), k AS (SELECT *, s // 360000 AS h, row_number() OVER (PARTITION BY window_id, s // 360000 ORDER BY s) AS i FROM speech), r AS (SELECT window_id, h, i, s AS first, e AS last FROM k WHERE i = 1 UNION ALL SELECT k.window_id, k.h, k.i, CASE WHEN k.e - r.first <= 3000 THEN r.first ELSE k.s END, k.e FROM r JOIN k ON k.window_id = r.window_id AND k.h = r.h AND k.i = r.i + 1) SELECT window_id, first AS s, max(last) AS e, CAST(count(*) AS INTEGER) AS periods FROM r GROUP BY window_id, h, first",
    "scene_extents": f"WITH {TURNS_SQL}, p AS (SELECT window_id, speaker, sum((e - s) / 100) AS total, count(*) AS n FROM t WHERE speaker IS NOT NULL GROUP BY ALL) SELECT window_id, round(CASE WHEN length(window_id) % 2 = 0 THEN sum(total) + 0.5 * (sum(n) - 1) ELSE max(total + 0.5 * (n - 1)) END, 3) AS extent FROM p GROUP BY window_id",
    "scene_builds": f"""WITH {TURNS_SQL}, m AS (SELECT *, ['alternate', 'burst', 'short', 'full'][length(window_id) % 4 + 1] AS mode FROM t WHERE speaker IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY window_id, speaker ORDER BY s, e, turn_id) AS k, min(s) OVER (PARTITION BY window_id) AS first FROM m WHERE mode <> 'short' OR e - s <= 200)
SELECT window_id, turn_id, CAST(CASE mode WHEN 'full' THEN s - first WHEN 'alternate' THEN coalesce(sum(e - s + 50) OVER (PARTITION BY window_id ORDER BY k, speaker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE coalesce(sum(e - s + 50) OVER (PARTITION BY window_id, speaker ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS BIGINT) AS start FROM k""",
    "quiet_points": "WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE) AS y, len(embedding) AS n FROM embeddings), r AS (SELECT vec_id, y, n, 0 AS pos, 0 AS k FROM v UNION ALL SELECT vec_id, y, n, CAST(pos + 12 + list_position(y[pos + 13:pos + 21], list_min(y[pos + 13:pos + 21])) - 1 AS INTEGER), k + 1 FROM r WHERE pos + 20 < n) SELECT vec_id, coalesce(string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY k) FILTER (WHERE k > 0), '') AS cuts FROM r GROUP BY vec_id",
    "room_groups": r"SELECT room, count(*) AS positions FROM (SELECT DISTINCT cut_id, regexp_extract(cut_id, '^(.*\d{3})\d{2}$', 1) AS room FROM audio_index) WHERE room <> '' GROUP BY room HAVING count(*) >= 3",
    "session_lines": rf"WITH {RECORDS_SQL}, l AS (SELECT id, unnest(string_split(target, chr(10))) AS line, generate_subscripts(string_split(target, chr(10)), 1) - 1 AS pos FROM records WHERE task = 'speaker_attributed_asr' AND target IS NOT NULL), h AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '^\[S\d+\]\[\d') THEN pos END IGNORE NULLS) OVER (PARTITION BY id ORDER BY pos) AS head FROM l) SELECT id, head, string_agg(line, ' ' ORDER BY pos) AS text FROM h WHERE head IS NOT NULL GROUP BY ALL",
    "latency_metrics": "WITH e AS (SELECT *, (lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) - epoch_us(ts)) / 1e6 AS lag_s FROM events) SELECT user_id, round(avg(CASE WHEN event_type = 'purchase' THEN lag_s END), 3) AS after_purchase, round(quantile_cont(lag_s, 0.9), 3) AS p90 FROM e GROUP BY ALL",
}
