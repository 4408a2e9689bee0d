"""Queries of the numeric kernels; embeddings stand for signals of 64 samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lakeloom.operators import waveform as G
from lakeloom.plans.views import INDEX_SQL, RECORDS_SQL, TIMED_SQL, TURNS_SQL, records, timed_records, turns
from lakeloom.sources.tables import table


def levels(spark, d):
    """Level in dBFS and RMS over samples."""
    return table(spark, d, "embeddings").select("vec_id", F.round(G.dbfs(F.col("embedding")), 4).alias("dbfs"), F.round(G.active_rms(F.col("embedding")), 5).alias("rms"))


def gains(spark, d):
    """At +20 dB within a peak of 0.99."""
    y = G.with_gain(F.col("embedding"), F.lit(20.0))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.array_max(F.transform(y, lambda v: F.abs(v))), 4).alias("peak"), F.round(G.dbfs(y), 3).alias("dbfs"))


def reverberation(spark, d):
    """Sabine times of parts as rooms, and direct-to-reverberant ratios of vectors as responses."""
    return table(spark, d, "embeddings").select("vec_id", F.round(G.direct_to_reverberant_db(F.col("embedding"), 3), 3).alias("drr"), F.round(G.sabine_t60(F.col("vec_id") + 30.0, F.col("vec_id") + 60.0, F.lit(0.3)), 5).alias("t60"))


def frame_levels(spark, d):
    """The 95th percentile of the energy of frames of 8 samples."""
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    f = e.groupBy("vec_id", F.floor(F.col("pos") / 8).alias("frame")).agg(F.avg(F.col("x").cast("double") * F.col("x").cast("double")).alias("energy"))
    return f.groupBy("vec_id").agg(F.round(F.percentile("energy", 0.95), 6).alias("loud"))


def sampling_costs(spark, d):
    """Cost of a record: its slots' durations at the slowest speed, and two padded seconds per enrolment."""
    i = table(spark, d, "audio_index").groupBy("cut_id").agg(F.max("duration").alias("duration"))
    s = records(spark, d).select("id", "task", F.explode("audio_slots").alias("s")).select("id", "task", F.col("s.ref.cut_id").alias("cut_id"), F.col("s.ref.duration").alias("own"))
    c = s.join(i, "cut_id", "left").groupBy("id", "task").agg(F.sum(F.coalesce("own", "duration") / 0.9 + 1 / 16000).alias("base"), F.count("*").alias("slots"))
    return c.select("id", F.round(F.col("base") + F.when(F.col("task") == "target_speaker_asr", 2.16).otherwise(0.0), 4).alias("cost"), F.when(F.col("task") == "target_speaker_asr", 1).otherwise(F.col("slots")).alias("slot_class"))


def timestamps(spark, d):
    """Which strings are RFC 3339 times, and ages in days."""
    t = table(spark, d, "audio_records").select("id", F.when(F.length("id") % 3 == 0, F.date_format("ingested_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("ingested_at", "yyyy-MM-dd HH:mm")).alias("s"), F.to_date("ingested_at").alias("day"))
    ok = F.col("s").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$")
    return t.groupBy(ok.alias("valid"), F.floor(F.datediff(F.lit("2026-04-01").cast("date"), "day") / 30).alias("months")).agg(F.count("*").alias("n"))


def family_keys(spark, d):
    """Keys out of ids and their hashes as integers."""
    r = records(spark, d).where("source_record_id is not null").select("id", F.element_at(F.split("id", "-"), -1).alias("number"), F.element_at(F.split("id", "-"), -2).alias("part"))
    return r.select("id", "part", F.pmod(F.conv(F.substring(F.sha2("number", 256), 1, 15), 16, 10).cast("long"), F.lit(1000)).alias("h"))


def augmented(spark, d):
    """Signals resampled, reverberated, mixed with the reversed signal, and degraded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ratio = G.speed_ratio(1 / 0.9)
        for p in batches:
            out = []
            for k, v in zip(p["vec_id"], p["embedding"]):
                x = np.asarray(v, float)
                y = G.hop_padded(G.resampled(G.mono(np.stack([x, x])), ratio), 8)
                z = G.reverberant(y, np.r_[0.0, 1.0, 0.3, 0.1])
                m = G.mixed(z, [(y[::-1], 10, 5.0), (G.noise_floor(len(y), -40, "pink", int(k)), 0, 20.0)])
                t = G.without_digital_silence(G.telephone(m, 16000), 8)
                out.append((k, len(t), float(np.abs(m).max()), float(np.sqrt((t * t).mean()))))
            if out:
                yield pd.DataFrame(out, columns=["vec_id", "samples", "peak", "rms"])

    return table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, samples int, peak double, rms double").select("vec_id", "samples", F.round("peak", 6).alias("peak"), F.round("rms", 6).alias("rms"))


def enrollment_signals(spark, d):
    """Each signal cropped, contaminated with its own reverse, padded by reflection, masked as a feature
    table, and placed twice in a room: lengths and levels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        room = np.r_[1.0, 0.4, 0.2]
        for p in batches:
            out = []
            for k, v in zip(p["vec_id"], p["embedding"]):
                x = np.asarray(v, float)
                crop = G.cropped(x, (int(k) % 10) / 10, 3 * len(x) // 4)
                dirty = G.contaminated(crop, x[::-1], 0.25, 5.0)
                whole = G.reflected(dirty, len(x))
                mask = G.masked(whole[: len(x) // 4 * 4].reshape(4, -1), 1, 2, 1, int(k))
                meeting = G.placed_in_rooms([crop, dirty], [room, room[:1]], [-20.0, -23.0], [0, len(crop) // 2], 20.0, int(k))
                out.append((k, len(crop), float(np.square(dirty - crop).sum()), int((mask == 0).sum()), len(meeting), float(np.abs(meeting).max())))
            if out:
                yield pd.DataFrame(out, columns=["vec_id", "cropped", "contamination", "masked", "samples", "peak"])

    x = table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, cropped int, contamination double, masked int, samples int, peak double")
    return x.select("vec_id", "cropped", F.round("contamination", 6).alias("contamination"), "masked", "samples", F.round("peak", 6).alias("peak"))


QUERIES = {f.__name__: f for f in [levels, gains, reverberation, frame_levels, sampling_costs, timestamps, family_keys, augmented, enrollment_signals]}

_X = "x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"
_MS = "list_sum(list_transform({x}, lambda v: v * v)) / len({x})"
SQL = {
    "levels": f"WITH {_X} SELECT vec_id, round(10 * log10({_MS.format(x='x')} + 1e-12), 4) AS dbfs, round(sqrt({_MS.format(x='x')}), 5) AS rms FROM x",
    "gains": f"WITH {_X}, g AS (SELECT vec_id, x, list_max(list_transform(x, lambda v: abs(v * 10))) AS top FROM x), y AS (SELECT vec_id, list_transform(x, lambda v: v * 10 * CASE WHEN top > 0.99 THEN 0.99 / top ELSE 1 END) AS y FROM g) SELECT vec_id, round(list_max(list_transform(y, lambda v: abs(v))), 4) AS peak, round(10 * log10({_MS.format(x='y')} + 1e-12), 3) AS dbfs FROM y",
    "reverberation": f"WITH {_X}, p AS (SELECT vec_id, x, list_position(list_transform(x, lambda v: abs(v)), list_max(list_transform(x, lambda v: abs(v)))) AS k FROM x), e AS (SELECT vec_id, list_sum(list_transform(x[greatest(k - 3, 1):k + 3], lambda v: v * v)) AS dir, list_sum(list_transform(x, lambda v: v * v)) AS total FROM p) SELECT vec_id, round(10 * log10((dir + 1e-12) / (greatest(total - dir, 0) + 1e-12)), 3) AS drr, round(0.161 * (vec_id + 30.0) / ((vec_id + 60.0) * 0.3), 5) AS t60 FROM e",
    "frame_levels": "WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), f AS (SELECT vec_id, pos // 8 AS frame, avg(x * x) AS energy FROM e GROUP BY ALL) SELECT vec_id, round(quantile_cont(energy, 0.95), 6) AS loud FROM f GROUP BY ALL",
    "sampling_costs": f"WITH {RECORDS_SQL}, {INDEX_SQL}, s AS (SELECT id, task, unnest(audio_slots).ref AS r FROM records), c AS (SELECT id, task, sum(coalesce(s.r.duration, i.duration) / 0.9 + 1 / 16000) AS base, count(*) AS slots FROM s LEFT JOIN idx i ON i.cut_id = s.r.cut_id GROUP BY id, task) SELECT id, round(base + CASE WHEN task = 'target_speaker_asr' THEN 2.16 ELSE 0 END, 4) AS cost, CASE WHEN task = 'target_speaker_asr' THEN 1 ELSE slots END AS slot_class FROM c",
    "timestamps": "SELECT length(id) % 3 = 0 AS valid, CAST(floor(date_diff('day', CAST(ingested_at AS DATE), DATE '2026-04-01') / 30) AS BIGINT) AS months, count(*) AS n FROM audio_records GROUP BY ALL",
    "family_keys": f"WITH {RECORDS_SQL} SELECT id, string_split(id, '-')[-2] AS part, CAST(('0x' || substr(sha256(string_split(id, '-')[-1]), 1, 15)) AS BIGINT) % 1000 AS h FROM records WHERE source_record_id IS NOT NULL",
}
