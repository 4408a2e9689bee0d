"""Queries of the timeline operators on the turns, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.operators import timeline as L
from lakeloom.operators.relations import in_ranges
from lakeloom.plans.views import RECORDS_SQL, TURNS_SQL, deliveries, records, turns
from lakeloom.session import stored
from lakeloom.sources.tables import table


def interval_union(spark, d):
    """Speech of each speaker as disjoint spans."""
    return L.islands(turns(spark, d).where("speaker is not null").select("window_id", "speaker", "s", "e"), ["window_id", "speaker"])


def overlap_seconds(spark, d):
    """Time in which two speakers or more are active, per window."""
    own = L.islands(turns(spark, d).where("speaker is not null"), ["window_id", "speaker"])
    a = L.active_spans(own, ["window_id"]).withColumn("n", F.col("e") - F.col("s"))
    return a.groupBy("window_id").agg(F.sum(F.when(F.col("active") >= 1, F.col("n")).otherwise(0)).alias("speech"), F.sum(F.when(F.col("active") >= 2, F.col("n")).otherwise(0)).alias("overlap"), F.max("active").alias("most"))


def turn_gaps(spark, d):
    """Median gap at speaker changes and the share of negative ones."""
    g = L.speaker_change_gaps(turns(spark, d))
    return g.groupBy("window_id").agg(F.count("*").alias("changes"), F.round(F.median("gap"), 2).alias("median_gap"), F.round(F.avg((F.col("gap") < 0).cast("double")), 6).alias("negative"))


def self_overlap(spark, d):
    """W4, I22."""
    return L.self_overlaps(turns(spark, d)).select("turn_id", "window_id", "speaker")


def speaker_relabel(spark, d):
    """W3, I22."""
    return L.first_speech_labels(turns(spark, d))


def overlap_category(spark, d):
    """I5, I6, J11."""
    return L.overlap_categories(turns(spark, d))


def turn_overlap_pairs(spark, d):
    """Overlapping turns of different speakers."""
    t = turns(spark, d).where("speaker is not null").select("turn_id", "window_id", "speaker", "s", "e")
    p = L.overlapping(t, t, ["window_id"]).where("a_turn_id < b_turn_id and a_speaker <> b_speaker")
    return p.groupBy(F.col("a_window_id").alias("window_id")).agg(F.count("*").alias("pairs"), F.sum(F.least("a_e", "b_e") - F.greatest("a_s", "b_s")).alias("shared"))


def nearby_turns(spark, d):
    """Turns of others within two seconds."""
    t = turns(spark, d).where("speaker is not null").select("turn_id", "window_id", "speaker", "s", "e")
    p = L.overlapping(t, t, ["window_id"], margin=200).where("a_speaker <> b_speaker")
    return p.groupBy(F.col("a_turn_id").alias("turn_id")).agg(F.count("*").alias("near"))


def closest_turn(spark, d):
    """Of the turns of others within 15 s the one that starts closest, as its SQL has it; J13 and I12 compare texts: ``start_offsets``."""
    t = turns(spark, d).where("speaker is not null").select("turn_id", "window_id", "speaker", "s", "e")
    p = L.overlapping(t, t, ["window_id"], margin=1500).where("a_speaker <> b_speaker")
    off = F.abs(F.col("a_s") - F.col("b_s"))
    return p.groupBy(F.col("a_turn_id").alias("turn_id")).agg(F.min(F.struct(off.alias("off"), F.col("b_turn_id").alias("closest"))).alias("m")).select("turn_id", "m.closest", "m.off")


def start_offsets(spark, d):
    """Of each turn's latest delivery the most similar turn of the first deliveries that starts within 15 s, whoever
    speaks, and how much later that one starts.

    As in ``diarization_errors`` the latest deliveries are the reference. Only turns of at least 10 characters (letters,
    digits, ideographs) with a best normalised indel similarity of at least 0.7 have a row; of equal ones the one that
    starts first, then the smaller id, is taken.
    """
    both = stored(deliveries(spark, d).select("turn_id", F.struct("last.window_id", "last.s", L.plain_text(F.col("last.text")).alias("text")).alias("last"), F.struct("first.window_id", "first.s", L.plain_text(F.col("first.text")).alias("text")).alias("first"), F.expr("last.e > last.s").alias("last_ok"), F.expr("first.e > first.s").alias("first_ok")))
    ref, hyp = (both.where(f"{x}_ok").select("turn_id", f"{x}.window_id", f"{x}.s", f"{x}.text") for x in ("last", "first"))
    return L.similar_starts(ref, hyp, plain=True).select("turn_id", "window_id", "match", F.round("similarity", 6).alias("similarity"), "off")


def late_starts(spark, d):
    """Of each window's turns in ``start_offsets`` the share that is off by more than a second."""
    return start_offsets(spark, d).groupBy("window_id").agg(F.count("*").alias("matched"), F.round(F.avg((F.abs("off") > 100).cast("double")), 6).alias("late"))


def activity_frames(spark, d):
    """Frames of a second: 1 the first speaker, 2 others, 3 both."""
    t = turns(spark, d).where("speaker is not null")
    f = L.frames(t, 100, F.when(F.col("speaker") == "S1", 1).otherwise(2))
    return f.groupBy("window_id", "code").agg(F.count("*").alias("frames"))


def activity_runs(spark, d):
    """I2."""
    t = turns(spark, d).where("speaker is not null")
    return L.frame_runs(L.frames(t, 100, F.when(F.col("speaker") == "S1", 1).otherwise(2)))


def sliding(spark, d):
    """W12, I24."""
    return L.sliding_windows(turns(spark, d), 3000, 100)


def solo_spans(spark, d):
    """Spans minus those of all others."""
    return L.solo(turns(spark, d), 50)


def uncovered_speech(spark, d):
    """Of each turn without speaker what named turns leave uncovered."""
    t = turns(spark, d)
    bare = t.where("speaker is null").select("turn_id", "window_id", "s", "e")
    c = L.covered(bare, t.where("speaker is not null").select("window_id", "s", "e"), ["window_id"], "turn_id")
    return bare.join(c, "turn_id").select("turn_id", (F.col("e") - F.col("s") - F.col("covered")).alias("uncovered"))


def segment_bounds(spark, d):
    """I8: whether each record's segments lie inside its window, and how many start before the one above ends."""
    seg = "array<struct<speaker: string, start: double, duration: double, text: string>>"
    r = records(spark, d).select("id", F.get("audio_slots", F.lit(0))["ref"]["duration"].alias("total"), F.posexplode(F.from_json("metadata", f"segments {seg}")["segments"]).alias("pos", "x"))
    w = Window.partitionBy("id").orderBy("x.start", "pos")
    r = r.withColumn("prev", F.lag(F.col("x.start") + F.col("x.duration")).over(w))
    return r.groupBy("id").agg(F.min(((F.col("x.start") >= 0) & (F.col("x.start") + F.col("x.duration") <= F.col("total") + 1e-6)).cast("int")).alias("inside"), F.sum((F.col("x.start") < F.col("prev") - 1e-6).cast("int")).alias("overlaps"))


def cursor_placement(spark, d):
    """Turns laid end to end with a gap of half a second, in hash order."""
    t = turns(spark, d).select("turn_id", "window_id", "s", "e", F.sha2(F.col("turn_id").cast("string"), 256).alias("h"))
    return L.running_total(t, ["window_id"], F.substring("h", 1, 2), F.col("h"), F.col("e") - F.col("s") + 50, "placed").select("turn_id", "placed")


def mixture_timing(spark, d):
    """How the second-longest speaker of a window lies to the longest: lead, trail, enter, leave, middle."""
    s = turns(spark, d).where("speaker is not null").groupBy("window_id", "speaker").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.sum(F.col("e") - F.col("s")).alias("n"))
    w = Window.partitionBy("window_id").orderBy(F.desc("n"), "speaker")
    r = s.withColumn("rn", F.row_number().over(w)).where("rn <= 2").groupBy("window_id").agg(*[F.max(F.when(F.col("rn") == k, F.col(c))).alias(f"{c}{k}") for k in (1, 2) for c in ("s", "e")]).where("s2 is not null")
    kind = F.when(F.col("e2") <= F.col("s1"), "lead").when(F.col("s2") >= F.col("e1"), "trail").when((F.col("s2") < F.col("s1")) & (F.col("e2") <= F.col("e1")), "enter").when((F.col("s2") >= F.col("s1")) & (F.col("e2") > F.col("e1")), "leave").when((F.col("s2") >= F.col("s1")) & (F.col("e2") <= F.col("e1")), "middle").otherwise("around")
    return r.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def speech_rate(spark, d):
    """Characters a second and backchannels a minute."""
    t = turns(spark, d).where("chars is not null")
    return t.groupBy("window_id").agg(F.round(F.sum("chars") / (F.sum(F.col("e") - F.col("s")) / 100), 4).alias("chars_per_s"), F.round(F.sum((F.col("chars") <= 2).cast("int")) / ((F.max("e") - F.min("s")) / 6000), 4).alias("backchannels_per_min"))


def quiet_days(spark, d):
    """Gaps between changes of a user's event type."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("prev", F.lag("event_type").over(w)).where("prev is null or prev <> event_type")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    gaps = e.withColumn("gap", us - F.lag(us).over(w)).where("gap is not null")
    return gaps.groupBy("user_id").agg(F.count("*").alias("changes"), F.max("gap").alias("longest_us"))


def attempts(spark, d):
    """First and latest delivery of each record."""
    r = table(spark, d, "audio_records").groupBy("id").agg(F.min("ingested_at").alias("first"), F.max("ingested_at").alias("latest"), F.count("*").alias("deliveries")).where("deliveries > 1")
    return r.select("id", F.unix_micros("first").alias("first_us"), F.unix_micros("latest").alias("latest_us"), "deliveries")


def record_sources(spark, d):
    """The source of every thousandth record, and its place there, with sources end to end by name."""
    n = records(spark, d).groupBy("dataset_id").agg(F.count("*").alias("n"))
    w = Window.orderBy("dataset_id")
    ends = n.select("dataset_id", F.sum("n").over(w).alias("stop"), (F.sum("n").over(w) - F.col("n")).alias("start"))
    probe = n.agg(F.sum("n").alias("total")).where("total > 0").select(F.explode(F.sequence(F.lit(0), F.col("total") - 1, F.lit(1000))).alias("ix"))
    return in_ranges(probe, ends, "ix").select("ix", "dataset_id", (F.col("ix") - F.col("start")).alias("local"))


def growth(spark, d):
    """Order value by customer and year that more than doubled and passed a floor."""
    o = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    w = Window.partitionBy("o_custkey").orderBy("year")
    return o.withColumn("before", F.lag("total").over(w)).where("total > 2 * before and total > 300000").select("o_custkey", "year", F.round(F.col("total") / F.col("before"), 4).alias("ratio"))


def audit_annotations(spark, d):
    """Windows without statistics, turns outside their window, and turns without label."""
    t = turns(spark, d)
    s = table(spark, d, "label_stats").groupBy("window_id").agg(F.max("duration_s").alias("total"))
    j = t.join(s, "window_id", "left")
    return j.groupBy("dataset_id").agg(F.sum(F.col("total").isNull().cast("int")).alias("unmatched"), F.sum((F.col("e") > F.round((F.col("total") + 1) * 100)).cast("int")).alias("outside"), F.sum(F.when(F.col("speaker").isNull(), F.col("e") - F.col("s")).otherwise(0)).alias("unlabelled"))


QUERIES = {f.__name__: f for f in [interval_union, overlap_seconds, turn_gaps, self_overlap, speaker_relabel, overlap_category, turn_overlap_pairs, nearby_turns, closest_turn, start_offsets, late_starts, activity_frames, activity_runs, sliding, solo_spans, uncovered_speech, segment_bounds, cursor_placement, mixture_timing, speech_rate, quiet_days, attempts, record_sources, growth, audit_annotations]}

_ISLANDS = "SELECT {k}, min(s) AS s, max(e) AS e FROM (SELECT *, sum(new) OVER (PARTITION BY {k} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY {k} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM {t})) GROUP BY {k}, i"
_OWN = f"{TURNS_SQL}, named AS (SELECT * FROM t WHERE speaker IS NOT NULL), own AS ({_ISLANDS.format(k='window_id, speaker', t='named')})"
_ACTIVE = "SELECT window_id, x AS s, lead(x) OVER (PARTITION BY window_id ORDER BY x) AS e, sum(d) OVER (PARTITION BY window_id ORDER BY x) AS active FROM (SELECT window_id, x, sum(d) AS d FROM (SELECT window_id, s AS x, 1 AS d FROM own UNION ALL SELECT window_id, e, -1 FROM own) GROUP BY ALL)"
_FRAMES = "frames AS (SELECT window_id, frame, bit_or(bit) AS code FROM (SELECT window_id, CASE WHEN speaker = 'S1' THEN 1 ELSE 2 END AS bit, unnest(range(CAST(floor(s / 100) AS BIGINT), CAST(ceil(e / 100) AS BIGINT))) AS frame FROM t WHERE speaker IS NOT NULL) GROUP BY ALL)"
SQL = {
    "interval_union": f"WITH {_OWN} SELECT * FROM own",
    "overlap_seconds": f"WITH {_OWN}, a AS ({_ACTIVE}) SELECT window_id, CAST(sum(CASE WHEN active >= 1 THEN e - s ELSE 0 END) AS BIGINT) AS speech, CAST(sum(CASE WHEN active >= 2 THEN e - s ELSE 0 END) AS BIGINT) AS overlap, CAST(max(active) AS BIGINT) AS most FROM a WHERE e IS NOT NULL GROUP BY ALL",
    "turn_gaps": f"WITH {TURNS_SQL}, n AS (SELECT window_id, speaker, lead(speaker) OVER w AS ns, lead(s) OVER w - e AS gap FROM t WINDOW w AS (PARTITION BY window_id ORDER BY s, e, turn_id)) SELECT window_id, count(*) AS changes, round(median(gap), 2) AS median_gap, round(avg((gap < 0)::INT), 6) AS negative FROM n WHERE ns <> speaker GROUP BY ALL",
    "self_overlap": f"WITH {TURNS_SQL} SELECT turn_id, window_id, speaker FROM (SELECT *, max(e) OVER (PARTITION BY window_id, speaker ORDER BY s, e, turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM t WHERE speaker IS NOT NULL) WHERE s < top",
    "speaker_relabel": f"WITH {TURNS_SQL}, f AS (SELECT window_id, speaker, min(s) AS first FROM t WHERE speaker IS NOT NULL GROUP BY ALL) SELECT window_id, speaker, 'S' || dense_rank() OVER (PARTITION BY window_id ORDER BY first, speaker) AS label FROM f",
    "overlap_category": f"""WITH {TURNS_SQL}, p AS (SELECT a.turn_id, a.s AS a_s, a.e AS a_e, b.chars, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM t a JOIN t b ON a.window_id = b.window_id AND a.speaker <> b.speaker AND a.s < b.e AND b.s < a.e WHERE a.chars > 3),
u AS ({_ISLANDS.format(k='turn_id', t='p')}), c AS (SELECT turn_id, sum(e - s) AS covered FROM u GROUP BY ALL), l AS (SELECT turn_id, max(coalesce(chars, 0)) AS largest FROM p GROUP BY ALL)
SELECT t.turn_id, CASE WHEN largest IS NULL THEN 'none' WHEN largest <= 2 THEN 'backchannel_only' WHEN covered / (e - s) < 0.3 THEN 'light' WHEN covered / (e - s) < 0.7 THEN 'medium' ELSE 'heavy' END AS category FROM t LEFT JOIN c USING (turn_id) LEFT JOIN l USING (turn_id) WHERE t.chars > 3 AND t.speaker IS NOT NULL""",
    "turn_overlap_pairs": f"WITH {TURNS_SQL} SELECT a.window_id, count(*) AS pairs, CAST(sum(least(a.e, b.e) - greatest(a.s, b.s)) AS BIGINT) AS shared FROM t a JOIN t b ON a.window_id = b.window_id AND a.turn_id < b.turn_id AND a.speaker <> b.speaker AND a.s < b.e AND b.s < a.e GROUP BY ALL",
    "nearby_turns": f"WITH {TURNS_SQL}, x AS (SELECT * FROM t WHERE speaker IS NOT NULL) SELECT a.turn_id, count(*) AS near FROM x a JOIN x b ON a.window_id = b.window_id AND a.speaker <> b.speaker AND a.s - 200 < b.e AND b.s < a.e + 200 GROUP BY ALL",
    "closest_turn": f"WITH {TURNS_SQL}, x AS (SELECT * FROM t WHERE speaker IS NOT NULL), p AS (SELECT a.turn_id, b.turn_id AS closest, abs(a.s - b.s) AS off FROM x a JOIN x b ON a.window_id = b.window_id AND a.speaker <> b.speaker AND a.s - 1500 < b.e AND b.s < a.e + 1500) SELECT turn_id, closest, off FROM (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY off, closest) AS rn FROM p) WHERE rn = 1",
    "activity_frames": f"WITH {TURNS_SQL}, {_FRAMES} SELECT window_id, code, count(*) AS frames FROM frames GROUP BY ALL",
    "activity_runs": f"WITH {TURNS_SQL}, {_FRAMES}, n AS (SELECT *, frame - row_number() OVER (PARTITION BY window_id, code ORDER BY frame) AS run FROM frames) SELECT window_id, code, min(frame) AS first, max(frame) AS last FROM n GROUP BY window_id, code, run",
    "sliding": f"""WITH {TURNS_SQL}, ends AS (SELECT window_id, max(e) AS total FROM t GROUP BY ALL), k AS (SELECT *, CASE WHEN total >= 3000 THEN CAST(floor((total - 3000) / 1500) AS BIGINT) ELSE -1 END AS last FROM ends),
made AS (SELECT window_id, unnest(range(0, last + 1)) * 1500 AS w_start FROM k UNION SELECT window_id, greatest(total - 3000, 0) FROM k WHERE total - CASE WHEN last >= 0 THEN last * 1500 + 3000 ELSE 0 END > 100)
SELECT m.window_id, m.w_start, count(t.turn_id) AS turns FROM made m LEFT JOIN t ON t.window_id = m.window_id AND t.s >= m.w_start AND t.e <= m.w_start + 3000 GROUP BY ALL""",
    "solo_spans": f"WITH {_OWN}, a AS ({_ACTIVE}), alone AS (SELECT a.window_id, o.speaker, a.s, a.e FROM a JOIN own o ON o.window_id = a.window_id AND o.s < a.e AND a.s < o.e WHERE a.active = 1 AND a.e IS NOT NULL), u AS ({_ISLANDS.format(k='window_id, speaker', t='alone')}) SELECT * FROM u WHERE e - s >= 50",
    "uncovered_speech": f"WITH {TURNS_SQL}, named AS (SELECT * FROM t WHERE speaker IS NOT NULL), u AS ({_ISLANDS.format(k='window_id', t='named')}) SELECT a.turn_id, CAST(a.e - a.s - coalesce(sum(CASE WHEN u.s IS NOT NULL THEN least(a.e, u.e) - greatest(a.s, u.s) END), 0) AS BIGINT) AS uncovered FROM t a LEFT JOIN u ON u.window_id = a.window_id AND u.s < a.e AND a.s < u.e WHERE a.speaker IS NULL GROUP BY a.turn_id, a.e, a.s",
    "segment_bounds": f"""WITH {RECORDS_SQL}, x AS (SELECT id, audio_slots[1].ref.duration AS total, unnest(CAST(json_extract(metadata, '$.segments[*]') AS JSON[])) AS x, generate_subscripts(CAST(json_extract(metadata, '$.segments[*]') AS JSON[]), 1) AS pos FROM records),
y AS (SELECT id, total, pos, CAST(x->>'start' AS DOUBLE) AS s, CAST(x->>'start' AS DOUBLE) + CAST(x->>'duration' AS DOUBLE) AS e FROM x), z AS (SELECT *, lag(e) OVER (PARTITION BY id ORDER BY s, pos) AS prev FROM y)
SELECT id, min((s >= 0 AND e <= total + 1e-6)::INT) AS inside, sum((s < prev - 1e-6)::INT) AS overlaps FROM z GROUP BY ALL""",
    "cursor_placement": f"WITH {TURNS_SQL} SELECT turn_id, CAST(coalesce(sum(e - s + 50) OVER (PARTITION BY window_id ORDER BY sha256(CAST(turn_id AS VARCHAR)) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS placed FROM t",
    "mixture_timing": f"""WITH {TURNS_SQL}, s AS (SELECT window_id, speaker, min(s) AS s, max(e) AS e, sum(e - s) AS n FROM t WHERE speaker IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY n DESC, speaker) AS rn FROM s),
j AS (SELECT a.s AS s1, a.e AS e1, b.s AS s2, b.e AS e2 FROM r a JOIN r b ON a.window_id = b.window_id AND a.rn = 1 AND b.rn = 2)
SELECT CASE WHEN e2 <= s1 THEN 'lead' WHEN s2 >= e1 THEN 'trail' WHEN s2 < s1 AND e2 <= e1 THEN 'enter' WHEN s2 >= s1 AND e2 > e1 THEN 'leave' WHEN s2 >= s1 AND e2 <= e1 THEN 'middle' ELSE 'around' END AS kind, count(*) AS n FROM j GROUP BY ALL""",
    "speech_rate": f"WITH {TURNS_SQL} SELECT window_id, round(sum(chars) / (sum(e - s) / 100), 4) AS chars_per_s, round(sum((chars <= 2)::INT) / ((max(e) - min(s)) / 6000), 4) AS backchannels_per_min FROM t WHERE chars IS NOT NULL GROUP BY ALL",
    "quiet_days": "WITH c AS (SELECT * FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NULL OR prev <> event_type), g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM c) SELECT user_id, count(*) AS changes, max(gap) AS longest_us FROM g WHERE gap IS NOT NULL GROUP BY ALL",
    "attempts": "SELECT id, epoch_us(min(ingested_at)) AS first_us, epoch_us(max(ingested_at)) AS latest_us, count(*) AS deliveries FROM audio_records GROUP BY id HAVING count(*) > 1",
    "record_sources": f"WITH {RECORDS_SQL}, n AS (SELECT dataset_id, count(*) AS n FROM records GROUP BY ALL), e AS (SELECT dataset_id, sum(n) OVER (ORDER BY dataset_id NULLS FIRST) AS stop, sum(n) OVER (ORDER BY dataset_id NULLS FIRST) - n AS start FROM n) SELECT r.ix, e.dataset_id, CAST(r.ix - e.start AS BIGINT) AS local FROM (SELECT unnest(range(0, (SELECT count(*) FROM records), 1000)) AS ix) r JOIN e ON r.ix >= e.start AND r.ix < e.stop",
    "growth": "WITH o AS (SELECT o_custkey, year(o_orderdate) AS year, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL), l AS (SELECT *, lag(total) OVER (PARTITION BY o_custkey ORDER BY year) AS before FROM o) SELECT o_custkey, year, round(total / before, 4) AS ratio FROM l WHERE total > 2 * before AND total > 300000",
    "audit_annotations": f"WITH {TURNS_SQL}, w AS (SELECT window_id, max(duration_s) AS total FROM label_stats GROUP BY ALL) SELECT dataset_id, sum((total IS NULL)::INT) AS unmatched, sum((e > round((total + 1) * 100))::INT) AS outside, CAST(sum(CASE WHEN speaker IS NULL THEN e - s ELSE 0 END) AS BIGINT) AS unlabelled FROM t LEFT JOIN w USING (window_id) GROUP BY ALL",
}
