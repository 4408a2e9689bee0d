"""Queries of the selection operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions.catalog import LANGUAGE_NAMES
from lakeloom.functions.draws import hash_sql, u, u_sql
from lakeloom.operators import selection as S
from lakeloom.operators.ordering import ordered_positions
from lakeloom.plans.views import CLEAN_SQL, MAIN_SQL, RECORDS_SQL, TIMED_SQL, records, timed_records
from lakeloom.session import broadcast_within
from lakeloom.sources.tables import table


def flagship_selection(spark, d):
    """Clean records of 1 to 30 s, hashed into train and dev, per dataset and part."""
    r = timed_records(spark, d).where("clean and duration between 1.0 and 30.0")
    part = F.when(S.hash_holdout(F.concat_ws(":", F.lit("42"), "dataset_id", "source_record_id"), 10), "dev").otherwise("train")
    return r.groupBy("dataset_id", part.alias("part")).agg(F.count("*").alias("records"), (F.sum(F.round(F.col("duration") * 1000).cast("long")) / 1000).alias("seconds"))


def clean_filter(spark, d):
    return records(spark, d).where(S.clean_pass(F.col("metadata"))).select("id", "task")


def clean_states(spark, d):
    """The three states of the flag."""
    return records(spark, d).groupBy(S.clean_flag(F.col("metadata")).alias("clean")).agg(F.count("*").alias("n"))


def supervision_clean(spark, d):
    """labelled segments inside their window."""
    seg = "array<struct<speaker: string, start: double, duration: double, text: string>>"
    r = records(spark, d).select("id", F.explode(F.from_json("metadata", f"segments {seg}")["segments"]).alias("s"), S.main_slot(F.col("audio_slots"))["ref"]["duration"].alias("cut_s"), S.clean_flag(F.col("metadata")).alias("flag"))
    return r.where(S.supervision_clean(F.col("s.start"), F.col("s.duration"), F.col("cut_s"), F.col("flag"))).groupBy("id").agg(F.count("*").alias("kept"))


def id_lists(spark, d):
    """Records listed by the index, without those of test splits."""
    r = timed_records(spark, d)
    listed = table(spark, d, "audio_index").select("cut_id").distinct()
    barred = table(spark, d, "turns").where("split = 'eval'").select("cut_id")
    kept = S.exclude_ids(S.include_ids(r.select("id", "cut_id"), listed, "cut_id"), barred, "cut_id")
    return kept.select("id")


def prefixed_ids(spark, d):
    """cuts allowed by path stem, with or without a folder."""
    stem = F.regexp_extract("relative_path", r"([^/]+)\.[a-z0-9]+$", 1)
    cuts = table(spark, d, "audio_index").select(F.col("cut_id").alias("id"), "root_alias").distinct()
    allowed = table(spark, d, "audio_index").select(F.concat(F.lit("x:"), stem).alias("id")).unionByName(table(spark, d, "audio_index").where("channels = 1").select(F.col("cut_id").alias("id")))
    return S.allow_prefixed(cuts, allowed, F.lit("x:")).select("id").distinct()


def duration_range(spark, d):
    return timed_records(spark, d).where("duration >= 2.5 and duration <= 12.0").select("id", F.round("duration", 3).alias("duration"))


def holdout_antijoin(spark, d):
    """Training records none of whose cuts is used by an evaluation record."""
    r = records(spark, d).where("audio_slots is not null").select("id", "split", F.transform("audio_slots", lambda s: s["ref"]["cut_id"]).alias("cuts"))
    held = r.where("split in ('dev', 'eval')").select(F.explode("cuts").alias("key"))
    return S.holdout_anti(r.where("split = 'train'"), held, F.col("cuts")).select("id")


def speaker_exclusion(spark, d):
    """turns without two named speakers."""
    return table(spark, d, "turns").where(~F.coalesce(F.col("speaker").isin("S1", "S2"), F.lit(False))).groupBy("window_id").agg(F.count("*").alias("turns"))


def record_query(spark, d):
    """Pushed-down predicates on task, language, split and flag."""
    r = records(spark, d).where((F.col("task") == "asr") & F.col("language").isin("zh", "en") & F.col("split").isin("train", "tr_extra"))
    return r.where(S.clean_pass(F.col("metadata"))).select("id", "language", "split")


def sql_filter(spark, d):
    """A filter given as an SQL string, with the required text."""
    return table(spark, d, "documents").where("text is not null and (n_chars > 200 and lang = 'zh')").select("doc_id", "n_chars")


def read_rules(spark, d):
    """why documents can't be read as transcripts."""
    t = table(spark, d, "documents").where("text is not null")
    reason = S.read_rule_reason(F.col("text"), F.col("lang"), F.lit("train"), F.col("n_chars") / 15.0, 120.0)
    return t.groupBy("doc_kind", F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def task_support(spark, d):
    """records whose dataset version doesn't list their task; a thirtieth, by hash, are given one that none lists."""
    planted = F.when(F.substring(F.sha2("id", 256), 1, 2) < "08", F.lit("translation")).otherwise(F.col("task"))
    c = table(spark, d, "dataset_catalog").select("dataset_id", "version", "tasks")
    return records(spark, d).withColumn("task", planted).join(F.broadcast(c), ["dataset_id", "version"]).where(~F.array_contains("tasks", F.col("task"))).groupBy("dataset_id", "version", "task").agg(F.count("*").alias("n"))


def hash_partition(spark, d):
    """F16: mixtures held out by family."""
    r = records(spark, d).where("source_record_id like '%|%'")
    family = S.mixture_family(F.col("source_record_id"))
    held = S.hash_holdout(F.concat_ws(":", F.lit("7"), "dataset_id", family), 5)
    return r.select("id", family.alias("family"), held.alias("held_out"))


def hotword_valid(spark, d):
    """hotwords of 2 to 8 characters, spaces apart."""
    w = records(spark, d).select("id", F.explode("hotwords").alias("w"))
    n = F.length(F.regexp_replace(F.trim("w"), " ", ""))
    return w.groupBy(n.between(2, 8).alias("valid")).agg(F.count("*").alias("n"), F.count_distinct("w").alias("words"))


def validation_limit(spark, d):
    """A bounded validation subset, in proportion to the splits' sizes."""
    v = timed_records(spark, d).where("split in ('dev', 'eval', 'train_probe') and duration <= 150.0")
    return S.capped_subset_counts(v.groupBy("dataset_id").agg(F.count("*").alias("n")), 100, ["dataset_id"])


def material_mask(spark, d):
    """usable turns: short overlap, or a backchannel of two characters or less."""
    t = table(spark, d, "turns").where("end_sec > start_sec and chars is not null")
    ok = (F.col("chars") <= 2) | ((F.col("chars") > 2) & (F.col("end_sec") - F.col("start_sec") >= 1.0) & F.col("speaker").isNotNull())
    return t.groupBy(ok.alias("eligible"), (F.col("chars") <= 2).alias("backchannel")).agg(F.count("*").alias("n"))


def whole_meetings(spark, d):
    """windows of at least two speakers outside the evaluation windows."""
    t = table(spark, d, "turns").where("speaker is not null")
    kept = t.join(t.where("split in ('dev', 'eval')").select("window_id").distinct(), "window_id", "left_anti")
    return kept.groupBy("window_id").agg(F.count_distinct("speaker").alias("speakers")).where("speakers >= 2")


def name_filter(spark, d):
    """far-field names that aren't small rooms."""
    n = F.lower("relative_path")
    return table(spark, d, "audio_index").where(n.contains("qm") & ~n.contains("qmn")).select("cut_id").distinct()


def keep_closest(spark, d):
    """of each brand the half of the parts whose size is closest to 25, at least one."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", F.abs(F.col("p_size") - 25).alias("off"))
    n = p.groupBy("p_brand").agg(F.greatest(F.lit(1), F.floor(F.count("*") * 0.5)).alias("keep"))
    return ordered_positions(p, ["p_brand"], ["off", "p_partkey"]).join(broadcast_within(n), "p_brand").where("ix < keep").select("p_partkey", "p_brand", (F.col("ix") + 1).alias("rn"))


def nearest_rooms(spark, d):
    """in a range, the nearest 8, of these the 5 smallest, then the top fifth of their rows."""
    from pyspark.sql import Window

    s = table(spark, d, "supplier").where("s_acctbal between 0 and 9000")
    near = S.top_per_key(s, ["s_nationkey"], 8, [F.abs(F.col("s_acctbal") - 4000), F.col("s_suppkey")]).drop("rank")
    small = S.top_per_key(near, ["s_nationkey"], 5, [F.col("s_acctbal"), F.col("s_suppkey")]).drop("rank")
    w = Window.partitionBy("s_nationkey")
    return small.withColumn("n", F.count("*").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("s_acctbal"), "s_suppkey"))).where("rn <= greatest(1, floor(n / 5))").select("s_nationkey", "s_suppkey")


def finite_numbers(spark, d):
    """finite values only."""
    v = F.when(F.col("value") > 400, F.lit(float("inf"))).when(F.col("value") < 1, F.lit(float("nan"))).otherwise(F.col("value"))
    e = table(spark, d, "events").withColumn("v", v)
    return e.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf"))).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total"))


def superseded_versions(spark, d):
    """dataset versions from which no newer one is derived; a pointer to nothing stays visible."""
    c = table(spark, d, "dataset_catalog").withColumn("ref", F.concat_ws("@", "dataset_id", "version"))
    old = c.where("derived_from is not null").select(F.col("derived_from").alias("ref"))
    dangling = old.join(c.select("ref"), "ref", "left_anti")
    return c.join(old, "ref", "left_anti").select("ref", F.lit("current").alias("state")).unionByName(dangling.select("ref", F.lit("dangling").alias("state")))


def cell_minimum(spark, d):
    """cells with at least 5 rows."""
    return records(spark, d).groupBy("dataset_id", "task", "split").agg(F.count("*").alias("n")).where("n >= 5")


def index_spot_check(spark, d):
    """A seeded sample of 50 index rows whose frames don't fit their duration."""
    i = table(spark, d, "audio_index").where("duration is not null").select("cut_id", "num_frames", "sample_rate", "duration").distinct()
    picked = i.orderBy(F.sha2(F.concat_ws(":", F.lit("3"), F.lit("spot"), "cut_id"), 256), "cut_id", "num_frames").limit(50)
    off = F.abs(F.col("num_frames") / F.col("sample_rate") - F.col("duration")) > 0.05
    return picked.select("cut_id", off.alias("off"))


def quota_allocation(spark, d):
    """A window of 97 draws over the mix targets."""
    w = table(spark, d, "mix_targets").select("source", F.col("target_share").alias("weight"))
    return S.largest_remainder(w, 97, ["source"]).select("source", "quota")


def hash_topk(spark, d):
    """T5: three records of each speaker set and task by hash rank."""
    r = records(spark, d).where("source_record_id is not null")
    return S.top_per_key(r, ["dataset_id", "task"], 3, [F.sha2(F.concat_ws(":", F.lit("11"), F.lit("top"), "id"), 256), F.col("id")]).select("dataset_id", "task", "id", "rank")


def mixed_rate(spark, d):
    """One source in full, a tenth of the rest."""
    return records(spark, d).where((F.col("dataset_id") == "nightferry") | (u(5, "rate", "id") < 0.1)).select("id")


def language_alias(spark, d):
    """P10: languages by alias, others as they are."""
    pairs = [F.lit(x) for code, names in LANGUAGE_NAMES.items() for n in names for x in (n, code)]
    low = F.lower("language")
    return table(spark, d, "audio_records").groupBy(F.coalesce(F.create_map(*pairs)[low], F.col("language")).alias("language")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in [flagship_selection, clean_filter, clean_states, supervision_clean, id_lists, prefixed_ids, duration_range, holdout_antijoin, speaker_exclusion, record_query, sql_filter, read_rules, task_support, hash_partition, hotword_valid, validation_limit, material_mask, whole_meetings, name_filter, keep_closest, nearest_rooms, finite_numbers, superseded_versions, cell_minimum, index_spot_check, quota_allocation, hash_topk, mixed_rate, language_alias]}

_HELD = "CAST(('0x' || substr(sha256({key}), 1, 15)) AS BIGINT) % {m} = 0"
_NAME_CASE = "CASE " + " ".join(f"WHEN lower(language) IN ({', '.join(repr(n) for n in names)}) THEN '{code}'" for code, names in LANGUAGE_NAMES.items()) + " ELSE language END"
_BARE = r"regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(text, '</?(?:b|i|u|em|strong)>', '', 'g'), '\(\s*\)|\[\s*\]', ' ', 'g'), '\s+', ' ', 'g')), '^#+ *', '')"
SQL = {
    "flagship_selection": f"WITH {TIMED_SQL} SELECT dataset_id, CASE WHEN {_HELD.format(key=chr(34) + 'k' + chr(34), m=10)} THEN 'dev' ELSE 'train' END AS part, count(*) AS records, CAST(sum(CAST(round(duration * 1000) AS BIGINT)) AS BIGINT) / 1000 AS seconds FROM (SELECT *, concat_ws(':', '42', dataset_id, source_record_id) AS k FROM timed WHERE clean AND duration BETWEEN 1.0 AND 30.0) GROUP BY ALL",
    "clean_filter": f"WITH {RECORDS_SQL} SELECT id, task FROM records WHERE coalesce({CLEAN_SQL}, false)",
    "clean_states": f"WITH {RECORDS_SQL} SELECT {CLEAN_SQL} AS clean, count(*) AS n FROM records GROUP BY ALL",
    "supervision_clean": f"""WITH {RECORDS_SQL}, s AS (SELECT id, unnest(CAST(json_extract(metadata, '$.segments[*]') AS JSON[])) AS s, {MAIN_SQL}.ref.duration AS cut_s, {CLEAN_SQL} AS flag FROM records)
SELECT id, count(*) AS kept FROM s WHERE flag AND CAST(s->>'duration' AS DOUBLE) > 0 AND CAST(s->>'start' AS DOUBLE) >= 0 AND CAST(s->>'start' AS DOUBLE) + CAST(s->>'duration' AS DOUBLE) <= cut_s GROUP BY id""",
    "id_lists": f"WITH {TIMED_SQL} SELECT id FROM timed WHERE cut_id IN (SELECT cut_id FROM audio_index) AND NOT EXISTS (SELECT 1 FROM turns t WHERE t.split = 'eval' AND t.cut_id = timed.cut_id)",
    "prefixed_ids": r"WITH allowed AS (SELECT 'x:' || regexp_extract(relative_path, '([^/]+)\.[a-z0-9]+$', 1) AS id FROM audio_index UNION SELECT cut_id FROM audio_index WHERE channels = 1) SELECT DISTINCT cut_id AS id FROM audio_index WHERE cut_id IN (SELECT id FROM allowed) OR 'x:' || cut_id IN (SELECT id FROM allowed)",
    "duration_range": f"WITH {TIMED_SQL} SELECT id, round(duration, 3) AS duration FROM timed WHERE duration >= 2.5 AND duration <= 12.0",
    "holdout_antijoin": f"WITH {RECORDS_SQL}, r AS (SELECT id, split, unnest(audio_slots).ref.cut_id AS cut FROM records), held AS (SELECT cut FROM r WHERE split IN ('dev', 'eval')) SELECT id FROM records WHERE split = 'train' AND audio_slots IS NOT NULL AND id NOT IN (SELECT id FROM r WHERE cut IN (SELECT cut FROM held WHERE cut IS NOT NULL))",
    "speaker_exclusion": "SELECT window_id, count(*) AS turns FROM turns WHERE speaker IS NULL OR speaker NOT IN ('S1', 'S2') GROUP BY window_id",
    "record_query": f"WITH {RECORDS_SQL} SELECT id, language, split FROM records WHERE task = 'asr' AND language IN ('zh', 'en') AND split IN ('train', 'tr_extra') AND coalesce({CLEAN_SQL}, false)",
    "sql_filter": "SELECT doc_id, n_chars FROM documents WHERE text IS NOT NULL AND n_chars > 200 AND lang = 'zh'",
    "read_rules": rf"""WITH b AS (SELECT doc_kind, n_chars, lower(regexp_extract(lang, '^[^-_]*')) AS primary_tag, lang, {_BARE} AS bare FROM documents WHERE text IS NOT NULL),
c AS (SELECT *, length(regexp_replace(bare, '[^\x{{4e00}}-\x{{9fff}}]', '', 'g')) AS han, length(regexp_replace(bare, '[^\x{{3040}}-\x{{30ff}}]', '', 'g')) AS kana, length(regexp_replace(bare, '[^A-Za-z]', '', 'g')) AS latin FROM b)
SELECT doc_kind, CASE WHEN n_chars / 15.0 > 120 THEN 'too_long' WHEN regexp_matches(bare, '</?[A-Za-z][^>]*>|\{{[^}}]*\}}|https?://') THEN 'markup' WHEN NOT regexp_matches(bare, '[\p{{L}}\p{{N}}]') THEN 'no_lexical'
 WHEN (CASE WHEN primary_tag = 'zh' THEN han = 0 AND latin > 0 WHEN primary_tag = 'ja' THEN kana = 0 AND han = 0 ELSE han >= 6 END) THEN 'script_mismatch' ELSE 'kept' END AS reason, count(*) AS n FROM c GROUP BY ALL""",
    "task_support": f"WITH {RECORDS_SQL}, p AS (SELECT * REPLACE (CASE WHEN substr(sha256(id), 1, 2) < '08' THEN 'translation' ELSE task END AS task) FROM records) SELECT r.dataset_id, r.version, r.task, count(*) AS n FROM p r JOIN dataset_catalog c USING (dataset_id, version) WHERE NOT list_contains(c.tasks, r.task) GROUP BY ALL",
    "hash_partition": f"WITH {RECORDS_SQL}, f AS (SELECT id, dataset_id, string_split(string_split(source_record_id, '|')[-2], '_')[1] AS family FROM records WHERE source_record_id LIKE '%|%') SELECT id, family, {_HELD.format(key=chr(39) + '7:' + chr(39) + ' || dataset_id || ' + chr(39) + ':' + chr(39) + ' || family', m=5)} AS held_out FROM f",
    "hotword_valid": f"WITH {RECORDS_SQL}, w AS (SELECT unnest(hotwords) AS w FROM records) SELECT length(replace(trim(w), ' ', '')) BETWEEN 2 AND 8 AS valid, count(*) AS n, count(DISTINCT w) AS words FROM w GROUP BY ALL",
    "validation_limit": f"""WITH {TIMED_SQL}, s AS (SELECT dataset_id, count(*) AS n FROM timed WHERE split IN ('dev', 'eval', 'train_probe') AND duration <= 150.0 GROUP BY dataset_id),
e AS (SELECT *, n * 100.0 / sum(n) OVER () AS exact, sum(n) OVER () AS total FROM s), b AS (SELECT *, least(CAST(floor(exact) AS BIGINT), n) AS base FROM e),
l AS (SELECT *, 100 - sum(base) OVER () AS left_over, coalesce(sum(n - base) OVER (ORDER BY round(exact - floor(exact), 9) DESC, n DESC, dataset_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
SELECT dataset_id, n, CAST(CASE WHEN total <= 100 THEN n ELSE base + least(n - base, greatest(left_over - before, 0)) END AS BIGINT) AS taken FROM l""",
    "material_mask": "SELECT chars <= 2 OR (chars > 2 AND end_sec - start_sec >= 1.0 AND speaker IS NOT NULL) AS eligible, chars <= 2 AS backchannel, count(*) AS n FROM turns WHERE end_sec > start_sec AND chars IS NOT NULL GROUP BY ALL",
    "whole_meetings": "SELECT window_id, count(DISTINCT speaker) AS speakers FROM turns WHERE speaker IS NOT NULL AND window_id NOT IN (SELECT window_id FROM turns WHERE speaker IS NOT NULL AND split IN ('dev', 'eval')) GROUP BY window_id HAVING count(DISTINCT speaker) >= 2",
    "name_filter": "SELECT DISTINCT cut_id FROM audio_index WHERE contains(lower(relative_path), 'qm') AND NOT contains(lower(relative_path), 'qmn')",
    "keep_closest": "SELECT p_partkey, p_brand, rn FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY abs(p_size - 25), p_partkey) AS rn, count(*) OVER (PARTITION BY p_brand) AS n FROM part) WHERE rn <= greatest(1, floor(n * 0.5))",
    "nearest_rooms": """WITH a AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY abs(s_acctbal - 4000), s_suppkey) AS r1 FROM supplier WHERE s_acctbal BETWEEN 0 AND 9000),
b AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS r2 FROM a WHERE r1 <= 8), c AS (SELECT *, count(*) OVER (PARTITION BY s_nationkey) AS n, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r3 FROM b WHERE r2 <= 5)
SELECT s_nationkey, s_suppkey FROM c WHERE r3 <= greatest(1, floor(n / 5))""",
    "finite_numbers": "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE value <= 400 AND value >= 1 GROUP BY event_type",
    "superseded_versions": "WITH c AS (SELECT dataset_id || '@' || version AS ref, derived_from FROM dataset_catalog) SELECT ref, 'current' AS state FROM c WHERE ref NOT IN (SELECT derived_from FROM c WHERE derived_from IS NOT NULL) UNION ALL SELECT derived_from, 'dangling' FROM c WHERE derived_from IS NOT NULL AND derived_from NOT IN (SELECT ref FROM c)",
    "cell_minimum": f"WITH {RECORDS_SQL} SELECT dataset_id, task, split, count(*) AS n FROM records GROUP BY ALL HAVING count(*) >= 5",
    "index_spot_check": f"SELECT cut_id, abs(num_frames / sample_rate - duration) > 0.05 AS off FROM (SELECT DISTINCT cut_id, num_frames, sample_rate, duration FROM audio_index WHERE duration IS NOT NULL ORDER BY {hash_sql(3, 'spot', 'cut_id')}, cut_id, num_frames LIMIT 50)",
    "quota_allocation": "WITH e AS (SELECT source, target_share * 97.0 / sum(target_share) OVER () AS exact FROM mix_targets), b AS (SELECT *, CAST(floor(exact) AS BIGINT) AS base FROM e), l AS (SELECT *, 97 - sum(base) OVER () AS left_over, row_number() OVER (ORDER BY round(exact - base, 9) DESC, source) AS rn FROM b) SELECT source, base + CASE WHEN rn <= left_over THEN 1 ELSE 0 END AS quota FROM l",
    "hash_topk": f"WITH {RECORDS_SQL} SELECT dataset_id, task, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, task ORDER BY {hash_sql(11, 'top', 'id')}, id) AS rank FROM records WHERE source_record_id IS NOT NULL) WHERE rank <= 3",
    "mixed_rate": f"WITH {RECORDS_SQL} SELECT id FROM records WHERE dataset_id = 'nightferry' OR {u_sql(5, 'rate', 'id')} < 0.1",
    "language_alias": f"SELECT {_NAME_CASE} AS language, count(*) AS n FROM audio_records GROUP BY ALL",
}
