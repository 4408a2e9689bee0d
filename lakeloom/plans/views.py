"""Views of the tables that several queries share."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions.catalog import catalogue_names, spelling
from lakeloom.operators.intervals import to_units
from lakeloom.operators.selection import clean_flag, main_slot
from lakeloom.sources.tables import table

MOST_NAMES = 20_000


@cache
def _names(spark: SparkSession, sf_dir: str) -> list[tuple[str, str]]:
    found = catalogue_names(table(spark, sf_dir, "dataset_catalog")).select("spelled", "catalogue_id").limit(MOST_NAMES + 1).collect()
    if len(found) > MOST_NAMES:
        raise ValueError("the catalogue has more names than a broadcast may hold")
    return [tuple(r) for r in found]


def named(rows: DataFrame, spark: SparkSession, sf_dir: str, column: str = "dataset_id") -> DataFrame:
    """Rows with the catalogue's id in place of whatever spelling or alias ``column`` has; unknown names stay.

    The catalogue is a fixed table; its spellings are read once a session, and are at most MOST_NAMES.
    """
    names = spark.createDataFrame(_names(spark, sf_dir), "_spelled string, _named string")
    j = rows.join(F.broadcast(names), spelling(F.col(column)) == F.col("_spelled"), "left")
    return j.withColumn(column, F.coalesce("_named", column)).drop("_spelled", "_named")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record id, its dataset by the catalogue's id; redelivered rows are equal but for ``ingested_at``."""
    return named(table(spark, sf_dir, "audio_records").dropDuplicates(["id"]), spark, sf_dir)


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per cut: the largest duration and frame count of its rows."""
    return table(spark, sf_dir, "audio_index").groupBy("cut_id").agg(F.max("duration").alias("duration"), F.max("num_frames").alias("num_frames"), F.max("sample_rate").alias("sample_rate"), F.max("channels").alias("channels"), F.max("root_alias").alias("root_alias"), F.max("relative_path").alias("relative_path"))


def timed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, task, dataset_id, version, split, language, target, clean, cut_id, duration): the duration of the main slot, else of its cut."""
    r = records(spark, sf_dir).withColumn("main", main_slot(F.col("audio_slots")))
    flat = r.select("id", "task", "dataset_id", "version", "split", "language", "target", "source_record_id", clean_flag(F.col("metadata")).alias("clean"), F.col("main.ref.cut_id").alias("cut_id"), F.col("main.ref.duration").alias("own_s"))
    cuts = index(spark, sf_dir).select("cut_id", F.col("duration").alias("cut_s"))
    return flat.join(cuts, "cut_id", "left").withColumn("duration", F.coalesce("own_s", "cut_s")).drop("own_s", "cut_s")


SPELLED_SQL = r"regexp_replace(regexp_replace(lower(trim({x})), '\s*@.*$', ''), '[-\s_]+', '_', 'g')"
NAMES_SQL = f"names AS (SELECT spelled, arg_min(dataset_id, (rank, dataset_id)) AS named FROM (SELECT dataset_id, {SPELLED_SQL.format(x='dataset_id')} AS spelled, 0 AS rank FROM dataset_catalog UNION ALL SELECT dataset_id, {SPELLED_SQL.format(x='alias')}, 1 FROM (SELECT dataset_id, unnest(aliases) AS alias FROM dataset_catalog)) WHERE spelled IS NOT NULL GROUP BY spelled)"
RECORDS_SQL = f"{NAMES_SQL}, records AS (SELECT r.* REPLACE (coalesce(n.named, r.dataset_id) AS dataset_id) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at) AS rn FROM audio_records) r LEFT JOIN names n ON n.spelled = {SPELLED_SQL.format(x='r.dataset_id')} WHERE r.rn = 1)"
INDEX_SQL = "idx AS (SELECT cut_id, max(duration) AS duration, max(num_frames) AS num_frames, max(sample_rate) AS sample_rate, max(channels) AS channels, max(root_alias) AS root_alias, max(relative_path) AS relative_path FROM audio_index GROUP BY cut_id)"
MAIN_SQL = "coalesce(list_filter(audio_slots, lambda s: s.name = 'primary')[1], list_filter(audio_slots, lambda s: s.name = 'mixture')[1], audio_slots[-1])"
CLEAN_SQL = "CASE WHEN json_type(metadata, '$.clean.pass') = 'BOOLEAN' THEN json_extract_string(metadata, '$.clean.pass') = 'true' END"
TIMED_SQL = f"""{RECORDS_SQL}, {INDEX_SQL},
flat AS (SELECT id, task, dataset_id, version, split, language, target, source_record_id, {CLEAN_SQL} AS clean, {MAIN_SQL} AS main FROM records),
timed AS (SELECT f.* EXCLUDE (main), f.main.ref.cut_id AS cut_id, coalesce(f.main.ref.duration, i.duration) AS duration FROM flat f LEFT JOIN idx i ON i.cut_id = f.main.ref.cut_id)"""


def turns(spark: SparkSession, sf_dir: str, first: bool = False) -> DataFrame:
    """The latest (or ``first``) delivery of each turn with valid bounds in hundredths of a second and one spelling of its speaker."""
    t = table(spark, sf_dir, "turns").select("turn_id", "window_id", "dataset_id", "split", "speaker", "chars", "text", "ingested_at", to_units(F.col("start_sec")).alias("s"), to_units(F.col("end_sec")).alias("e"))
    pick = F.min_by if first else F.max_by
    best = t.groupBy("turn_id").agg(pick(F.struct("window_id", "dataset_id", "split", "speaker", "chars", "text", "s", "e"), "ingested_at").alias("b")).select("turn_id", "b.*")
    number = F.regexp_extract(F.trim("speaker"), r"([0-9]+)$", 1)
    return best.where("s is not null and e is not null and e > s").withColumn("speaker", F.when(number != "", F.concat(F.lit("S"), number.try_cast("int"))))


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(turn_id, first, last) as structs (window_id, s, e, text) of each turn's first and latest delivery, bounds in hundredths
    of a second or null. Rows are brought together before they are reduced, so each text is shuffled once."""
    t = table(spark, sf_dir, "turns").select("turn_id", "window_id", "text", "ingested_at", to_units(F.col("start_sec")).alias("s"), to_units(F.col("end_sec")).alias("e"))
    row = F.struct("window_id", "s", "e", "text")
    return t.repartition("turn_id").groupBy("turn_id").agg(F.min_by(row, "ingested_at").alias("first"), F.max_by(row, "ingested_at").alias("last"))


TURNS_SQL = """best AS (SELECT turn_id, window_id, dataset_id, split, regexp_extract(trim(speaker), '([0-9]+)$', 1) AS num, chars, text, CAST(round(start_sec * 100) AS BIGINT) AS s, CAST(round(end_sec * 100) AS BIGINT) AS e, row_number() OVER (PARTITION BY turn_id ORDER BY ingested_at DESC) AS rn FROM turns),
t AS (SELECT turn_id, window_id, dataset_id, split, CASE WHEN num <> '' THEN 'S' || CAST(CAST(num AS INTEGER) AS VARCHAR) END AS speaker, chars, text, s, e FROM best WHERE rn = 1 AND s IS NOT NULL AND e IS NOT NULL AND e > s)"""
FIRST_TURNS_SQL = """early AS (SELECT turn_id, window_id, dataset_id, split, regexp_extract(trim(speaker), '([0-9]+)$', 1) AS num, chars, text, CAST(round(start_sec * 100) AS BIGINT) AS s, CAST(round(end_sec * 100) AS BIGINT) AS e, row_number() OVER (PARTITION BY turn_id ORDER BY ingested_at) AS rn FROM turns),
f AS (SELECT turn_id, window_id, dataset_id, split, CASE WHEN num <> '' THEN 'S' || CAST(CAST(num AS INTEGER) AS VARCHAR) END AS speaker, chars, text, s, e FROM early WHERE rn = 1 AND s IS NOT NULL AND e IS NOT NULL AND e > s)"""
