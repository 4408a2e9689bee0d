"""Queries of files, published versions and their checks: whole tables written to the shared folder, read back and
compared in SQL with the tables they came from."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.operators.aggregates import portable_digest
from lakeloom.plans.views import RECORDS_SQL, index, records
from lakeloom.session import scratch
from lakeloom.sources import files as R
from lakeloom.sources import sinks as K
from lakeloom.sources.tables import table

COLUMNS = ["schema_version", "id", "task", "audio_slots", "target", "language", "labels", "hotwords", "metadata"]
_DIGESTED = ["id", "task", "target", "language"]


def _folder(spark) -> str:
    return scratch(spark, "files")


def jsonl_records(spark, d):
    """All records as gzipped JSON lines and read back, digested by task."""
    at = _folder(spark)
    K.write_jsonl(records(spark, d).select(*COLUMNS), f"{at}/records.jsonl.gz", gzip=True)
    back = R.read_artifact(spark, f"{at}/records.jsonl.gz")
    cuts = F.coalesce(F.array_join(F.transform("audio_slots", lambda s: F.coalesce(s["ref"]["cut_id"], F.lit("-"))), " "), F.lit(""))
    return back.select("id", F.size(F.coalesce("hotwords", F.array().cast("array<string>"))).alias("hotwords"), F.sha2(F.concat_ws("|", F.coalesce("target", F.lit("-")), cuts), 256).alias("content"))


def published_versions(spark, d):
    """Records imported from JSON lines, compacted, mirrored, and the first version removed: rows
    and content of what is left, and what was removed."""
    at = _folder(spark)
    K.write_jsonl(records(spark, d).select(*COLUMNS), f"{at}/in.jsonl")
    K.import_jsonl(spark, f"{at}/in.jsonl", f"{at}/v/1", R.RECORD_SCHEMA)
    K.compact(spark, f"{at}/v/1", f"{at}/v/2", 2)
    K.mirror(spark, f"{at}/v/2", f"{at}/mirror")
    gone = K.cleanup(spark, f"{at}/v", {"2"})
    out = [portable_digest(K.open_version(spark, f"{at}/{name}"), _DIGESTED).select(F.lit(name).alias("version"), "rows", "xor", "total") for name in ("v/2", "mirror")]
    removed = spark.createDataFrame([(g, 0, None, None) for g in gone], "version string, rows long, xor long, total string")
    return out[0].unionByName(out[1]).unionByName(removed)


def exported_cuts(spark, d):
    """Records whose first slot has sound bounds as cut manifests, read back."""
    at = _folder(spark)
    ref = F.get("audio_slots", F.lit(0))["ref"]
    sound = (ref["start"].isNull() | (ref["start"] >= 0)) & (ref["duration"].isNull() | (ref["duration"] > 0))
    K.export_cuts(records(spark, d).where(sound), f"{at}/cuts")
    return R.read_records(spark, f"{at}/cuts", "id string, start double, duration double, recording_id string").select("id", "start", "duration", "recording_id")


def unique_rows(spark, d):
    """A keyed file is read; with one row more that repeats a key it is refused."""
    at = _folder(spark)
    rows = records(spark, d).select("id", "dataset_id", "labels")
    K.write_jsonl(rows, f"{at}/good")
    K.write_jsonl(rows.unionByName(rows.orderBy("id").limit(1)), f"{at}/bad")
    schema = "id string, dataset_id string, labels string"
    good = R.read_unique(spark, f"{at}/good", schema, ["dataset_id", "id"])
    try:
        R.read_unique(spark, f"{at}/bad", schema, ["dataset_id", "id"])
        refused = False
    except ValueError:
        refused = True
    return good.agg(F.count("*").alias("rows"), F.count("labels").alias("labelled"), F.lit(refused).alias("refused"))


def catalog_files(spark, d):
    """The catalogue declared in one file a dataset, read in order of file and line."""
    at = _folder(spark)
    c = table(spark, d, "dataset_catalog").select("dataset_id", "version", "languages", "aliases")
    K.write_jsonl(c.repartition(3, "dataset_id"), f"{at}/catalog")
    files = [s.getPath().getName() for s in K._fs(spark, at)[0].listStatus(K._fs(spark, f"{at}/catalog")[1])]
    fs, _, new_path = K._fs(spark, at)
    for i, name in enumerate(sorted(f for f in files if f.startswith("part-"))):
        fs.rename(new_path(f"{at}/catalog/{name}"), new_path(f"{at}/catalog/{i:03d}.jsonl"))
    got = R.load_catalog(spark, f"{at}/catalog", "dataset_id string, version string, languages array<string>, aliases array<string>")
    return got.select("dataset_id", "version", F.array_join("languages", ",").alias("languages"), F.coalesce(F.size("aliases"), F.lit(0)).alias("aliases"))


def spaced_rooms(spark, d):
    """A table separated by white space, comments and short lines among its lines."""
    at = _folder(spark)
    line = F.concat(F.col("cut_id"), F.lit(" \t "), F.col("duration").cast("string"), F.lit("  x"))
    rows = index(spark, d).where("duration is not null and cut_id not like '% %'")
    text = rows.select(line.alias("value")).unionByName(rows.select(F.concat(F.lit("# "), "cut_id").alias("value"))).unionByName(rows.select(F.col("cut_id").alias("value")))
    text.write.text(f"{at}/rooms")
    return R.read_spaced(spark, f"{at}/rooms", ["cut_id", "duration"]).select("cut_id", F.round(F.col("duration").cast("double"), 4).alias("duration"))


def manifest_hours(spark, d):
    """Records as manifests, those of several slots as tracks laid end to end, and their seconds."""
    at = _folder(spark)
    place = F.array_compact(F.transform("audio_slots", lambda s: s["ref"]["duration"]))
    tracks = F.transform(place, lambda x, i: F.struct(F.aggregate(F.slice(place, 1, i), F.lit(0.0), lambda a, b: a + b).alias("offset"), x.alias("duration")))
    rows = records(spark, d).where("audio_slots is not null").select("id", F.when(F.size(place) > 1, tracks).alias("tracks"), F.array_max(place).alias("duration"))
    K.write_jsonl(rows, f"{at}/manifests.gz", gzip=True)
    back = R.read_records(spark, f"{at}/manifests.gz", "id string, tracks array<struct<offset: double, duration: double>>, duration double")
    return R.manifest_seconds(back, F.col("tracks")).select("id", F.round("seconds", 4).alias("seconds"))


def file_integrity(spark, d):
    """Files of a published table against declared digests, of which one is wrong, one is too long and one names
    no file; their tree's size."""
    at = _folder(spark)
    records(spark, d).select("id").repartition(4).write.parquet(f"{at}/t")
    digests = R.file_digests(spark, f"{at}/t").where("path like '%.parquet'")
    seen = [tuple(r) for r in digests.orderBy("path").limit(1000).collect()]
    declared = [(p, n + (i == 1), s if i else "0" * 64) for i, (p, n, s) in enumerate(seen)] + [(f"{at}/t/none", 1, "0")]
    errors = R.integrity_errors(digests, spark.createDataFrame(declared, "path string, expected_bytes long, sha256 string"))
    tree = R.tree_digest(digests).select(F.lit("files").alias("error"), F.col("files").alias("n"))
    return errors.groupBy("error").agg(F.count("*").alias("n")).unionByName(tree)


def shard_verification(spark, d):
    """Record shards by hash as a job wrote them, against their plan: shard 3 wasn't written, shard 5 lost rows, and
    some of shard 7 are in shard 8 as well."""
    shard = F.expr("cast(conv(substring(sha2(id, 256), 1, 1), 16, 10) as int)")
    rows = records(spark, d).select("id", shard.alias("shard"))
    plan = rows.groupBy("shard").agg(F.count("*").alias("expected"))
    lost = F.substring(F.sha2("id", 256), 2, 1) == "0"
    wrote = rows.where((F.col("shard") != 3) & ~((F.col("shard") == 5) & lost))
    wrote = wrote.unionByName(rows.where((F.col("shard") == 7) & lost).select("id", F.lit(8).alias("shard")))
    return R.shard_errors(plan, wrote, "id")


def status_files(spark, d):
    """A report of findings, a status written whole, and both copied and confirmed, read back."""
    at = _folder(spark)
    found = records(spark, d).where("target is null or language is null").select("id", F.when(F.col("target").isNull(), "target").otherwise("language").alias("missing"))
    K.write_report(found, f"{at}/report")
    back = spark.read.option("header", True).csv(f"{at}/report/csv")
    n = back.count()
    for state in ("started", "done"):
        K.write_status(spark, f"{at}/status.json", {"state": state, "findings": n})
    K.copy_confirmed(spark, at, f"{at}/copy", ["status.json"])
    status = R.read_records(spark, f"{at}/copy/status.json", "state string, findings long")
    head = spark.read.text(f"{at}/report/markdown").where("value like '% findings'").select(F.lit("report").alias("state"), F.regexp_extract("value", r"^(\d+)", 1).cast("long").alias("findings"))
    return status.unionByName(head)


QUERIES = {f.__name__: f for f in [jsonl_records, published_versions, exported_cuts, unique_rows, catalog_files, spaced_rooms, manifest_hours, file_integrity, shard_verification, status_files]}

_H = "CAST(('0x' || substr(sha256(concat_ws(chr(31), {c})), 1, 15)) AS BIGINT)"
DIGEST_SQL = lambda columns: _H.format(c=", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in columns))
_SHARDS = "s AS (SELECT id, CAST(('0x' || substr(sha256(id), 1, 1)) AS INTEGER) AS shard, substr(sha256(id), 2, 1) = '0' AS lost FROM records)"
SQL = {
    "jsonl_records": f"WITH {RECORDS_SQL} SELECT id, coalesce(len(hotwords), 0) AS hotwords, sha256(concat_ws('|', coalesce(target, '-'), coalesce(array_to_string(list_transform(audio_slots, lambda s: coalesce(s.ref.cut_id, '-')), ' '), ''))) AS content FROM records",
    "published_versions": f"WITH {RECORDS_SQL}, g AS (SELECT count(*) AS rows, bit_xor(h) AS xor, CAST(sum(CAST(h AS HUGEINT)) AS VARCHAR) AS total FROM (SELECT {DIGEST_SQL(_DIGESTED)} AS h FROM records)) SELECT 'v/2' AS version, * FROM g UNION ALL SELECT 'mirror', * FROM g UNION ALL SELECT '1', 0, NULL, NULL",
    "exported_cuts": f"WITH {RECORDS_SQL}, r AS (SELECT id, audio_slots[1].ref AS ref FROM records) SELECT id, coalesce(ref.start, 0.0) AS start, ref.duration AS duration, ref.cut_id AS recording_id FROM r WHERE coalesce(ref.start >= 0, true) AND coalesce(ref.duration > 0, true)",
    "unique_rows": f"WITH {RECORDS_SQL} SELECT count(*) AS rows, count(labels) AS labelled, count(*) > 0 AS refused FROM records",
    "catalog_files": "SELECT dataset_id, version, array_to_string(languages, ',') AS languages, coalesce(len(aliases), 0) AS aliases FROM dataset_catalog",
    "spaced_rooms": "SELECT cut_id, round(max(duration), 4) AS duration FROM audio_index WHERE cut_id NOT LIKE '% %' GROUP BY cut_id HAVING max(duration) IS NOT NULL",
    "manifest_hours": f"WITH {RECORDS_SQL} SELECT id, round(list_sum(list_filter(list_transform(audio_slots, lambda s: s.ref.duration), lambda x: x IS NOT NULL)), 4) AS seconds FROM records WHERE audio_slots IS NOT NULL",
    "file_integrity": "SELECT 'sha256' AS error, 1 AS n UNION ALL SELECT 'bytes', 1 UNION ALL SELECT 'missing', 1 UNION ALL SELECT 'files', 4",
    "shard_verification": f"WITH {RECORDS_SQL}, {_SHARDS} SELECT shard, 'missing' AS error FROM s WHERE shard = 3 GROUP BY shard UNION ALL SELECT shard, 'rows' FROM s WHERE shard = 5 AND lost GROUP BY shard UNION ALL SELECT x.shard, x.error FROM (VALUES (8, 'rows'), (7, 'repeated'), (8, 'repeated')) x(shard, error) WHERE EXISTS (SELECT 1 FROM s WHERE shard = 7 AND lost)",
    "status_files": f"WITH {RECORDS_SQL}, n AS (SELECT count(*) AS findings FROM records WHERE target IS NULL OR language IS NULL) SELECT 'done' AS state, findings FROM n UNION ALL SELECT 'report', findings FROM n",
}
