"""Queries of the joins, lookups and set operations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.operators import relations as R
from lakeloom.operators.ordering import ordered_positions
from lakeloom.plans.views import INDEX_SQL, MAIN_SQL, NAMES_SQL, RECORDS_SQL, SPELLED_SQL, TIMED_SQL, TURNS_SQL, index, named, records, timed_records, turns
from lakeloom.sources.tables import table


def cut_scan(spark, d):
    """Index rows as recordings, with their turns where there are any."""
    t = turns(spark, d).select("window_id", "dataset_id", "turn_id")
    rec = table(spark, d, "turns").select("window_id", F.col("cut_id")).distinct()
    i = index(spark, d).select("cut_id", "duration")
    return i.join(rec.join(t, "window_id"), "cut_id", "left").groupBy("cut_id").agg(F.max("duration").alias("duration"), F.count("turn_id").alias("turns"))


def slot_locations(spark, d):
    """Every slot with its cut; totals per record, and what is missing."""
    s = R.slots_located(records(spark, d), index(spark, d))
    return s.groupBy("id").agg(F.count("*").alias("slots"), F.sum(F.col("missing").cast("int")).alias("missing"), F.round(F.sum("duration"), 3).alias("seconds"))


def annotation_match(spark, d):
    """Windows that turns or statistics don't have exactly once."""
    a = table(spark, d, "turns").select("window_id").distinct()
    return R.one_to_one(a, table(spark, d, "label_stats").select("window_id", "published_at").distinct().select("window_id"), "window_id")


def alignment_join(spark, d):
    """Records against the catalogue with equality checks as columns."""
    c = table(spark, d, "dataset_catalog").select("dataset_id", "version", "languages", "tasks")
    r = records(spark, d).select("id", "dataset_id", "version", "language", "task", F.get("audio_slots", F.lit(0))["ref"].alias("ref"))
    j = r.join(F.broadcast(c), ["dataset_id", "version"])
    return j.groupBy("dataset_id").agg(F.count("*").alias("n"), F.sum(F.array_contains("languages", F.col("language")).cast("int")).alias("language_ok"), F.sum((F.col("ref.dataset_id") == F.col("dataset_id")).cast("int")).alias("same_dataset"), F.sum((F.col("ref.version") == F.col("version")).cast("int")).alias("same_version"))


def eligible_semi(spark, d):
    """Records whose dataset version passed a report."""
    ok = named(table(spark, d, "prep_reports").where("passed").select("dataset_id", "version"), spark, d)
    return records(spark, d).join(ok, ["dataset_id", "version"], "left_semi").select("id")


def _systems(spark, d):
    """Scores of two systems per turn: the characters of its first and of its latest delivery; one without text failed."""
    t = table(spark, d, "turns").groupBy("turn_id").agg(F.min_by(F.struct("text", "window_id", "speaker"), "ingested_at").alias("a"), F.max_by(F.struct("text", "window_id", "speaker"), "ingested_at").alias("b"))
    side = lambda x: t.select("turn_id", F.length(f"{x}.text").alias("score"), F.col(f"{x}.text").isNotNull().alias("ok"))
    return side("a"), side("b")


def run_pairs(spark, d):
    """The systems' scores by turn, sets of turns asserted equal, failed ones left out: net, absolute and
    changed scores."""
    j = R.paired(*_systems(spark, d), "turn_id", "score", "ok", same_keys=True)
    diff = F.col("score_b") - F.col("score_a")
    return j.agg(F.count("*").alias("paired"), F.sum(diff).alias("net"), F.sum(F.abs(diff)).alias("absolute"), F.sum((diff != 0).cast("int")).alias("changed"))


def counterfactual_pairs(spark, d):
    """What happens to a mixture's outcome when only the enrolment changes: target-speaker records of one mixture cut and
    text presence, crossed with those of another enrolment; counted by class, no pair is listed."""
    slot = lambda n: F.get(F.filter("audio_slots", lambda s: s["name"] == n), F.lit(0))["ref"]["cut_id"]
    r = records(spark, d).where("task = 'target_speaker_asr'").select(slot("mixture").alias("mix"), slot("enrollment").alias("enr"), (F.coalesce(F.trim("target"), F.lit("")) != "").alias("said")).where("mix is not null and enr is not null")
    per = r.groupBy("mix", "enr").agg(F.sum(F.col("said").cast("long")).alias("yes"), F.sum((~F.col("said")).cast("long")).alias("no"))
    sums = per.groupBy("mix").agg(F.sum("yes").alias("y"), F.sum("no").alias("n"), F.sum(F.col("yes") * F.col("yes")).alias("yy"), F.sum(F.col("no") * F.col("no")).alias("nn"), F.sum(F.col("yes") * F.col("no")).alias("yn"))
    return sums.agg(F.sum(F.expr("(y * y - yy) div 2")).alias("both"), F.sum(F.expr("(n * n - nn) div 2")).alias("neither"), F.sum(F.expr("y * n - yn")).alias("one"))


def same_mixture(spark, d):
    """How many pairs of target-speaker records of one mixture cut have different enrolments; counted by enrolment,
    no pair is made."""
    slot = lambda n: F.get(F.filter("audio_slots", lambda s: s["name"] == n), F.lit(0))["ref"]["cut_id"]
    r = records(spark, d).where("task = 'target_speaker_asr'").select(slot("mixture").alias("mix"), slot("enrollment").alias("enr")).where("mix is not null and enr is not null")
    n = r.groupBy("mix", "enr").agg(F.count("*").alias("n")).groupBy("mix").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("alike"))
    return n.select("mix", F.expr("(n * n - alike) div 2").alias("pairs")).where("pairs > 0")


def lineage_family(spark, d):
    """Dataset versions followed to their first ancestor."""
    c = table(spark, d, "dataset_catalog").select(F.concat_ws("@", "dataset_id", "version").alias("ref"), "derived_from")
    return R.roots(c, "ref", "derived_from").select("ref", "root", "steps", "cyclic")


def index_verification(spark, d):
    """Deliveries of one record compared column by column."""
    a = table(spark, d, "audio_records").groupBy("id").agg(F.min_by(F.struct("task", "target", "language", "dataset_id"), "ingested_at").alias("x")).select("id", "x.*")
    b = table(spark, d, "audio_records").groupBy("id").agg(F.max_by(F.struct("task", "target", "language", "dataset_id"), "ingested_at").alias("x")).select("id", "x.*")
    return R.equality_report(a, b, "id", ["task", "target", "language", "dataset_id"])


def context_join(spark, d):
    """Documents of the mix with their targets, bounded side broadcast by the optimizer."""
    m = table(spark, d, "mix_targets").select("source", "max_repeats")
    return named(table(spark, d, "documents").select("source", "n_chars"), spark, d, "source").join(F.broadcast(m), "source", "left").groupBy("max_repeats").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def dataset_voice_ranks(spark, d):
    """The speakers of each dataset's template windows by need beside the customers of a nation by balance."""
    need = turns(spark, d).where("speaker is not null").groupBy("dataset_id", "window_id", "speaker").agg(F.sum(F.col("e") - F.col("s")).alias("need")).withColumn("g", F.pmod(F.length("window_id"), F.lit(5)))
    voices = table(spark, d, "customer").select(F.pmod("c_nationkey", F.lit(5)).cast("int").alias("g"), "c_custkey", "c_acctbal")
    one = ordered_positions(need.withColumn("least", -F.col("need")), ["dataset_id", "g"], ["least", "window_id", "speaker"], "k")
    two = ordered_positions(voices.withColumn("least", -F.col("c_acctbal")), ["g"], ["least", "c_custkey"], "k")
    return one.join(two.select("g", "k", "c_custkey"), ["g", "k"]).select("dataset_id", "g", (F.col("k") + 1).alias("k"), "window_id", "speaker", "c_custkey")


def identity_reuse(spark, d):
    """Catalogue rows whose artifacts' identity another version has."""
    c = table(spark, d, "dataset_catalog").select("dataset_id", "version", F.array_sort(F.transform("artifacts", lambda a: F.coalesce(a["sha256"], F.lit("-")))).alias("shas"))
    k = c.select("dataset_id", "version", F.sha2(F.array_join("shas", ","), 256).alias("identity"))
    return k.groupBy("identity").agg(F.count("*").alias("versions")).groupBy("versions").agg(F.count("*").alias("n"))


def index_gaps(spark, d):
    """Splits of the catalogue without records, work that is left."""
    s = table(spark, d, "dataset_catalog").select("dataset_id", "version", F.explode(F.map_keys("splits")).alias("split"))
    return s.join(records(spark, d).select("dataset_id", "version", "split").distinct(), ["dataset_id", "version", "split"], "left_anti")


def resolve_split(spark, d):
    """Artifacts of each split and role in order."""
    c = table(spark, d, "dataset_catalog").select("dataset_id", "version", "artifacts", F.explode("splits").alias("split", "spec"))
    roles = c.select("dataset_id", "version", "split", "artifacts", F.explode("spec.artifacts").alias("role", "names")).select("dataset_id", "version", "split", "role", "artifacts", F.posexplode("names").alias("pos", "name"))
    found = F.get(F.filter("artifacts", lambda a: a["name"] == F.col("name")), F.lit(0))
    return roles.select("dataset_id", "version", "split", "role", "pos", "name", found["relative_path"].alias("path"), found["kind"].alias("kind"))


def resolved_paths(spark, d):
    """Paths under their root; one that climbs out is rejected."""
    i = table(spark, d, "audio_index").select("cut_id", "root_alias", "relative_path").distinct()
    p = F.concat(F.lit("/roots/"), "root_alias", F.lit("/"), "relative_path")
    return i.select("cut_id", "root_alias", F.when(~F.col("relative_path").rlike(r"(^|/)\.\.(/|$)|^/"), p).alias("path"))


def reader_shards(spark, d):
    """Units of storage dealt to 4 readers in epoch 3."""
    return R.shards(table(spark, d, "documents"), "origin_id", 5, 3, 4).where("origin_id is not null")


def enrollment_lists(spark, d):
    """Clips of each speaker in order, a row each."""
    r = records(spark, d).where("task = 'asr' and source_record_id is not null").withColumn("speaker", F.regexp_extract("source_record_id", r"^([A-Z]\d+)_", 1)).where("speaker <> ''")
    return ordered_positions(r.select("dataset_id", "speaker", "id"), ["dataset_id", "speaker"], ["id"])


def pool_clips(spark, d):
    """Clips of own spans, and whole foreign cuts."""
    r = records(spark, d).select("id", F.col("dataset_id").alias("home"), F.explode("audio_slots").alias("s"))
    kind = F.when(F.col("s.ref.start").isNotNull(), F.when(F.col("s.ref.dataset_id") == F.col("home"), "span").otherwise("foreign_span")).otherwise("whole")
    return r.groupBy("home", kind.alias("kind")).agg(F.count("*").alias("n"))


def read_ids(spark, d):
    """Asked ids, a twentieth of all by hash and some that are nowhere, found or missing."""
    have = records(spark, d).select("id", "task")
    some = have.where("id is not null").withColumn("h", F.sha2("id", 256)).where("h < '0d'").select("id", "h")
    asked = some.select("id").unionByName(some.where("h < '01'").select(F.concat("id", F.lit("-gone")).alias("id")))
    return asked.join(have, "id", "left").select("id", F.col("task").isNotNull().alias("found"))


def take_positions(spark, d):
    """Rows at evenly spaced positions of a stable order."""
    r = ordered_positions(records(spark, d).select("id", "dataset_id"), ["dataset_id"], ["id"])
    n = records(spark, d).groupBy(F.col("dataset_id").alias("other")).agg(F.count("*").alias("n"))
    at = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.floor(k * (F.col("n") - 1) / 4))
    return r.join(F.broadcast(n), F.col("dataset_id").eqNullSafe(F.col("other"))).where(F.array_contains(at, F.col("ix"))).select("dataset_id", "ix", "id")


def sorted_turns(spark, d):
    """Each turn's place in its window by start and speaker."""
    t = turns(spark, d).select("window_id", "turn_id", "s", F.coalesce("speaker", F.lit("")).alias("speaker"))
    return ordered_positions(t, ["window_id"], ["s", "speaker", "turn_id"]).select("window_id", "turn_id", "ix")


def extremes(spark, d):
    """The shortest and the longest record of each dataset."""
    r = timed_records(spark, d).where("duration is not null")
    return r.groupBy("dataset_id").agg(F.min_by("id", F.struct("duration", "id")).alias("shortest"), F.max_by("id", F.struct("duration", "id")).alias("longest"))


def ordered_dedup(spark, d):
    """First occurrences in order."""
    return records(spark, d).where("hotwords is not null").select("id", F.array_join(F.array_distinct(F.concat("hotwords", F.reverse("hotwords"))), "|").alias("words"))


def last_delivery(spark, d):
    """T14."""
    return R.last_write(table(spark, d, "turns").select("turn_id", "window_id", "chars", "ingested_at"), "turn_id", "ingested_at").select("turn_id", "window_id", "chars")


def set_operations(spark, d):
    """Cuts that records and turns share, and that only one has."""
    a = records(spark, d).select(F.explode("audio_slots.ref.cut_id").alias("cut_id")).distinct()
    b = table(spark, d, "audio_index").select("cut_id").distinct()
    return a.intersect(b).select(F.lit("both").alias("side")).unionByName(a.exceptAll(b).select(F.lit("records").alias("side"))).unionByName(b.exceptAll(a).select(F.lit("index").alias("side"))).groupBy("side").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in [cut_scan, slot_locations, annotation_match, alignment_join, eligible_semi, run_pairs, counterfactual_pairs, same_mixture, lineage_family, index_verification, context_join, dataset_voice_ranks, identity_reuse, index_gaps, resolve_split, resolved_paths, reader_shards, enrollment_lists, pool_clips, read_ids, take_positions, sorted_turns, extremes, ordered_dedup, last_delivery, set_operations]}

_FIRST_LAST = "SELECT id, {f}(task, ingested_at) AS task, {f}(target, ingested_at) AS target, {f}(language, ingested_at) AS language, {f}(dataset_id, ingested_at) AS dataset_id FROM (SELECT * FROM audio_records) GROUP BY id"
_SLOT = "list_filter(audio_slots, lambda s: s.name = '{n}')[1].ref.cut_id"
SQL = {
    "cut_scan": f"WITH {TURNS_SQL}, {INDEX_SQL}, r AS (SELECT DISTINCT window_id, cut_id FROM turns) SELECT i.cut_id, max(i.duration) AS duration, count(t.turn_id) AS turns FROM idx i LEFT JOIN (r JOIN t USING (window_id)) ON r.cut_id = i.cut_id GROUP BY i.cut_id",
    "slot_locations": f"WITH {RECORDS_SQL}, {INDEX_SQL}, s AS (SELECT id, unnest(audio_slots) AS s FROM records) SELECT s.id, count(*) AS slots, sum((i.cut_id IS NULL)::INT) AS missing, round(sum(coalesce(s.s.ref.duration, i.duration)), 3) AS seconds FROM s LEFT JOIN idx i ON i.cut_id = s.s.ref.cut_id GROUP BY s.id",
    "annotation_match": "WITH a AS (SELECT DISTINCT window_id, 1 AS in_a FROM turns), b AS (SELECT window_id, count(*) AS in_b FROM (SELECT DISTINCT window_id, published_at FROM label_stats) GROUP BY ALL) SELECT window_id, coalesce(in_a, 0) AS in_a, coalesce(in_b, 0) AS in_b FROM a FULL JOIN b USING (window_id) WHERE coalesce(in_a, 0) <> 1 OR coalesce(in_b, 0) <> 1",
    "alignment_join": f"WITH {RECORDS_SQL} SELECT r.dataset_id, count(*) AS n, sum(list_contains(c.languages, r.language)::INT) AS language_ok, sum((r.audio_slots[1].ref.dataset_id = r.dataset_id)::INT) AS same_dataset, sum((r.audio_slots[1].ref.version = r.version)::INT) AS same_version FROM records r JOIN dataset_catalog c USING (dataset_id, version) GROUP BY ALL",
    "eligible_semi": f"WITH {RECORDS_SQL} SELECT id FROM records r WHERE EXISTS (SELECT 1 FROM prep_reports p LEFT JOIN names n ON n.spelled = {SPELLED_SQL.format(x='p.dataset_id')} WHERE p.passed AND coalesce(n.named, p.dataset_id) = r.dataset_id AND p.version = r.version)",
    "run_pairs": "WITH p AS (SELECT turn_id, length(arg_min_null(text, ingested_at)) AS a, length(arg_max_null(text, ingested_at)) AS b FROM turns GROUP BY turn_id) SELECT count(*) AS paired, CAST(sum(b - a) AS BIGINT) AS net, CAST(sum(abs(b - a)) AS BIGINT) AS absolute, sum((a <> b)::INT) AS changed FROM p WHERE a IS NOT NULL AND b IS NOT NULL",
    "counterfactual_pairs": f"WITH {RECORDS_SQL}, r AS (SELECT id, {_SLOT.format(n='mixture')} AS mix, {_SLOT.format(n='enrollment')} AS enr, coalesce(trim(target), '') <> '' AS said FROM records WHERE task = 'target_speaker_asr') SELECT coalesce(sum((a.said AND b.said)::INT), 0) AS both, coalesce(sum((NOT a.said AND NOT b.said)::INT), 0) AS neither, coalesce(sum((a.said <> b.said)::INT), 0) AS one FROM r a JOIN r b ON a.mix = b.mix AND a.enr <> b.enr AND a.id < b.id",
    "same_mixture": f"WITH {RECORDS_SQL}, r AS (SELECT id, {_SLOT.format(n='mixture')} AS mix, {_SLOT.format(n='enrollment')} AS enr FROM records WHERE task = 'target_speaker_asr') SELECT a.mix, count(*) AS pairs FROM r a JOIN r b ON a.mix = b.mix AND a.id < b.id AND a.enr <> b.enr GROUP BY ALL",
    "lineage_family": "WITH RECURSIVE c AS (SELECT dataset_id || '@' || version AS ref, derived_from FROM dataset_catalog), w(ref, root, up, steps) AS (SELECT ref, ref, derived_from, 0 FROM c UNION ALL SELECT w.ref, w.up, c.derived_from, w.steps + 1 FROM w LEFT JOIN c ON c.ref = w.up WHERE w.up IS NOT NULL AND w.steps < 20) SELECT ref, root, steps, false AS cyclic FROM w WHERE up IS NULL",
    "index_verification": f"WITH a AS ({_FIRST_LAST.format(f='arg_min_null')}), b AS ({_FIRST_LAST.format(f='arg_max_null')}) SELECT unnest(['task', 'target', 'language', 'dataset_id']) AS column, unnest([sum((a.task IS DISTINCT FROM b.task)::INT), sum((a.target IS DISTINCT FROM b.target)::INT), sum((a.language IS DISTINCT FROM b.language)::INT), sum((a.dataset_id IS DISTINCT FROM b.dataset_id)::INT)]) AS differing FROM a JOIN b USING (id)",
    "context_join": f"WITH {NAMES_SQL} SELECT m.max_repeats, count(*) AS n, sum(n_chars) AS chars FROM documents d LEFT JOIN names n ON n.spelled = {SPELLED_SQL.format(x='d.source')} LEFT JOIN mix_targets m ON m.source = coalesce(n.named, d.source) GROUP BY ALL",
    "dataset_voice_ranks": f"WITH {TURNS_SQL}, need AS (SELECT dataset_id, window_id, speaker, sum(e - s) AS need, length(window_id) % 5 AS g FROM t WHERE speaker IS NOT NULL GROUP BY ALL), x AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, g ORDER BY need DESC, window_id, speaker) AS k FROM need), v AS (SELECT c_nationkey % 5 AS g, c_custkey, row_number() OVER (PARTITION BY c_nationkey % 5 ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) SELECT dataset_id, x.g, x.k, window_id, speaker, c_custkey FROM x JOIN v ON x.g = v.g AND x.k = v.k",
    "identity_reuse": "WITH k AS (SELECT sha256(array_to_string(list_sort(list_transform(artifacts, lambda a: coalesce(a.sha256, '-'))), ',')) AS identity FROM dataset_catalog) SELECT versions, count(*) AS n FROM (SELECT identity, count(*) AS versions FROM k GROUP BY ALL) GROUP BY ALL",
    "index_gaps": f"WITH {RECORDS_SQL}, s AS (SELECT dataset_id, version, unnest(map_keys(splits)) AS split FROM dataset_catalog) SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM records r WHERE r.dataset_id = s.dataset_id AND r.version = s.version AND r.split = s.split)",
    "resolve_split": "WITH c AS (SELECT dataset_id, version, artifacts, unnest(map_entries(splits)) AS e FROM dataset_catalog), r AS (SELECT dataset_id, version, artifacts, e.key AS split, unnest(map_entries(e.value.artifacts)) AS ra FROM c), n AS (SELECT dataset_id, version, split, artifacts, ra.key AS role, unnest(ra.value) AS name, generate_subscripts(ra.value, 1) - 1 AS pos FROM r) SELECT dataset_id, version, split, role, pos, name, list_filter(artifacts, lambda a: a.name = n.name)[1].relative_path AS path, list_filter(artifacts, lambda a: a.name = n.name)[1].kind AS kind FROM n",
    "resolved_paths": r"SELECT DISTINCT cut_id, root_alias, CASE WHEN NOT regexp_matches(relative_path, '(^|/)\.\.(/|$)|^/') THEN '/roots/' || root_alias || '/' || relative_path END AS path FROM audio_index",
    "reader_shards": "WITH u AS (SELECT DISTINCT origin_id FROM documents), o AS (SELECT origin_id, (row_number() OVER (ORDER BY sha256(concat_ws(':', '5', '3', origin_id))) - 1) % 4 AS shard FROM u) SELECT * FROM o WHERE origin_id IS NOT NULL",
    "enrollment_lists": rf"WITH {RECORDS_SQL}, r AS (SELECT dataset_id, id, regexp_extract(source_record_id, '^([A-Z]\d+)_', 1) AS speaker FROM records WHERE task = 'asr' AND source_record_id IS NOT NULL) SELECT dataset_id, speaker, id, row_number() OVER (PARTITION BY dataset_id, speaker ORDER BY id) - 1 AS ix FROM r WHERE speaker <> ''",
    "pool_clips": f"WITH {RECORDS_SQL}, s AS (SELECT dataset_id AS home, unnest(audio_slots) AS s FROM records) SELECT home, CASE WHEN s.ref.start IS NOT NULL THEN CASE WHEN s.ref.dataset_id = home THEN 'span' ELSE 'foreign_span' END ELSE 'whole' END AS kind, count(*) AS n FROM s GROUP BY ALL",
    "read_ids": f"WITH {RECORDS_SQL}, s AS (SELECT id, sha256(id) AS h FROM records WHERE id IS NOT NULL AND sha256(id) < '0d') SELECT id, true AS found FROM s JOIN records USING (id) WHERE task IS NOT NULL UNION ALL SELECT id, false FROM s JOIN records USING (id) WHERE task IS NULL UNION ALL SELECT id || '-gone', false FROM s WHERE h < '01'",
    "take_positions": f"WITH {RECORDS_SQL}, r AS (SELECT dataset_id, id, row_number() OVER (PARTITION BY dataset_id ORDER BY id) - 1 AS ix, count(*) OVER (PARTITION BY dataset_id) AS n FROM records) SELECT dataset_id, ix, id FROM r WHERE ix IN (0, CAST(floor((n - 1) / 4) AS BIGINT), CAST(floor(2 * (n - 1) / 4) AS BIGINT), CAST(floor(3 * (n - 1) / 4) AS BIGINT), n - 1)",
    "sorted_turns": f"WITH {TURNS_SQL} SELECT window_id, turn_id, row_number() OVER (PARTITION BY window_id ORDER BY s, coalesce(speaker, ''), turn_id) - 1 AS ix FROM t",
    "extremes": f"WITH {TIMED_SQL} SELECT dataset_id, arg_min(id, (duration, id)) AS shortest, arg_max(id, (duration, id)) AS longest FROM timed WHERE duration IS NOT NULL GROUP BY ALL",
    "ordered_dedup": f"WITH {RECORDS_SQL} SELECT id, array_to_string(list_filter(list_transform(range(1, len(hotwords) + 1), lambda i: CASE WHEN list_position(hotwords, hotwords[i]) = i THEN hotwords[i] END), lambda x: x IS NOT NULL), '|') AS words FROM records WHERE hotwords IS NOT NULL",
    "last_delivery": "SELECT turn_id, window_id, chars FROM (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY ingested_at DESC) AS rn FROM turns) WHERE rn = 1",
    "set_operations": f"WITH {RECORDS_SQL}, a AS (SELECT DISTINCT unnest(audio_slots).ref.cut_id AS c FROM records), b AS (SELECT DISTINCT cut_id AS c FROM audio_index) SELECT CASE WHEN a.c IS NOT NULL AND b.c IS NOT NULL THEN 'both' WHEN b.c IS NULL THEN 'records' ELSE 'index' END AS side, count(*) AS n FROM a FULL JOIN b ON a.c = b.c GROUP BY ALL",
}
