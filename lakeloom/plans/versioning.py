"""Queries of catalogue, layers and storage, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.functions.draws import u, u_sql
from lakeloom.operators import versioning as V
from lakeloom.operators.aggregates import portable_digest
from lakeloom.plans.storage import DIGEST_SQL
from lakeloom.plans.views import INDEX_SQL, RECORDS_SQL, TIMED_SQL, index, records, timed_records
from lakeloom.sources.tables import table


def _layer(spark, d):
    """A patch layer by hash: a tenth deleted, a fifth with a new language, some with a new target as well."""
    r = records(spark, d).select("id", u(13, "layer", "id").alias("x")).where("x < 0.3")
    changes = F.when(F.col("x") < 0.1, F.create_map().cast("map<string,string>")).when(F.col("x") < 0.2, F.create_map(F.lit("language"), F.lit("xx"))).otherwise(F.create_map(F.lit("language"), F.lit("yy"), F.lit("target"), F.lit(None).cast("string")))
    layer = r.select("id", F.when(F.col("x") < 0.1, "delete").otherwise("keep").alias("status"), changes.alias("changes"))
    return layer.withColumn("patch_hash", V.patch_hash(F.col("id"), F.col("status"), F.col("changes")))


def layer_merge(spark, d):
    """Records after a layer."""
    out = V.apply_layer(records(spark, d).select("id", "language", "target"), _layer(spark, d), ["language", "target"])
    return out.select("id", "language", F.col("target").isNull().alias("bare"))


def layer_validation(spark, d):
    """A layer with some broken patches, and why."""
    good = _layer(spark, d)
    broken = good.withColumn("status", F.when(F.col("id").endswith("7"), "drop").otherwise(F.col("status"))).withColumn("changes", F.when(F.col("id").endswith("3"), F.create_map(F.lit("id"), F.lit("x"))).otherwise(F.col("changes")))
    return V.layer_errors(broken, records(spark, d).where("split <> 'spare'")).groupBy("error").agg(F.count("*").alias("n"))


def layer_replay(spark, d):
    """Two layers in order, the second by language."""
    first = _layer(spark, d)
    second = records(spark, d).where("split = 'dev'").select("id", F.lit("keep").alias("status"), F.create_map(F.lit("language"), F.lit("zz")).alias("changes"))
    out = V.replay(records(spark, d).select("id", "split", "language", "target"), [first, second], ["language", "target"])
    return out.groupBy("split", "language").agg(F.count("*").alias("n"))


def content_equality(spark, d):
    """A repartitioned copy holds the same content, one with a changed row doesn't."""
    a = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    same = V.equivalent(a, a.repartition(7, "o_orderstatus"), ["o_orderkey", "o_orderstatus"]).select(F.lit("moved").alias("copy"), "same_rows", "same_content")
    b = a.withColumn("o_orderstatus", F.when(F.col("o_orderkey") == 5, "X").otherwise(F.col("o_orderstatus")))
    return same.unionByName(V.equivalent(a, b, ["o_orderkey", "o_orderstatus"]).select(F.lit("changed").alias("copy"), "same_rows", "same_content"))


def digest_of_records(spark, d):
    """An order-insensitive digest of the records, in values any engine gives."""
    return portable_digest(records(spark, d), ["id", "task", "target", "language", "version"])


def catalog_validation(spark, d):
    """V1, D3: repeated versions, aliases that two datasets claim, duplicate artifact names, dangling references."""
    c = table(spark, d, "dataset_catalog").select("dataset_id", "version", "aliases", "artifacts", "splits")
    # Planted: the first row twice, its aliases claimed by a dataset of its own, an artifact name twice, and none at all.
    first = c.orderBy("dataset_id", "version").limit(1)
    c = c.unionByName(first).unionByName(first.withColumn("dataset_id", F.lit("planted_alias"))).unionByName(first.select(F.lit("planted_twice").alias("dataset_id"), "version", F.lit(None).cast("array<string>").alias("aliases"), F.concat("artifacts", "artifacts").alias("artifacts"), "splits"))
    c = c.unionByName(first.select(F.lit("planted_none").alias("dataset_id"), "version", F.lit(None).cast("array<string>").alias("aliases"), F.filter("artifacts", lambda a: F.lit(False)).alias("artifacts"), "splits"))
    repeated = c.groupBy("dataset_id", "version").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated").alias("kind"), F.concat_ws("@", "dataset_id", "version").alias("what"))
    alias = c.select("dataset_id", F.explode("aliases").alias("a")).distinct().groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("alias").alias("kind"), F.col("a").alias("what"))
    names = c.select(F.concat_ws("@", "dataset_id", "version").alias("ref"), F.col("artifacts.name").alias("names"), "splits")
    doubled = names.where("size(names) <> size(array_distinct(names))").select(F.lit("artifact").alias("kind"), F.col("ref").alias("what"))
    used = names.select("ref", "names", F.explode(F.flatten(F.transform(F.map_values("splits"), lambda s: F.flatten(F.map_values(s["artifacts"]))))).alias("used"))
    dangling = used.where(~F.array_contains("names", F.col("used"))).select(F.lit("dangling").alias("kind"), F.concat_ws("/", "ref", "used").alias("what")).distinct()
    return repeated.unionByName(alias).unionByName(doubled).unionByName(dangling).groupBy("kind").agg(F.count("*").alias("n"))


def versioned_lookup(spark, d):
    """V2: the version meant by a dataset alone: found, or ambiguous."""
    c = table(spark, d, "dataset_catalog").groupBy("dataset_id").agg(F.count("*").alias("versions"), F.max("version").alias("version"))
    return c.select("dataset_id", F.when(F.col("versions") == 1, F.col("version")).alias("version"), (F.col("versions") > 1).alias("ambiguous"))


def transform_conflicts(spark, d):
    """Which of the steps, one a kind of part that writes its type as a path (of two parts for odd sizes, of
    three for even ones) and overrides it if it is large, write over one another."""
    words = F.split("p_type", " ")
    path = F.array_join(F.when(F.col("p_size") % 2 == 1, F.slice(words, 1, 2)).otherwise(words), ".")
    kinds = table(spark, d, "part").select(F.struct(path.alias("path"), (F.col("p_size") > 25).alias("large")).alias("k"), "p_partkey").groupBy("k").agg(F.min("p_partkey").alias("step"))
    steps = kinds.select("step", F.array("k.path").alias("writes"), F.when(F.col("k.large"), F.array("k.path")).otherwise(F.array().cast("array<string>")).alias("overrides"))
    return V.path_conflicts(steps)


def state_transitions(spark, d):
    """Steps of users' event types that aren't allowed."""
    legal = spark.createDataFrame([("view", "click"), ("click", "purchase"), ("view", "view"), ("click", "click"), ("purchase", "view"), ("signup", "view"), ("error", "view")], "before string, after string")
    log = table(spark, d, "events").select("user_id", F.col("event_type").alias("state"), F.struct("ts", "event_id").alias("at"))
    return V.illegal_transitions(log, legal, "user_id", "at").groupBy("before", "after").agg(F.count("*").alias("n"))


def storage_rollup(spark, d):
    """Bytes of the audio tree by folder, hard links once."""
    f = table(spark, d, "audio_index").where("num_frames is not null").select(F.concat_ws("/", "root_alias", "relative_path").alias("path"), (F.col("num_frames") * 2 * F.coalesce("channels", F.lit(1))).alias("bytes"), F.col("cut_id").alias("inode"))
    one = f.groupBy("inode").agg(F.min("path").alias("path"), F.max("bytes").alias("bytes"))
    return V.tree_rollup(one, 3)


def path_zones(spark, d):
    """Zones of the audio files, and which are in none."""
    nodes = table(spark, d, "audio_index").select(F.concat_ws("/", "root_alias", "relative_path").alias("path")).distinct()
    zones = table(spark, d, "audio_index").select(F.concat_ws("/", "root_alias", F.substring_index("relative_path", "/", 1)).alias("zone_path")).distinct().where("zone_path not like '%q%'").select("zone_path", F.lit("catalog").alias("zone"))
    return V.classify_paths(nodes, zones).groupBy("zone").agg(F.count("*").alias("n"))


def storage_findings(spark, d):
    """Stale, unregistered and missing records of the index in one list of findings."""
    r = timed_records(spark, d)
    missing = r.where("duration is null").select("id", F.lit("missing").alias("finding"))
    stale = table(spark, d, "audio_records").groupBy("id").agg(F.max("ingested_at").alias("at")).where(F.datediff(F.lit("2026-04-01").cast("date"), F.to_date("at")) > 85).select("id", F.lit("stale").alias("finding"))
    known = table(spark, d, "dataset_catalog").select("dataset_id", "version")
    unregistered = r.join(known, ["dataset_id", "version"], "left_anti").select("id", F.lit("unregistered").alias("finding"))
    return missing.unionByName(stale).unionByName(unregistered).groupBy("finding").agg(F.count("*").alias("n"))


def preflight(spark, d):
    """Per dataset what a run would see: records, flagged, timed, longest, hours."""
    r = timed_records(spark, d)
    return r.groupBy("dataset_id").agg(F.count("*").alias("n"), F.sum(F.coalesce("clean", F.lit(False)).cast("int")).alias("clean"), F.count("duration").alias("timed"), F.round(F.max("duration"), 3).alias("longest"), (F.sum(F.round(F.col("duration") * 1000).cast("long")) / 1000).alias("seconds"))


def schema_pin(spark, d):
    """§1.3, V14: hashes of table schemas, as names and types in order; equal schemas have equal pins."""
    import hashlib

    types = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}
    pins = []
    for t in ("orders", "lineitem", "part", "customer"):
        columns = ",".join(f"{f.name} {types.get(f.dataType.simpleString(), f.dataType.simpleString())}" for f in table(spark, d, t).schema.fields)
        pins.append((t, hashlib.sha256(columns.encode()).hexdigest()))
    return spark.createDataFrame(pins, "name string, pin string")


def stale_cursors(spark, d):
    """The runs of three or more days in a row on which a user's events were all small."""
    day = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg((F.max("value") < 260).alias("ok")).where("ok")
    w = Window.partitionBy("event_type").orderBy("day")
    g = day.withColumn("g", F.date_sub("day", F.row_number().over(w)))
    return g.groupBy("event_type", "g").agg(F.min("day").alias("first"), F.count("*").cast("long").alias("days")).where("days >= 2").select("event_type", "first", "days")


QUERIES = {f.__name__: f for f in [layer_merge, layer_validation, layer_replay, content_equality, digest_of_records, catalog_validation, versioned_lookup, transform_conflicts, state_transitions, storage_rollup, path_zones, storage_findings, preflight, schema_pin, stale_cursors]}

_LAYER = f"layer AS (SELECT id, x, CASE WHEN x < 0.1 THEN 'delete' ELSE 'keep' END AS status FROM (SELECT id, {u_sql(13, 'layer', 'id')} AS x FROM records) WHERE x < 0.3)"
SQL = {
    "layer_merge": f"WITH {RECORDS_SQL}, {_LAYER} SELECT r.id, CASE WHEN l.x IS NULL THEN r.language WHEN l.x < 0.2 THEN 'xx' ELSE 'yy' END AS language, CASE WHEN l.x >= 0.2 THEN true ELSE r.target IS NULL END AS bare FROM records r LEFT JOIN layer l USING (id) WHERE l.status IS NULL OR l.status <> 'delete'",
    "layer_validation": f"WITH {RECORDS_SQL}, {_LAYER}, e AS (SELECT 'no_parent' AS error FROM layer WHERE id NOT IN (SELECT id FROM records WHERE split <> 'spare') UNION ALL SELECT 'status' FROM layer WHERE id LIKE '%7' UNION ALL SELECT 'path' FROM layer WHERE id LIKE '%3' UNION ALL SELECT 'hash' FROM layer WHERE id LIKE '%7' OR id LIKE '%3') SELECT error, count(*) AS n FROM e GROUP BY ALL",
    "layer_replay": f"WITH {RECORDS_SQL}, {_LAYER} SELECT r.split, CASE WHEN r.split = 'dev' THEN 'zz' WHEN l.x IS NULL THEN r.language WHEN l.x < 0.2 THEN 'xx' ELSE 'yy' END AS language, count(*) AS n FROM records r LEFT JOIN layer l USING (id) WHERE l.status IS NULL OR l.status <> 'delete' GROUP BY ALL",
    "content_equality": "WITH a AS (SELECT o_orderkey, o_orderstatus FROM orders), b AS (SELECT o_orderkey, CASE WHEN o_orderkey = 5 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders) SELECT 'moved' AS copy, (SELECT count(*) FROM a) = (SELECT count(*) FROM a) AS same_rows, (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM a)) = 0 AS same_content UNION ALL SELECT 'changed', (SELECT count(*) FROM a) = (SELECT count(*) FROM b), (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) = 0",
    "digest_of_records": f"WITH {RECORDS_SQL} SELECT count(*) AS rows, bit_xor(h) AS xor, CAST(sum(CAST(h AS HUGEINT)) AS VARCHAR) AS total FROM (SELECT {DIGEST_SQL(['id', 'task', 'target', 'language', 'version'])} AS h FROM records)",
    "catalog_validation": """WITH first AS (SELECT dataset_id, version, aliases, artifacts, splits FROM dataset_catalog ORDER BY dataset_id, version LIMIT 1), planted AS (SELECT dataset_id, version, aliases, artifacts, splits FROM dataset_catalog UNION ALL SELECT * FROM first UNION ALL SELECT 'planted_alias', version, aliases, artifacts, splits FROM first UNION ALL SELECT 'planted_twice', version, NULL, list_concat(artifacts, artifacts), splits FROM first UNION ALL SELECT 'planted_none', version, NULL, list_filter(artifacts, lambda a: false), splits FROM first),
c AS (SELECT dataset_id || '@' || version AS ref, dataset_id, aliases, list_transform(artifacts, lambda a: a.name) AS names, splits FROM planted),
k AS (SELECT 'repeated' AS kind, ref AS what FROM c GROUP BY ref HAVING count(*) > 1 UNION ALL SELECT 'alias', a FROM (SELECT DISTINCT dataset_id, unnest(aliases) AS a FROM c) GROUP BY a HAVING count(*) > 1 UNION ALL SELECT 'artifact', ref FROM c WHERE len(names) <> len(list_distinct(names))
UNION ALL SELECT DISTINCT 'dangling', ref || '/' || used FROM (SELECT ref, names, unnest(flatten(list_transform(map_values(splits), lambda s: flatten(map_values(s.artifacts))))) AS used FROM c) WHERE NOT list_contains(names, used))
SELECT kind, count(*) AS n FROM k GROUP BY ALL""",
    "versioned_lookup": "SELECT dataset_id, CASE WHEN count(*) = 1 THEN max(version) END AS version, count(*) > 1 AS ambiguous FROM dataset_catalog GROUP BY dataset_id",
    "transform_conflicts": "WITH k AS (SELECT CASE WHEN p_size % 2 = 1 THEN array_to_string(string_split(p_type, ' ')[1:2], '.') ELSE replace(p_type, ' ', '.') END AS path, p_size > 25 AS large, min(p_partkey) AS step FROM part GROUP BY ALL) SELECT x.step AS a, y.step AS b, y.path FROM k x JOIN k y ON x.step < y.step AND (x.path = y.path OR starts_with(x.path, y.path || '.') OR starts_with(y.path, x.path || '.')) WHERE NOT y.large",
    "state_transitions": "WITH s AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, event_type AS after FROM events) SELECT before, after, count(*) AS n FROM s WHERE before IS NOT NULL AND (before, after) NOT IN (VALUES ('view', 'click'), ('click', 'purchase'), ('view', 'view'), ('click', 'click'), ('purchase', 'view'), ('signup', 'view'), ('error', 'view')) GROUP BY ALL",
    "storage_rollup": "WITH f AS (SELECT cut_id, min(concat_ws('/', root_alias, relative_path)) AS path, max(num_frames * 2 * coalesce(channels, 1)) AS bytes FROM audio_index WHERE num_frames IS NOT NULL GROUP BY cut_id), a AS (SELECT bytes, array_to_string(string_split(path, '/')[1:k], '/') AS path FROM f, (SELECT unnest([1, 2, 3]) AS k) WHERE len(string_split(path, '/')) >= k) SELECT path, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS files FROM a GROUP BY ALL",
    "path_zones": "WITH n AS (SELECT DISTINCT root_alias || '/' || relative_path AS path, root_alias || '/' || string_split(relative_path, '/')[1] AS top FROM audio_index) SELECT CASE WHEN top NOT LIKE '%q%' THEN 'catalog' ELSE 'unregistered' END AS zone, count(*) AS n FROM n GROUP BY ALL",
    "storage_findings": f"WITH {TIMED_SQL}, f AS (SELECT 'missing' AS finding FROM timed WHERE duration IS NULL UNION ALL SELECT 'stale' FROM (SELECT id, max(ingested_at) AS t FROM audio_records GROUP BY id) WHERE date_diff('day', CAST(t AS DATE), DATE '2026-04-01') > 85 UNION ALL SELECT 'unregistered' FROM timed WHERE (dataset_id, version) NOT IN (SELECT (dataset_id, version) FROM dataset_catalog)) SELECT finding, count(*) AS n FROM f GROUP BY ALL",
    "preflight": f"WITH {TIMED_SQL} SELECT dataset_id, count(*) AS n, sum(coalesce(clean, false)::INT) AS clean, count(duration) AS timed, round(max(duration), 3) AS longest, CAST(sum(CAST(round(duration * 1000) AS BIGINT)) AS BIGINT) / 1000 AS seconds FROM timed GROUP BY ALL",
    "schema_pin": " UNION ALL ".join(f"SELECT '{t}' AS name, sha256(string_agg(column_name || ' ' || split_part(column_type, ' ', 1), ',')) AS pin FROM (DESCRIBE {t})" for t in ("orders", "lineitem", "part", "customer")),
    "stale_cursors": "WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day FROM events GROUP BY ALL HAVING max(value) < 260), g AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY event_type ORDER BY day) AS INTEGER) AS g FROM d) SELECT event_type, min(day) AS first, count(*) AS days FROM g GROUP BY event_type, g HAVING count(*) >= 2",
}
