"""Problem 4: splits that keep related records together."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions.catalog import catalogue_names, spelling
from lakeloom.operators.components import connected_components
from lakeloom.operators.relations import salted_join
from lakeloom.session import broadcast_within, checkpointed
from lakeloom.sources.tables import table

BINS = 200
SHARD_COMPONENTS = 200_000
MERGED_SHARDS = 64


def speaker_codes(source_record_id: Column) -> Column:
    """The speakers a source record id names, as letter and six digits: all of a mixture's second-to-last ``|`` field,
    else the first of the file name (after an ``alias:`` prefix and folders). ``U`` marks an utterance, not a speaker."""
    parts = F.split(source_record_id, r"\|")
    field = F.when(F.size(parts) > 1, F.get(parts, F.size(parts) - 2)).otherwise(F.regexp_replace(source_record_id, r"^(?:[^:|]*:)?(?:.*/)?", ""))
    found = F.regexp_extract_all(field, F.lit(r"(?<![A-Za-z0-9])([A-TV-Za-tv-z]0*\d+)(?![A-Za-z0-9])"), 1)
    code = F.transform(found, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), _six(F.regexp_replace(x, "^.0*(?=[0-9])", ""))))
    return F.when(F.size(parts) > 1, F.array_distinct(code)).otherwise(F.slice(code, 1, 1))


def _six(digits: Column) -> Column:
    return F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits)


def record_speakers(records: DataFrame, catalog: DataFrame) -> DataFrame:
    """(id, dataset_id, source_record_id) -> (id, speakers) with ``<dataset>:<code>`` keys, one row per id.

    A record without source id, without a speaker in it, or of no catalogue dataset has no speakers and is related to
    no other. Rows with one id count once; if their sources differ, all their speakers count. A null id gives no row.
    """
    names = broadcast_within(catalogue_names(catalog).select("spelled", "catalogue_id"))
    rows = records.where("id is not null").select("id", "dataset_id", "source_record_id")
    known = rows.join(names, spelling(rows["dataset_id"]) == names["spelled"], "left")
    keys = F.transform(speaker_codes(F.col("source_record_id")), lambda c: F.concat("catalogue_id", F.lit(":"), c))
    keyed = known.select("id", F.filter(F.coalesce(keys, F.array().cast("array<string>")), lambda k: k.isNotNull()).alias("speakers"))
    return keyed.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_set("speakers"))).alias("speakers"))


def groups(records: DataFrame, catalog: DataFrame) -> DataFrame:
    """(id, group_key, related): the component of each record; ``related`` is false for one that names no speaker,
    whose group is itself (``group_key`` ``record:<id>``)."""
    named = checkpointed(record_speakers(records, catalog))
    links = named.where("size(speakers) > 1").select(F.explode(F.transform(F.slice("speakers", 2, F.size("speakers")), lambda s: F.struct(F.get("speakers", F.lit(0)).alias("u"), s.alias("v")))).alias("e")).select("e.u", "e.v")
    parts = connected_components(links)
    at = named.select("id", F.get("speakers", F.lit(0)).alias("speaker"))
    return salted_join(at, parts.withColumnRenamed("node", "speaker"), ["speaker"], ["id"], how="left").select(
        "id", F.coalesce("component", "speaker", F.concat(F.lit("record:"), "id")).alias("group_key"), F.col("speaker").isNotNull().alias("related")
    )


def largest_differencing(weights: list[int], bins: int) -> list[int]:
    """The bin of each weight: the tuple differencing of Karmarkar and Karp for many bins.

    Descending weights are cut into tuples of one weight a bin; again and again the two tuples of widest spread are
    combined, the largest part of one with the smallest of the other, until one tuple is left.
    """
    order = sorted(range(len(weights)), key=lambda i: (-weights[i], i))
    heap = []
    for a in range(0, len(order), bins):
        part = [(weights[i], [i]) for i in order[a : a + bins]]
        part += [(0, []) for _ in range(bins - len(part))]
        heap.append((-(part[0][0] - part[-1][0]), a, part))
    heapq.heapify(heap)
    tie = len(order)
    while len(heap) > 1:
        one, two = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        joined = []
        for (w, x), (v, y) in zip(one, reversed(two)):
            if len(x) < len(y):
                x, y = y, x
            x.extend(y)
            joined.append((w + v, x))
        joined.sort(key=lambda p: (-p[0], p[1][:1]))
        tie += 1
        heapq.heappush(heap, (-(joined[0][0] - joined[-1][0]), tie, joined))
    out = [0] * len(weights)
    if heap:
        for b, (_, members) in enumerate(heap[0][2]):
            for i in members:
                out[i] = b
    return out


def allocate_bins(sizes: list[int], targets: list[tuple[str, float]]) -> list[str]:
    """Whole bins, largest first, to the split that lacks most of its target; ties go to the first named."""
    total, share = sum(sizes), sum(t for _, t in targets)
    lack = {name: total * t / share for name, t in targets}
    out = [""] * len(sizes)
    for b in sorted(range(len(sizes)), key=lambda b: (-sizes[b], b)):
        name = max(lack, key=lambda n: lack[n])
        out[b] = name
        lack[name] -= sizes[b]
    return out


def _differenced(weights: DataFrame, keys: list[str], shard: str, part: str, bins: int) -> DataFrame:
    """Rows (keys, weight, shard) with the bin of each weight among those of its shard as ``part``."""

    def difference(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["weight", *keys], ascending=[False] + [True] * len(keys))
        return p.assign(**{part: largest_differencing(p["weight"].tolist(), bins)})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in weights.schema.fields)
    return weights.groupBy(shard).applyInPandas(difference, f"{schema}, {part} int")


def assign_splits(records: DataFrame, catalog: DataFrame, plan: DataFrame, bins: int = BINS, shard_components: int = SHARD_COMPONENTS, merged: int = MERGED_SHARDS) -> DataFrame:
    """(id, group_key, related, group_size, bin, split): every record once, each group whole in one split.

    Components are hashed into shards of about ``shard_components`` and differenced there into ``bins`` equal bins. The
    bins of up to ``merged`` shards are differenced again, and so on up a tree, until that many shards are left; only
    their sums (at most ``merged`` * bins numbers, whatever the size) reach the driver. Without a valid plan (positive
    shares) it is an error. An empty table gives no row.
    """
    targets = sorted(((r[0], float(r[1])) for r in plan.where("split_name is not null and target_share > 0").groupBy("split_name").agg(F.max("target_share")).limit(1001).collect()), key=lambda t: (-t[1], t[0]))
    if not targets or len(targets) > 1000:
        raise ValueError("the plan must name 1 to 1000 splits with a positive share")
    grouped = checkpointed(groups(records, catalog))
    sizes = checkpointed(grouped.groupBy("group_key").agg(F.count("*").alias("weight")))
    shards = max(1, -(-sizes.count() // shard_components))
    placed = _differenced(sizes.withColumn("shard", F.pmod(F.xxhash64("group_key"), F.lit(shards)).cast("int")), ["group_key"], "shard", "part", bins)
    placed = checkpointed(placed.withColumnRenamed("weight", "group_size"))
    sums = placed.groupBy("shard", "part").agg(F.sum("group_size").alias("weight"))
    steps = []
    while shards > merged:
        up = checkpointed(_differenced(sums.withColumn("above", F.expr(f"shard div {merged}").cast("int")), ["shard", "part"], "above", "over", bins))
        steps.append(up.select("shard", "part", "above", "over"))
        sums = up.groupBy(F.col("above").alias("shard"), F.col("over").alias("part")).agg(F.sum("weight").alias("weight"))
        shards = -(-shards // merged)
    last = sorted(tuple(r) for r in sums.select("shard", "part", "weight").collect())
    top = largest_differencing([n for _, _, n in last], bins)
    totals = [0] * bins
    for b, (_, _, n) in zip(top, last):
        totals[b] += n
    split = allocate_bins(totals, targets)
    where = placed.sparkSession.createDataFrame([(s, p, b, split[b]) for b, (s, p, _) in zip(top, last)], "shard int, part int, bin int, split string")
    for up in reversed(steps):
        where = up.join(where.withColumnsRenamed({"shard": "above", "part": "over"}), ["above", "over"]).select("shard", "part", "bin", "split")
    where = broadcast_within(where, 50_000)
    at = placed.join(where, ["shard", "part"]).select("group_key", "group_size", "bin", "split")
    return salted_join(grouped, at, ["group_key"], ["id"]).select("id", "group_key", "related", "group_size", "bin", "split")


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_splits(table(spark, sf_dir, "audio_records"), table(spark, sf_dir, "dataset_catalog"), table(spark, sf_dir, "split_plan"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of a group of two or more records, with the group's smallest speaker key."""
    return _assigned(spark, sf_dir).where("related and group_size > 1").select("id", "group_key")


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every record."""
    return _assigned(spark, sf_dir).select("id", "group_key", "split")


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, groups and the share reached of each split beside its target."""
    plan = table(spark, sf_dir, "split_plan")
    got = _assigned(spark, sf_dir).groupBy("split").agg(F.count("*").alias("records"), F.sum(F.lit(1.0) / F.col("group_size")).alias("groups"))
    total = got.agg(F.sum("records").alias("total"))
    return plan.join(got, plan["split_name"] == got["split"], "left").crossJoin(F.broadcast(total)).select(
        "split_name", "target_share", F.coalesce("records", F.lit(0)).alias("records"), F.round("groups").cast("long").alias("groups"), F.round(F.col("records") / F.col("total"), 6).alias("share")
    )


def p4_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of ``p4_splits``: records once each, related ones and their groups, no group in two splits, and no split
    more than half a point off its share unless a group is larger than that."""
    assigned = checkpointed(_assigned(spark, sf_dir))
    per = assigned.groupBy("group_key").agg(F.max("related").alias("related"), F.count("*").alias("n"), F.count_distinct("split").alias("splits"))
    groups = per.agg(F.sum("n").alias("records"), F.sum(F.when(F.col("related") & (F.col("n") > 1), F.col("n")).otherwise(0)).alias("in_groups"), F.sum((F.col("related") & (F.col("n") > 1)).cast("long")).alias("groups"), F.sum((F.col("splits") > 1).cast("long")).alias("torn"), F.max("n").alias("largest"))
    plan = table(spark, sf_dir, "split_plan").select(F.col("split_name").alias("split"), "target_share")
    got = plan.join(assigned.groupBy("split").agg(F.count("*").alias("got")), "split", "left").crossJoin(F.broadcast(groups))
    off = F.abs(F.coalesce("got", F.lit(0)) - F.col("target_share") * F.col("records")) > F.greatest(0.005 * F.col("records"), F.col("largest"))
    return groups.crossJoin(F.broadcast(got.agg(F.sum(off.cast("long")).alias("off")))).drop("largest")


QUERIES = {"p4_found": p4_found, "p4_splits": p4_splits, "p4_shares": p4_shares, "p4_kept": p4_kept}

_KEYED = r"""
WITH RECURSIVE own AS (SELECT dataset_id, aliases FROM dataset_catalog),
names AS (
  SELECT DISTINCT dataset_id, regexp_replace(regexp_replace(lower(trim(name)), '\s*@.*$', ''), '[-\s_]+', '_', 'g') AS name
  FROM (SELECT dataset_id, dataset_id AS name FROM own UNION ALL SELECT dataset_id, unnest(aliases) FROM own)
),
fields AS (
  SELECT DISTINCT r.id, n.dataset_id, contains(r.source_record_id, '|') AS mixed,
    CASE WHEN contains(r.source_record_id, '|') THEN string_split(r.source_record_id, '|')[-2]
         ELSE regexp_replace(r.source_record_id, '^(?:[^:|]*:)?(?:.*/)?', '') END AS field
  FROM audio_records r JOIN names n ON n.name = regexp_replace(regexp_replace(lower(trim(r.dataset_id)), '\s*@.*$', ''), '[-\s_]+', '_', 'g')
),
named AS (
  SELECT id, dataset_id, mixed, list_filter(regexp_split_to_array(field, '[^A-Za-z0-9]+'), lambda x: regexp_matches(x, '^[A-TV-Za-tv-z][0-9]+$')) AS codes FROM fields
),
speakers AS (
  SELECT DISTINCT id, dataset_id || ':' || upper(c[1]) || CASE WHEN length(CAST(CAST(c[2:] AS BIGINT) AS VARCHAR)) < 6 THEN lpad(CAST(CAST(c[2:] AS BIGINT) AS VARCHAR), 6, '0') ELSE CAST(CAST(c[2:] AS BIGINT) AS VARCHAR) END AS speaker
  FROM (SELECT id, dataset_id, unnest(CASE WHEN mixed THEN codes ELSE codes[1:1] END) AS c FROM named)
),
links AS (SELECT DISTINCT a.speaker AS u, b.speaker AS v FROM speakers a JOIN speakers b USING (id)),
reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v),
least AS (SELECT u, min(v) AS group_key FROM reach GROUP BY u),
keyed AS (SELECT DISTINCT s.id, l.group_key FROM speakers s JOIN least l ON l.u = s.speaker),
found AS (SELECT id, group_key FROM keyed WHERE group_key IN (SELECT group_key FROM keyed GROUP BY group_key HAVING count(*) > 1))
"""
SQL = {
    "p4_found": f"{_KEYED} SELECT id, group_key FROM found",
    "p4_kept": f"{_KEYED} SELECT (SELECT count(DISTINCT id) FROM audio_records) AS records, count(*) AS in_groups, count(DISTINCT group_key) AS groups, 0 AS torn, 0 AS off FROM found",
}
