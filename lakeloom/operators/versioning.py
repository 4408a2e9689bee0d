"""Versioned tables: patch layers, content digests, catalogue checks, state logs and storage findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.operators.aggregates import content_digest
from lakeloom.session import broadcast_within

WRITABLE = r"^(target|language|hotwords|\$membership|metadata\..+|labels\..+)$"


def patch_hash(rid: Column, status: Column, changes: Column) -> Column:
    """SHA-256 of a patch in canonical form: id, status, and changes sorted by path."""
    items = F.transform(F.array_sort(F.map_entries(changes)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))
    return F.sha2(F.concat_ws("\n", rid, status, F.array_join(items, "\n")), 256)


def layer_errors(layer: DataFrame, parent: DataFrame, key: str = "id") -> DataFrame:
    """(id, error) of every patch that can't be applied: repeated id, unknown parent row, unknown status, a path that
    isn't writable, or a hash that doesn't fit. No row if the layer is valid."""
    repeated = layer.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit("repeated").alias("error"))
    orphan = layer.join(parent.select(key), key, "left_anti").select(key, F.lit("no_parent").alias("error"))
    status = layer.where("status not in ('keep', 'delete')").select(key, F.lit("status").alias("error"))
    paths = layer.where(F.exists(F.map_keys("changes"), lambda p: ~p.rlike(WRITABLE))).select(key, F.lit("path").alias("error"))
    hashed = layer.where(F.col("patch_hash") != patch_hash(F.col(key), F.col("status"), F.col("changes"))).select(key, F.lit("hash").alias("error"))
    return repeated.unionByName(orphan).unionByName(status).unionByName(paths).unionByName(hashed)


def apply_layer(parent: DataFrame, layer: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """The parent's rows with the layer's changes to ``columns`` (string columns, paths of the same name), deleted rows
    left out. One shuffle by id; rows without a patch stay as they are; a change to null sets null."""
    p = layer.select(key, F.col("status").alias("p_status"), F.col("changes").alias("p_changes"))
    j = parent.join(p, key, "left").where("p_status is null or p_status <> 'delete'")
    new = {c: F.when(F.map_contains_key(F.coalesce("p_changes", F.create_map().cast("map<string,string>")), c), F.col("p_changes")[c]).otherwise(F.col(c)) for c in columns}
    return j.withColumns(new).drop("p_status", "p_changes")


def replay(parent: DataFrame, layers: list[DataFrame], columns: list[str], key: str = "id") -> DataFrame:
    """All layers in order."""
    out = parent
    for layer in layers:
        out = apply_layer(out, layer, columns, key)
    return out


def equivalent(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """One row: whether two tables hold the same rows, by count and order-insensitive digest."""
    x, y = content_digest(a, columns), content_digest(b, columns)
    return x.alias("x").crossJoin(y.alias("y")).select((F.col("x.rows") == F.col("y.rows")).alias("same_rows"), (F.col("x.xor").eqNullSafe(F.col("y.xor")) & F.col("x.total").eqNullSafe(F.col("y.total"))).alias("same_content"))


def path_conflicts(steps: DataFrame) -> DataFrame:
    """(a, b) of steps (step, writes, overrides) whose written paths cover one another without the later one's override."""
    w = steps.select("step", F.explode("writes").alias("path"), "overrides")
    x, y = w.alias("x"), w.alias("y")
    covers = F.col("y.path").startswith(F.concat(F.col("x.path"), F.lit("."))) | F.col("x.path").startswith(F.concat(F.col("y.path"), F.lit("."))) | (F.col("x.path") == F.col("y.path"))
    first = lambda c: F.substring_index(F.col(c), ".", 1)  # noqa: E731  # equal first parts: an equi-join, not a cross join
    hit = x.join(y, (first("x.path") == first("y.path")) & (F.col("x.step") < F.col("y.step")) & covers)
    return hit.where(~F.array_contains("y.overrides", F.col("y.path"))).select(F.col("x.step").alias("a"), F.col("y.step").alias("b"), F.col("y.path").alias("path"))


def illegal_transitions(log: DataFrame, legal: DataFrame, key: str, order: str) -> DataFrame:
    """Steps (key, before, after) of a state log that the table (before, after) doesn't allow."""
    w = Window.partitionBy(key).orderBy(order)
    steps = log.withColumn("before", F.lag("state").over(w)).where("before is not null").select(key, "before", F.col("state").alias("after"))
    return steps.join(F.broadcast(legal), ["before", "after"], "left_anti")


def ancestors(path: Column) -> Column:
    """The path and all folders above it, deepest last, the root not among them."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def tree_rollup(files: DataFrame, max_depth: int) -> DataFrame:
    """(path, bytes, files) of every folder to a depth; hard links (equal inode) count once."""
    once = files.dropDuplicates(["inode"])
    at = once.select("bytes", F.explode(F.slice(ancestors(F.col("path")), 1, max_depth)).alias("path"))
    return at.groupBy("path").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("files"))


def classify_paths(nodes: DataFrame, zones: DataFrame) -> DataFrame:
    """(path, zone): the deepest zone that holds a path, else ``unregistered``."""
    up = nodes.select("path", F.explode(ancestors(F.col("path"))).alias("zone_path"))
    best = up.join(broadcast_within(zones), "zone_path").groupBy("path").agg(F.max_by("zone", F.length("zone_path")).alias("zone"))
    return nodes.select("path").join(best, "path", "left").select("path", F.coalesce("zone", F.lit("unregistered")).alias("zone"))
