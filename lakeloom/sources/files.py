"""Scans of record, declaration and log files, and of folders."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REF = "struct<dataset_id: string, version: string, split: string, cut_id: string, channel: array<int>, start: double, duration: double, purpose: string>"
RECORD_SCHEMA = f"schema_version string, id string, task string, audio_slots array<struct<name: string, purpose: string, ref: {REF}>>, target string, language string, labels string, hotwords array<string>, metadata string"
INDEX_SCHEMA = "cut_id string, root_alias string, relative_path string, sample_rate int, channels int, num_frames long, duration double"


def read_records(spark: SparkSession, path: str, schema: str = RECORD_SCHEMA) -> DataFrame:
    """JSON lines, gzipped or not; blank lines are skipped and a malformed one is an error. No schema is inferred."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def declaration_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of the .yaml, .yml and .jsonl files of a folder, or of the one file, in order of name."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return files.where(F.col("file").rlike(r"\.(?:yaml|yml|jsonl)$")).orderBy("file")


def _declared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        out = []
        for file, text in zip(p["file"], p["text"]):
            if file.endswith(".jsonl"):
                for n, line in enumerate(text.splitlines(), 1):
                    if line.strip() and not line.lstrip().startswith("#"):
                        try:
                            out.append((file, n, json.dumps(json.loads(line))))
                        except ValueError as e:
                            raise ValueError(f"{file}:{n}: {e}") from None
            else:
                try:
                    import yaml
                except ImportError:
                    raise RuntimeError("PyYAML isn't installed; declare in .jsonl") from None
                got = yaml.safe_load(text) or []
                out += [(file, 1, json.dumps(x)) for x in (got if isinstance(got, list) else [got])]
        yield pd.DataFrame(out, columns=["file", "line", "object"])


def read_declarations(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, object as JSON) of declaration files; blank lines and ``#`` comments are skipped, errors name the line."""
    return declaration_files(spark, path).mapInPandas(_declared, "file string, line int, object string")


def load_catalog(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The declarations of all files of a folder as one table with their ``file`` and ``line``."""
    return read_declarations(spark, path).select(F.from_json("object", schema).alias("x"), "file", "line").select("x.*", "file", "line")


def read_artifact(spark: SparkSession, path: str, schema: str = RECORD_SCHEMA) -> DataFrame:
    """One reader for both forms of a record table: JSON lines, or a published Parquet version."""
    if path.endswith((".jsonl", ".jsonl.gz", ".json")):
        return read_records(spark, path, schema)
    return spark.read.parquet(path)


def scan(rows: DataFrame, split: str | None = None, where: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A split's rows under an SQL condition, and some of its columns; all of it reaches the Parquet scan."""
    if split is not None:
        rows = rows.where(F.array_contains("splits", split) if dict(rows.dtypes)["splits"].startswith("array") else F.col("splits") == split)
    if where:
        rows = rows.where(where)
    return rows.select(*columns) if columns else rows


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of an append-only log; a line that is still being written (not valid JSON) is left for the next time."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x")).where("x._bad is null").select("x.*").drop("_bad")


def read_unique(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """Rows of a keyed file; a repeated key is an error."""
    rows = read_records(spark, path, schema)
    twice = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{path}: repeated key {twice[0][:-1]}")
    return rows


def read_spaced(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A table separated by white space; comments and short lines are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("trim(value) <> '' and value not like '#%'").select(parts.alias("p")).where(F.size("p") >= len(columns))
    return rows.select(*[F.get("p", F.lit(i)).alias(c) for i, c in enumerate(columns)])


def folder_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, modified) of all files under a folder, without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256) of all files under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def read_npz(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of .npz files, their arrays as columns."""
    names = [f.split()[0] for f in schema.split(", ")]

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for content in p["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    yield pd.DataFrame({n: list(z[n]) if z[n].ndim > 1 else z[n] for n in names})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(load, schema)


def manifest_seconds(rows: DataFrame, tracks: Column) -> DataFrame:
    """(id, seconds): of a mixed cut the end of its last track, else its duration."""
    return rows.select("id", F.coalesce(F.array_max(F.transform(tracks, lambda t: t["offset"] + t["duration"])), F.col("duration")).alias("seconds"))


def tree_digest(digests: DataFrame) -> DataFrame:
    """One row: count, bytes and a digest of (path, sha256) that doesn't depend on the order files are listed in."""
    pair = F.xxhash64("path", "sha256")
    return digests.agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.bit_xor(pair).alias("xor"), F.sum(pair.cast("decimal(38,0)")).alias("total"))


def integrity_errors(digests: DataFrame, declared: DataFrame) -> DataFrame:
    """(path, error) of files that are missing, or differ in bytes or sha256 from what is declared."""
    d = declared.select("path", F.col("expected_bytes").alias("want_bytes"), F.col("sha256").alias("want_sha"))
    j = d.join(digests, "path", "left")
    error = F.when(F.col("bytes").isNull(), "missing").when(F.col("want_bytes") != F.col("bytes"), "bytes").when(F.col("want_sha") != F.col("sha256"), "sha256")
    return j.select("path", error.alias("error")).where("error is not null")


def shard_errors(plan: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(shard, error) of a sharded job against its plan (shard, expected): ``missing`` and ``unplanned`` shards, those with
    more or fewer rows than planned (``rows``), and those with a key that repeats in the shard or elsewhere (``repeated``)."""
    got = rows.groupBy("shard").agg(F.count("*").alias("n"))
    j = plan.join(got, "shard", "full")
    counted = j.select("shard", F.when(F.col("n").isNull(), "missing").when(F.col("expected").isNull(), "unplanned").when(F.col("n") != F.col("expected"), "rows").alias("error")).where("error is not null")
    twice = rows.groupBy(key).agg(F.count("*").alias("n"), F.collect_set("shard").alias("shards")).where("n > 1")
    return counted.unionByName(twice.select(F.explode("shards").alias("shard"), F.lit("repeated").alias("error")).distinct())
