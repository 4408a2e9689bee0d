"""Writers that check what they publish: JSON lines, versions of tables, reports."""

from __future__ import annotations

import hashlib
import io
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.aggregates import content_digest


def write_jsonl(rows: DataFrame, path: str, gzip: bool = False) -> None:
    """One object a line, keys sorted, nulls kept."""
    text = rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("value"))
    text.write.mode("errorifexists").option("compression", "gzip" if gzip else "none").text(path)


def schema_pin(rows: DataFrame) -> str:
    return hashlib.sha256(rows.schema.simpleString().encode()).hexdigest()


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def publish(rows: DataFrame, path: str, key: str = "id", expected: int | None = None) -> dict:
    """Write to a folder beside, check there that keys are unique and not null and that the count is ``expected``, then
    rename: readers see all of a version or nothing. Gives its manifest: rows, digest, schema pin."""
    spark = rows.sparkSession
    fs, target, new_path = _fs(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    tmp = f"{path}.writing"
    rows.write.mode("overwrite").parquet(tmp)
    back = spark.read.parquet(tmp)
    bad = back.groupBy(key).agg(F.count("*").alias("n")).where(f"n > 1 or {key} is null").limit(1).collect()
    n, xor, total = content_digest(back, back.columns).first()
    if bad or (expected is not None and n != expected):
        fs.delete(new_path(tmp), True)
        raise ValueError(f"{path}: " + (f"key {bad[0][0]!r} repeats or is null" if bad else f"{n} rows, expected {expected}"))
    manifest = {"rows": n, "xor": xor, "total": str(total), "schema": schema_pin(back)}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{tmp}/_manifest")
    if not fs.rename(new_path(tmp), target):
        raise OSError(f"{path} couldn't be published")
    return manifest


def open_version(spark: SparkSession, path: str, pin: str | None = None) -> DataFrame:
    """A published version; another schema than the pinned one is refused."""
    rows = spark.read.parquet(path)
    if pin is not None and schema_pin(rows) != pin:
        raise ValueError(f"{path}: the schema isn't the pinned one")
    return rows


def import_jsonl(spark: SparkSession, source: str, path: str, schema: str, key: str = "id") -> dict:
    """A JSONL file as a published table with as many rows."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(source)
    return publish(rows, path, key, rows.count())


def compact(spark: SparkSession, path: str, to: str, files: int, key: str = "id") -> dict:
    """A copy in fewer files, published only with the same content."""
    rows = spark.read.parquet(path)
    before = content_digest(rows, rows.columns).first()
    made = publish(rows.repartition(files, key), to, key, before[0])
    if (made["xor"], made["total"]) != (before[1], str(before[2])):
        raise ValueError(f"{to} differs from {path}")
    return made


def cleanup(spark: SparkSession, folder: str, keep: set[str]) -> list[str]:
    """Version folders that aren't kept are deleted; gives their names."""
    fs, p, new_path = _fs(spark, folder)
    gone = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and s.getPath().getName() not in keep)
    for name in gone:
        fs.delete(new_path(f"{folder}/{name}"), True)
    return gone


def mirror(spark: SparkSession, path: str, to: str, key: str = "id") -> bool:
    """A version at another root; an identical one is left. Gives whether it was written."""
    fs, target, _ = _fs(spark, to)
    rows = spark.read.parquet(path)
    if fs.exists(target):
        there = spark.read.parquet(to)
        if content_digest(there, there.columns).first() == content_digest(rows, rows.columns).first():
            return False
        raise FileExistsError(to)
    publish(rows, to, key)
    return True


def export_cuts(rows: DataFrame, path: str) -> int:
    """Records with one located slot as cut manifests; bounds must be sound. Gives their number."""
    cuts = rows.select("id", F.get("audio_slots", F.lit(0))["ref"].alias("ref"), "target", "language")
    bad = cuts.where("ref.start < 0 or ref.duration <= 0").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0][0]}: bounds")
    out = cuts.select("id", F.coalesce("ref.start", F.lit(0.0)).alias("start"), "ref.duration", F.col("ref.cut_id").alias("recording_id"), F.struct("target", "language").alias("supervision"))
    write_jsonl(out, path)
    return out.count()


def write_report(findings: DataFrame, path: str, most: int = 10_000) -> None:
    """A CSV of all findings and a markdown table of up to ``most``, counts stated; reports are small by nature. Both go
    through Spark, so ``path`` may be any store."""
    findings.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    total, rows = findings.count(), findings.limit(most).collect()
    lines = [f"{total} findings", "", "| " + " | ".join(findings.columns) + " |", "|" + " --- |" * len(findings.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]
    findings.sparkSession.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/markdown")


def write_npz(rows: DataFrame, path: str, most: int = 1_000_000) -> int:
    """All rows as one .npz file with an array a column, lists padded to one length with -1; a lookup table that every reader
    loads whole, so more than ``most`` rows are an error. Gives the number of rows."""
    data = rows.limit(most + 1).toPandas()
    if len(data) > most:
        raise ValueError(f"more than {most} rows")
    arrays = {}
    for c in data.columns:
        if any(isinstance(v, (list, np.ndarray)) for v in data[c]):
            width = max(len(v) for v in data[c])
            arrays[c] = np.array([[*v, *[-1] * (width - len(v))] for v in data[c]]).reshape(len(data), width)
        else:
            arrays[c] = data[c].to_numpy()
    out = io.BytesIO()
    np.savez(out, **arrays)
    fs, target, _ = _fs(rows.sparkSession, path)
    stream = fs.create(target, False)
    stream.write(bytearray(out.getvalue()))
    stream.close()
    return len(data)


def write_status(spark: SparkSession, path: str, status: dict) -> None:
    """A JSON status as a whole or not at all: written beside, then renamed over the old one."""
    fs, target, new_path = _fs(spark, path)
    sc, hadoop = spark.sparkContext, spark.sparkContext._jvm.org.apache.hadoop.fs
    tmp = new_path(f"{path}.writing")
    out = fs.create(tmp, True)
    out.write(bytearray(json.dumps(status, sort_keys=True).encode("utf-8")))
    out.close()
    rename = sc._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    options = sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    options[0] = rename.getEnumConstants()[1]
    hadoop.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration()).rename(fs.makeQualified(tmp), fs.makeQualified(target), options)


def copy_confirmed(spark: SparkSession, source: str, to: str, files: list[str]) -> int:
    """Files copied to another store, each confirmed by its length there; gives their number. One already there with that
    length is left, so a broken copy can be run again."""
    fs, _, new_path = _fs(spark, source)
    there, _, _ = _fs(spark, to)
    for name in files:
        a, b = new_path(f"{source}/{name}"), new_path(f"{to}/{name}")
        size = fs.getFileStatus(a).getLen()
        if not (there.exists(b) and there.getFileStatus(b).getLen() == size):
            spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, there, b, False, True, spark.sparkContext._jsc.hadoopConfiguration())
        if there.getFileStatus(b).getLen() != size:
            raise OSError(f"{to}/{name} isn't whole")
    return len(files)
