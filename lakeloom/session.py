"""Session helpers shared by every operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "lakeloom", cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def own_folder(spark: SparkSession, use: str) -> str:
    """A folder of this machine, removed at exit, for sessions with a local master; an error on a cluster."""
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"spark.checkpoint.dir must name a shared folder for {use}")
    made = tempfile.mkdtemp(prefix="lakeloom-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


def shared_folder(spark: SparkSession, use: str) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; one of its own only where that is unset and local."""
    return spark.conf.get("spark.checkpoint.dir", None) or own_folder(spark, use)


def scratch(spark: SparkSession, use: str) -> str:
    """A new path in the shared folder for tables and files that a result may still read until the program ends; it is
    removed at exit if the session still runs then."""
    path = f"{shared_folder(spark, use).rstrip('/')}/{use}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:
            pass  # the session is gone, and with it the means to reach the store

    atexit.register(remove)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder.

    Checkpoint files are replicated by the shared store, so a lost executor costs no recomputation from the scan.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows written as a compressed table in the shared folder and read again: a checkpoint for wide rows that
    several branches read, each only the columns it needs."""
    spark = df.sparkSession
    path = scratch(spark, "tables")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_within(df: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """Hint a broadcast only after counting that the side is within ``max_rows``; else leave it to the optimizer."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
