"""Append-only logs and sessions as Structured Streaming, run to the end of what is there."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lakeloom.session import scratch


def stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file or folder as a stream with the schema it has."""
    schema = spark.read.parquet(path).schema
    if os.path.isfile(path.removeprefix("file://")):
        folder, name = os.path.split(path)
        return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return spark.readStream.schema(schema).parquet(path)


def drain(rows: DataFrame, mode: str = "append") -> DataFrame:
    """All rows that a stream gives for what has arrived, each exactly once, written to the shared folder and read again."""
    spark, at = rows.sparkSession, scratch(rows.sparkSession, "streams")
    if mode == "append":
        q = rows.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/offsets").trigger(availableNow=True).start()
    else:
        def put(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{at}/out")

        q = rows.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{at}/offsets").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{at}/out")


def deduplicated(rows: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """Each key once; state is forgotten after ``late``."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def consumed_batches(rows: DataFrame, batch_of: Column, target: str) -> None:
    """Batches appended to ``target`` once each, however often a micro-batch is run again: one folder per number."""
    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", batch_of).write.mode("overwrite").parquet(f"{target}/epoch={number}")

    rows.writeStream.foreachBatch(put).option("checkpointLocation", f"{target}-offsets").trigger(availableNow=True).start().awaitTermination()


def whole_lines(text: str) -> list[str]:
    """Lines of a log that end in a line break; the one still being written is left."""
    return [l for l in text.split("\n")[:-1] if l.strip()]


def preview_schedule(rows: DataFrame, fresh_s: float = 1.5) -> DataFrame:
    """(session, at double) arrivals -> (session, at, audio): when a preview is due: at once, then whenever ``fresh_s`` of
    new time has come since the last one. Of what arrives together only the latest counts."""

    def due(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for t in sorted(pd.concat(list(batches))["at"]):
            if last is None or t - last >= fresh_s:
                out.append((key[0], t, 0.0 if last is None else t - last))
                last = t
        if last is not None:
            state.update((last,))
        if out:
            yield pd.DataFrame(out, columns=["session", "at", "audio"])

    return rows.groupBy("session").applyInPandasWithState(due, "session long, at double, audio double", "last double", "append", GroupStateTimeout.NoTimeout)


def stable_windows(total: Column, length: float = 6.0, tail: float = 7.0) -> Column:
    """Starts and ends of fixed windows; the last may be up to ``tail`` long."""
    n = F.greatest(F.floor(total / length) - F.when(F.pmod(total, F.lit(length)) <= tail - length, 1).otherwise(0), F.lit(0)).cast("int")
    fixed = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct((k * length).alias("s"), ((k + 1) * length).alias("e")))).otherwise(F.array().cast("array<struct<s: double, e: double>>"))
    return F.when(n * length < total, F.concat(fixed, F.array(F.struct((n * length).alias("s"), total.cast("double").alias("e"))))).otherwise(fixed)


def balanced_chunks(total: Column, longest: float = 27.0) -> Column:
    """(number, length) of equal chunks of at most ``longest``."""
    n = F.greatest(F.ceil(total / longest), F.lit(1))
    return F.struct(n.cast("int").alias("n"), (total / n).alias("length"))
