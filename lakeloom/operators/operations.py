"""What a driver asks of tables: order of tasks, latest attempts, stale overviews, arms of a recipe, synchronised logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.selection import largest_remainder
from lakeloom.session import checkpointed


def task_levels(tasks: DataFrame, needs: DataFrame, most: int = 100) -> DataFrame:
    """(task) and (task, needed) -> (task, level, missing): tasks of one level need only tasks of lower ones.

    ``missing`` counts needed tasks that aren't there; they hold nothing up. A cycle, or a chain longer than ``most``,
    is an error. One round a level; the edges are joined by task, nothing is collected.
    """
    edges = needs.where("task is not null and needed is not null").distinct()
    known = tasks.select("task").distinct()
    missing = edges.join(known.select(F.col("task").alias("needed")), "needed", "left_anti").groupBy("task").agg(F.count("*").alias("missing"))
    edges = checkpointed(edges.join(known.select(F.col("task").alias("needed")), "needed", "left_semi").join(known, "task", "left_semi"))
    now = checkpointed(known.withColumn("level", F.lit(0)))
    for _ in range(most):
        up = edges.join(now.select(F.col("task").alias("needed"), (F.col("level") + 1).alias("least")), "needed").groupBy("task").agg(F.max("least").alias("least"))
        nxt = checkpointed(now.join(up, "task", "left").select("task", F.greatest("level", "least").alias("level"), (F.col("least") > F.col("level")).alias("moved")))
        moved = nxt.where("moved").limit(1).count()
        now = nxt.drop("moved")
        if not moved:
            return now.join(missing, "task", "left").select("task", "level", F.coalesce("missing", F.lit(0)).alias("missing"))
    raise ValueError(f"tasks need one another in a circle, or in a chain of more than {most}")


def runnable(levels: DataFrame, needs: DataFrame, done: DataFrame) -> DataFrame:
    """(task, level, missing, state): ``done`` tasks are skipped; ``ready`` ones need only done tasks; others are ``blocked``."""
    finished = done.select("task").distinct()
    open_needs = needs.join(finished.select(F.col("task").alias("needed")), "needed", "left_anti").select("task").distinct().withColumn("held", F.lit(True))
    j = levels.join(finished.withColumn("finished", F.lit(True)), "task", "left").join(open_needs, "task", "left")
    return j.select("task", "level", "missing", F.when(F.col("finished"), "done").when(F.col("held"), "blocked").otherwise("ready").alias("state"))


def latest_attempt(rows: DataFrame, attempts: DataFrame, key: str, at: str, what: str) -> DataFrame:
    """Rows with ``latest``, the ``what`` of the most recent attempt of their key, and ``attempts``, how many there are."""
    per = attempts.groupBy(key).agg(F.max_by(what, F.struct(at, what)).alias("latest"), F.count("*").alias("attempts"))
    return rows.join(per, key, "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))


def overview_changes(overview: DataFrame, rows: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, state): an overview (key, digest) against what the rows (key, digest) are now: ``current``, ``stale``, ``gone``
    or ``new``."""
    j = overview.select(key, F.col(digest).alias("was")).join(rows.select(key, F.col(digest).alias("now")), key, "full")
    return j.select(key, F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("was") == F.col("now"), "current").otherwise("stale").alias("state"))


def recipe_arms(weights: DataFrame, window: int, replay: dict[str, float]) -> DataFrame:
    """(source, weight, trained) -> (arm, source, quota): for each arm a window in which the share ``replay`` says goes to
    trained sources and the rest to new ones, by weight among each. An arm of 0 is the control without replay."""
    out = None
    for arm, share in sorted(replay.items()):
        again = round(window * share)
        for trained, size in ((True, again), (False, window - again)):
            q = largest_remainder(weights.where(F.col("trained") == trained).select("source", "weight"), size, ["source"]).select(F.lit(arm).alias("arm"), "source", "quota")
            out = q if out is None else out.unionByName(q)
    return out


def terminal_check(log: DataFrame, remote: DataFrame, terminal: list[str]) -> DataFrame:
    """(key, state, at) here and there -> (key, here, there, error) of keys whose last states differ (``differs``), that only
    one side has (``missing``), or whose last state isn't a ``terminal`` one (``open``)."""
    last = lambda x, name: x.groupBy("key").agg(F.max_by("state", F.struct("at", "state")).alias(name))
    j = last(log, "here").join(last(remote, "there"), "key", "full")
    error = F.when(F.col("here").isNull() | F.col("there").isNull(), "missing").when(F.col("here") != F.col("there"), "differs").when(~F.col("here").isin(terminal), "open")
    return j.withColumn("error", error).where("error is not null")
