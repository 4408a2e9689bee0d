"""Connected components of a graph of any size, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.relations import salted_join
from lakeloom.session import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the least node among the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return salted_join(both, least, ["u"], ["v"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node, and each smaller neighbour, is linked to the least smaller neighbour."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    own = least.select("u", F.col("m").alias("v"))
    rest = salted_join(down, least, ["u"], ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.unionByName(rest).where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(0x7FFFFFFF))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) edges -> (node, component) for every node with an edge to another; ``component`` is its least node.

    Null ends and loops give no row. Only (node, node) pairs are shuffled, minima are combined map-side, and no
    neighbour list is gathered; joins spread a hub's edges over salts, so a hub needs no large task. Each round's edges are checkpointed to the shared folder.
    Rounds grow with the square of the logarithm of the longest path; not converging in ``max_rounds`` is an error.
    """
    now = checkpointed(edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct())
    state = _state(now)
    for _ in range(max_rounds):
        now = checkpointed(_small_star(_large_star(now)))
        before, state = state, _state(now)
        if before == state:
            roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
