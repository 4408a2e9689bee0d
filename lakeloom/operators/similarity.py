"""Vectors: cosine top-k in blocks, cohorts and centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.session import broadcast_within, checkpointed

ROWS_PER_BLOCK = 4096


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(d, lambda x: x / norm)).otherwise(d)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_top_k(queries: DataFrame, pool: DataFrame, k: int, cap: float, blocks: int | None = None, same_label: bool = False) -> DataFrame:
    """(id, v, label) on both sides -> (id, neighbour, cosine, rank): of the pool the ``k`` most alike below ``cap`` that
    have another label (with ``same_label`` that one and another id). Ties go to the smaller neighbour; rows with a null vector aren't compared.

    Queries against all rows, in blocks: the pool is cut into blocks of about ROWS_PER_BLOCK rows, every query block
    meets every pool block as one matrix product, and only each query's best ``k`` of a block are shuffled on.
    """
    q = queries.where("v is not null").select(F.col("id").alias("id"), "v", "label")
    p = pool.where("v is not null").select("id", "v", "label")
    many = blocks or max(1, -(-p.count() // ROWS_PER_BLOCK))
    qmany = max(1, -(-q.count() // ROWS_PER_BLOCK))
    left = q.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(qmany))).withColumn("pb", F.explode(F.sequence(F.lit(0), F.lit(many - 1)))).withColumn("side", F.lit(0))
    right = p.withColumn("pb", F.pmod(F.xxhash64("id"), F.lit(many))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qmany - 1)))).withColumn("side", F.lit(1))
    both = left.select("qb", "pb", "side", "id", "v", "label").unionByName(right.select("qb", "pb", "side", "id", "v", "label"))

    def best(group: pd.DataFrame) -> pd.DataFrame:
        a, b = group[group["side"] == 0], group[group["side"] == 1].sort_values("id")
        columns = ["id", "neighbour", "cosine"]
        if not len(a) or not len(b):
            return pd.DataFrame({c: np.zeros(0, t) for c, t in zip(columns, (np.int64, np.int64, float))})
        x, y = (np.stack(s["v"].to_numpy()).astype(np.float64) for s in (a, b))
        x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in (x, y))
        c = np.round(x @ y.T, 6)
        alike = a["label"].to_numpy()[:, None] == b["label"].to_numpy()[None, :]
        barred = ~alike | (a["id"].to_numpy()[:, None] == b["id"].to_numpy()[None, :]) if same_label else alike
        c[barred | (c >= cap)] = -np.inf
        n = min(k, c.shape[1])
        top = np.argsort(-c, axis=1, kind="stable")[:, :n]
        value = np.take_along_axis(c, top, 1)
        out = pd.DataFrame({"id": np.repeat(a["id"].to_numpy(), n), "neighbour": b["id"].to_numpy()[top].ravel(), "cosine": value.ravel()})
        return out[np.isfinite(out["cosine"])]

    found = both.groupBy("qb", "pb").applyInPandas(best, "id long, neighbour long, cosine double")
    w = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def padded(top: DataFrame, k: int) -> DataFrame:
    """(id, neighbours) with -1 where there are fewer than ``k``."""
    lists = top.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour"))).alias("x"))
    return lists.select("id", F.slice(F.concat(F.transform("x", lambda s: s["neighbour"]), F.array_repeat(F.lit(-1).cast("long"), k)), 1, k).alias("neighbours"))


def centroids(rows: DataFrame, label: str, v: str) -> DataFrame:
    """(label, pos, mean, n) of each element."""
    return rows.select(label, F.posexplode(v).alias("pos", "x")).groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.count("*").alias("n"))


def rest_consistency(rows: DataFrame, key: str, label: str, v: str) -> DataFrame:
    """(key, label, consistency): cosine of each vector to the mean of the others of its label; null for one alone.

    Sums per label come from one aggregation; no pairs are made.
    """
    e = rows.select(key, label, F.posexplode(v).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    sums = e.groupBy(label, "pos").agg(F.sum("x").alias("total"), F.count("*").alias("n"))
    j = e.join(sums, [label, "pos"]).withColumn("rest", (F.col("total") - F.col("x")) / (F.col("n") - 1))
    g = j.groupBy(key, label).agg(F.sum(F.col("x") * F.col("rest")).alias("d"), F.sum(F.col("x") * F.col("x")).alias("a"), F.sum(F.col("rest") * F.col("rest")).alias("b"), F.max("n").alias("n"))
    return g.select(key, label, F.when(F.col("n") > 1, F.col("d") / F.sqrt(F.col("a") * F.col("b"))).alias("consistency"))


BINS = 10_000


def similarity_counts(queries: DataFrame, pool: DataFrame) -> DataFrame:
    """(id, v, label) on both sides -> (id, label, bin, n): how many rows of the pool of its label, itself aside, have each
    cosine to a query, in steps of 1 / BINS.

    Labels are cut into blocks of about ROWS_PER_BLOCK rows; blocks of queries meet blocks of the pool as one matrix
    product, and only the counts, at most 2 * BINS + 1 a query and block, are passed on. No pairs are listed, so a label
    with a third of all rows makes more blocks, not a larger task.
    """
    q, p = (x.where("v is not null").select("id", "v", "label") for x in (queries, pool))
    blocks = lambda x, name: x.groupBy("label").agg(F.ceil(F.count("*") / ROWS_PER_BLOCK).alias(name))
    grid = broadcast_within(blocks(q, "qn").join(blocks(p, "pn"), "label"))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = q.join(grid, "label").select("label", own("qn").alias("qb"), every("pn").alias("pb"), F.lit(0).alias("side"), "id", "v")
    right = p.join(grid, "label").select("label", every("qn").alias("qb"), own("pn").alias("pb"), F.lit(1).alias("side"), "id", "v")

    def count(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        a, b = group[group["side"] == 0], group[group["side"] == 1]
        out = {"id": [np.zeros(0, np.int64)], "bin": [np.zeros(0, np.int64)], "n": [np.zeros(0, np.int64)]}
        if len(a) and len(b):
            x, y = (np.stack(s["v"].to_numpy()).astype(np.float64) for s in (a, b))
            x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in (x, y))
            at = np.rint(x @ y.T * BINS).astype(np.int64)
            others = a["id"].to_numpy()[:, None] != b["id"].to_numpy()[None, :]
            for i, rid in enumerate(a["id"].to_numpy()):
                bins, n = np.unique(at[i][others[i]], return_counts=True)
                out["id"].append(np.full(len(bins), rid))
                out["bin"].append(bins)
                out["n"].append(n)
        p = pd.DataFrame({k: np.concatenate(v) for k, v in out.items()})
        return p.assign(label=[key[0]] * len(p))

    schema = f"id long, bin long, n long, label {pool.schema['label'].dataType.simpleString()}"
    return left.unionByName(right).groupBy("label", "qb", "pb").applyInPandas(count, schema).groupBy("id", "label", "bin").agg(F.sum("n").alias("n"))


def count_medians(counts: DataFrame, least: float = 2.0) -> DataFrame:
    """(id, label, median, peers, good) of ``similarity_counts``: ``good`` of the peers have a cosine of at least ``least``."""
    sizes = counts.groupBy("id", "label").agg(F.sum("n").alias("peers"), F.sum(F.when(F.col("bin") >= F.lit(round(least * BINS)), F.col("n")).otherwise(0)).alias("good"))
    w = Window.partitionBy("id", "label").orderBy("bin")
    seen = counts.withColumn("upto", F.sum("n").over(w)).join(sizes, ["id", "label"])
    low, high = (F.min(F.when(F.col("upto") >= at, F.col("bin"))) for at in (F.expr("(peers + 1) div 2"), F.expr("peers div 2 + 1")))
    return seen.groupBy("id", "label").agg(((low + high) / 2.0 / BINS).alias("median"), F.max("peers").alias("peers"), F.max("good").alias("good"))


def medoids(candidates: DataFrame, pool: DataFrame) -> DataFrame:
    """(label, medoid, median): of each label's candidates the one with the highest median cosine, in steps of 1 / BINS, to
    the other rows of the label; ties go to the smaller id. A label of a single row has none."""
    m = count_medians(similarity_counts(candidates, pool))
    return m.groupBy("label").agg(F.max_by("id", F.struct("median", -F.col("id"))).alias("medoid"), F.max("median").alias("median"))


def cohort_decisions(candidates: DataFrame, pool: DataFrame, queries: DataFrame, least: float = 0.65, share: float = 0.6) -> DataFrame:
    """Each query's decision (label, id, medoid, in_cohort, cohort_share, median, passed), all rows being references.

    The medoid is one of the candidates. The cohort of a label are its medoid and the rows with at least ``least`` to it.
    It is consistent with three rows or more that are at least ``share`` of the label's. A query passes if its label is
    consistent, two or more others of the cohort have at least ``least`` to it, and so has their median. A label of
    fewer than three rows has no cohort; one of a single row has no row here.
    """
    pool = pool.where("v is not null")
    center = checkpointed(medoids(candidates, pool).select("label", "medoid"))
    vectors = pool.join(broadcast_within(center), "label").where("id = medoid").select("label", "medoid", unit(F.col("v")).alias("center"))
    scored = pool.join(broadcast_within(vectors), "label").select("id", "v", "label", "medoid", F.rint(dot(unit(F.col("v")), F.col("center")) * BINS).alias("to"))
    scored = scored.withColumn("member", (F.col("id") == F.col("medoid")) | (F.col("to") >= least * BINS))
    labels = scored.groupBy("label").agg(F.max("medoid").alias("medoid"), F.count("*").alias("n"), F.sum(F.col("member").cast("long")).alias("size"))
    labels = broadcast_within(labels.select("label", "medoid", "n", F.when(F.col("n") >= 3, F.col("size")).otherwise(0).alias("size")))
    seen = count_medians(similarity_counts(queries, scored.where("member").select("id", "v", "label")), least)
    own = scored.select("id", "label", "member")
    items = queries.where("v is not null").select("id", "label").join(own, ["id", "label"]).join(labels, "label").join(seen, ["id", "label"], "left")
    none = F.col("size") == 0
    passed = (F.col("size") >= 3) & (F.col("size") >= share * F.col("n")) & (F.col("peers") >= 2) & (F.col("median") >= least) & (F.col("good") >= 2)
    return items.select("label", "id", "medoid", (F.col("member") & ~none).alias("in_cohort"), (F.col("size") / F.col("n")).alias("cohort_share"), F.when(~none, F.col("median")).alias("median"), F.coalesce(passed, F.lit(False)).alias("passed"))


def link_clusters(similarity: np.ndarray, threshold: float, cannot: np.ndarray | None = None) -> list[int]:
    """Average-linkage clusters above a threshold; pairs in ``cannot`` never share one. Labels in order of first item."""
    n = len(similarity)
    s = similarity.astype(float).copy()
    np.fill_diagonal(s, -np.inf)
    if cannot is not None:
        s[cannot] = -np.inf
    members, size, alive = [[i] for i in range(n)], np.ones(n), np.ones(n, bool)
    while alive.sum() > 1:
        live = np.where(alive[:, None] & alive[None, :], s, -np.inf)
        i, j = divmod(int(live.argmax()), n)
        if live[i, j] < threshold:
            break
        i, j = min(i, j), max(i, j)
        both = (size[i] * s[i] + size[j] * s[j]) / (size[i] + size[j])
        s[i], s[:, i] = both, both
        s[i, i] = -np.inf
        size[i] += size[j]
        members[i] += members[j]
        alive[j] = False
    order = sorted((m for m, a in zip(members, alive) if a), key=min)
    out = [0] * n
    for label, m in enumerate(order):
        for x in m:
            out[x] = label
    return out


def two_stage_clusters(similarity: np.ndarray, speech: np.ndarray, high: float, low: float, small: float, cannot: np.ndarray | None = None) -> list[int]:
    """Clusters at a high threshold first; those with less than ``small`` of all speech join the large one they are most
    like on average, if at least ``low``."""
    labels = np.array(link_clusters(similarity, high, cannot))
    share = {c: speech[labels == c].sum() / max(speech.sum(), 1e-12) for c in set(labels)}
    large = [c for c in share if share[c] >= small]
    out = labels.copy()
    for c in sorted(set(share) - set(large)):
        mean = {b: similarity[np.ix_(labels == c, labels == b)].mean() for b in large if cannot is None or not cannot[np.ix_(labels == c, labels == b)].any()}
        if mean and max(mean.values()) >= low:
            out[labels == c] = max(mean, key=lambda b: (mean[b], -b))
    names = {c: k for k, c in enumerate(dict.fromkeys(out.tolist()))}
    return [names[c] for c in out.tolist()]


def session_clusters(rows: DataFrame, threshold: float, low: float | None = None, small: float = 0.0, stretch: int = 2048) -> DataFrame:
    """(session, id, v) -> (session, id, cluster), one session at a time; a null vector is a cluster of its own.

    With ``low`` and (speech, cut) columns in two stages: clusters with less than ``small`` of a session's speech join a
    large one at ``low``, and rows of one cut never share a cluster. Sessions are bounded; one of more than ``stretch``
    rows is clustered in parts of about that many by hash, and the parts' clusters don't meet.
    """
    two = low is not None
    sizes = rows.groupBy("session").agg(F.ceil(F.count("*") / stretch).alias("parts"))
    at = rows.join(sizes, "session").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))

    def link(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("id")
        has = p["v"].notna().to_numpy()
        out = np.full(len(p), -1)
        if has.any():
            x = np.stack(p["v"].to_numpy()[has]).astype(float)
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            like = np.round(x @ x.T, 9)
            if two:
                cut = p["cut"].to_numpy()[has]
                apart = (cut[:, None] == cut[None, :]) & ~np.eye(len(cut), dtype=bool)
                out[has] = two_stage_clusters(like, p["speech"].to_numpy()[has], threshold, low, small, apart)
            else:
                out[has] = link_clusters(like, threshold)
        top = out.max() + 1
        out[~has] = top + np.arange((~has).sum())
        return pd.DataFrame({"session": p["session"], "id": p["id"], "part": p["part"], "cluster": out})

    more = ["speech", "cut"] if two else []
    found = at.select("session", "part", "id", "v", *more).groupBy("session", "part").applyInPandas(link, "session long, id long, part long, cluster int")
    first = found.groupBy("session", "part").agg((F.max("cluster") + 1).alias("n")).withColumn("first", F.coalesce(F.sum("n").over(Window.partitionBy("session").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return found.join(first, ["session", "part"]).select("session", "id", (F.col("cluster") + F.col("first")).cast("int").alias("cluster"))
