"""Problem 6: documents into containers of fixed capacity, neighbours on a space-filling curve together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.tokens import encoding, read_vocabulary
from lakeloom.session import checkpointed
from lakeloom.sources.tables import table

FEATURES, DIMENSIONS, BITS, WINDOW, KEEP_OPEN = 256, 3, 10, 1024, 512
ITEM_SCHEMA = "limit_name string, container_id string, doc_id long, piece_no int, token_start long, tokens long"


def limits_of(size_limits: DataFrame, prefix: str) -> list[tuple[str, int, int]]:
    """(name, capacity, overlap) of the limits named ``prefix...``; at most 100, each with a positive capacity."""
    rows = size_limits.where(F.col("limit_name").startswith(prefix)).select("limit_name", "capacity_tokens", F.coalesce("overlap_tokens", F.lit(0))).distinct().limit(101).collect()
    if len(rows) > 100 or any(r[1] is None or r[1] < 1 for r in rows):
        raise ValueError("size_limits must give 1 to 100 limits with a positive capacity")
    return sorted((r[0], int(r[1]), int(r[2])) for r in rows)


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The Hilbert index of each row of ``cells`` (rows, dimensions), by Skilling's transposed form."""
    x = cells.astype(np.int64).T.copy()
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x[0] ^= np.where(high, p, t)
            x[i] ^= np.where(high, 0, t)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def curve_cells(ids: np.ndarray) -> np.ndarray:
    """A document's cell: token ids hashed into signed features, scaled to length 1, projected by a fixed random matrix."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sign = 1.0 - 2.0 * ((h >> np.uint64(40)) & np.uint64(1)).astype(float)
    v = np.bincount((h >> np.uint64(56)).astype(np.int64), sign, FEATURES)
    norm = np.sqrt((v * v).sum())
    p = _PROJECTION @ (v / norm) if norm else np.zeros(DIMENSIONS)
    return np.clip((0.5 + 0.5 * np.tanh(p)) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


_PROJECTION = np.random.default_rng(20260214).standard_normal((DIMENSIONS, FEATURES))


def curve_positions(documents: DataFrame, vocabulary: bytes | None = None) -> DataFrame:
    """(doc_id, text) -> (doc_id, tokens, curve): exact tokens, and the place on the curve. The text goes no further."""
    data = vocabulary or read_vocabulary()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(data)
        for p in batches:
            ids = [np.array(enc.encode_ordinary(t), np.int64) if t else np.zeros(0, np.int64) for t in p["text"]]
            if ids:
                yield pd.DataFrame({"doc_id": p["doc_id"], "tokens": [len(x) for x in ids], "curve": hilbert_key(np.array([curve_cells(x) for x in ids]))})

    return documents.where("doc_id is not null").select("doc_id", "text").mapInPandas(place, "doc_id long, tokens long, curve long")


class BestFit:
    """Open containers of one capacity, found by free space through a bit mask in constant time."""

    def __init__(self, capacity: int):
        self.capacity, self.mask, self.by_free = capacity, 0, {}

    def put(self, size: int, name: str) -> str:
        """The container with least sufficient free space, or a new one called ``name``."""
        fit = self.mask >> size
        if fit:
            free = size + (fit & -fit).bit_length() - 1
            names = self.by_free[free]
            name = names.pop()
            if not names:
                self.mask ^= 1 << free
        else:
            free = self.capacity
        rest = free - size
        if not self.mask >> rest & 1:
            self.mask |= 1 << rest
            self.by_free[rest] = []
        self.by_free[rest].append(name)
        return name

    def close(self, keep: int) -> None:
        """Keep the ``keep`` emptiest containers open."""
        for free in sorted((f for f, n in self.by_free.items() if n), reverse=True):
            names = self.by_free[free]
            del names[keep:]
            keep -= len(names)
            if not names:
                self.mask ^= 1 << free


def _fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Items in curve order -> their containers. Each window of neighbours is packed largest first, best fit, into
    what earlier windows left open."""
    name, fit, waiting = None, None, []

    def flush():
        rows = []
        for size, doc, piece, start, _ in sorted(waiting, key=lambda w: (-w[0], w[4])):
            rows.append((name, fit.put(size, f"{doc}.{piece}"), doc, piece, start, size))
        waiting.clear()
        fit.close(KEEP_OPEN)
        return pd.DataFrame(rows, columns=["limit_name", "container_id", "doc_id", "piece_no", "token_start", "tokens"])

    for p in batches:
        for limit, capacity, doc, piece, start, size in zip(p["limit_name"], p["capacity"], p["doc_id"], p["piece_no"], p["token_start"], p["tokens"]):
            if limit != name:
                if waiting:
                    yield flush()
                name, fit = limit, BestFit(int(capacity))
            waiting.append((int(size), int(doc), int(piece), int(start), len(waiting)))
            if len(waiting) >= WINDOW:
                yield flush()
    if waiting:
        yield flush()


def pack(documents: DataFrame, limits: list[tuple[str, int, int]], vocabulary: bytes | None = None) -> DataFrame:
    """(limit_name, container_id, doc_id, piece_no, token_start, tokens): every document once per limit, whole unless it
    exceeds the capacity. Of one that does, full pieces are containers of their own and the rest is an item like others.

    Null and empty texts are items of size 0 in some container. doc_id must be unique, as a container is named after
    its first item; rows with a null doc_id are left out. Partitions follow the curve and no task holds more than a
    window and KEEP_OPEN open containers.
    """
    at = curve_positions(documents, vocabulary)
    if not limits:
        return at.sparkSession.createDataFrame([], ITEM_SCHEMA)
    each = F.array(*[F.struct(F.lit(n).alias("limit_name"), F.lit(c).cast("long").alias("capacity")) for n, c, _ in limits])
    sized = checkpointed(at).select("doc_id", "tokens", "curve", F.explode(each).alias("l")).select("doc_id", "tokens", "curve", "l.limit_name", "l.capacity")
    full = F.floor((F.col("tokens") - 1) / F.col("capacity"))
    whole = sized.where("tokens > capacity").select("limit_name", "doc_id", "capacity", F.explode(F.sequence(F.lit(0), (full - 1).cast("int"))).alias("piece_no"))
    filled = whole.select("limit_name", F.concat_ws(".", "doc_id", "piece_no").alias("container_id"), "doc_id", "piece_no", (F.col("piece_no") * F.col("capacity")).alias("token_start"), F.col("capacity").alias("tokens"))
    rest = sized.select(
        "limit_name", "capacity", "doc_id", F.greatest(full, F.lit(0)).cast("int").alias("piece_no"), (F.greatest(full, F.lit(0)) * F.col("capacity")).alias("token_start"), (F.col("tokens") - F.greatest(full, F.lit(0)) * F.col("capacity")).alias("tokens"), "curve"
    )
    ordered = rest.repartitionByRange("limit_name", "curve", "doc_id").sortWithinPartitions("limit_name", "curve", "doc_id").drop("curve")
    return ordered.mapInPandas(_fill, ITEM_SCHEMA).unionByName(filled)


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, or piece of an oversized one, for each ``pack_`` limit."""
    return pack(table(spark, sf_dir, "documents"), limits_of(table(spark, sf_dir, "size_limits"), "pack_"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens, the share of space used and the documents cut, per limit."""
    limits = table(spark, sf_dir, "size_limits").where("limit_name like 'pack\\_%'").select("limit_name", "capacity_tokens")
    packed = p6_packing(spark, sf_dir)
    bins = packed.groupBy("limit_name", "container_id").agg(F.sum("tokens").alias("used"), F.count("*").alias("items"), F.sum((F.col("piece_no") > 0).cast("long")).alias("more"))
    sums = bins.groupBy("limit_name").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), F.sum("items").alias("items"), F.sum("more").alias("cuts"))
    return sums.join(limits, "limit_name").withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 4))


def p6_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of ``p6_packing``, per limit: every document is there; no container is over capacity; no document has a
    gap or an overlap between its pieces (``broken``) or is cut below the capacity; fill is at least 95 %, once there are
    a hundred containers."""
    limits = table(spark, sf_dir, "size_limits").where("limit_name like 'pack\\_%'").select("limit_name", "capacity_tokens")
    packed = checkpointed(p6_packing(spark, sf_dir)).join(F.broadcast(limits), "limit_name")
    docs = packed.groupBy("limit_name", "doc_id").agg(F.sum("tokens").alias("tokens"), F.max(F.col("token_start") + F.col("tokens")).alias("stop"), F.count("*").alias("pieces"), F.count_distinct("piece_no").alias("numbers"), F.max("capacity_tokens").alias("capacity"))
    per_doc = docs.groupBy("limit_name").agg(F.count("*").alias("documents"), F.sum(((F.col("tokens") != F.col("stop")) | (F.col("pieces") != F.col("numbers"))).cast("long")).alias("broken"), F.sum(((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity"))).cast("long")).alias("needless"))
    bins = packed.groupBy("limit_name", "container_id").agg(F.sum("tokens").alias("used"), F.max("capacity_tokens").alias("capacity"))
    per_bin = bins.groupBy("limit_name").agg(F.sum((F.col("used") > F.col("capacity")).cast("long")).alias("over"), ((F.sum("used") < 0.95 * F.sum("capacity")) & (F.count("*") >= 100)).alias("loose"))
    return per_doc.join(per_bin, "limit_name")


QUERIES = {"p6_packing": p6_packing, "p6_fill": p6_fill, "p6_kept": p6_kept}
SQL = {"p6_kept": "SELECT limit_name, (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL) AS documents, 0 AS broken, 0 AS needless, 0 AS over, false AS loose FROM size_limits WHERE limit_name LIKE 'pack\\_%' ESCAPE '\\'"}
