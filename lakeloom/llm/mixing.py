"""Problem 7: sources mixed to target weights."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.functions.catalog import catalogue_names, spelling
from lakeloom.llm.tokens import encoding, read_vocabulary
from lakeloom.session import broadcast_within, checkpointed
from lakeloom.sources.tables import table

SEED, BUCKET_BITS, BUCKET_DOCUMENTS, MAX_SOURCES = 7, 10, 50_000, 10_000
MIX_SCHEMA = "source string, doc_id long, epoch int, tokens long, taken long"


def sized_documents(documents: DataFrame, catalog: DataFrame, vocabulary: bytes | None = None) -> DataFrame:
    """(doc_id, source, text) -> (doc_id, catalogue_id, tokens) with exact tokens of a public tokenizer."""
    data = vocabulary or read_vocabulary()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(data)
        for p in batches:
            yield pd.DataFrame({"doc_id": p["doc_id"], "source": p["source"], "tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in p["text"]]})

    counted = documents.where("doc_id is not null").select("doc_id", "source", "text").mapInPandas(count, "doc_id long, source string, tokens long")
    names = broadcast_within(catalogue_names(catalog).select("spelled", "catalogue_id"))
    return counted.join(names, spelling(counted["source"]) == names["spelled"], "left").select("doc_id", "catalogue_id", "tokens")


def plan_budgets(available: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, tuple[int, int, int]]:
    """source -> (budget, full epochs, tokens of one more epoch).

    Without ``total`` the mix is as large as every source with tokens can follow within its repeats, so all shares are
    met. With one, a source that can't supply its share gives all its repeats and falls short. A budget is its share of
    the total rounded down. Sources without tokens, share or repeats give nothing, and don't limit the others.
    """
    able = {s: available.get(s, 0) * r for s, (share, r) in targets.items() if share > 0 and r > 0 and available.get(s, 0) > 0}
    if total is None:
        total = min((int(most / targets[s][0]) for s, most in able.items()), default=0)
    plan = {}
    for s, most in able.items():
        budget = min(int(total * targets[s][0] + 1e-6), most)
        plan[s] = (budget, budget // available[s], budget % available[s])
    return plan


def mix(sized: DataFrame, mix_targets: DataFrame, total_tokens: int | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Rows (source, doc_id, epoch, tokens, taken) of the mix, and (source, available, budget) of every target.

    Each document gets a random key by hash; within a source keys are cut into ranges (buckets), whose token sums are
    prefix-summed; there are 2^10 buckets or more, so that no window holds many more than 2 * BUCKET_DOCUMENTS. Full epochs take all documents;
    the last takes those in key order up to the budget, of the one on the edge the first ``taken`` tokens. Documents
    without tokens, and of sources without target, aren't in the mix. Only one sum per target reaches the driver.
    """
    rows = mix_targets.where("source is not null").groupBy("source").agg(F.max("target_share"), F.max("max_repeats")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources have targets")
    targets = {r[0]: (float(r[1] or 0), int(r[2] or 0)) for r in rows}
    spark = sized.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(s,) for s in targets], "catalogue_id string"))
    key = F.xxhash64(F.lit(seed), "doc_id")
    docs = checkpointed(sized.where("tokens > 0").join(wanted, "catalogue_id").select(F.col("catalogue_id").alias("source"), "doc_id", "tokens", key.alias("key")))
    sizes = {r[0]: (int(r[1]), int(r[2])) for r in docs.groupBy("source").agg(F.sum("tokens"), F.count("*")).collect()}
    available = {s: n for s, (n, _) in sizes.items()}
    most = max((n for _, n in sizes.values()), default=1)
    bits = max(BUCKET_BITS, (most // BUCKET_DOCUMENTS).bit_length())
    docs = docs.withColumn("bucket", F.shiftrightunsigned("key", 64 - bits).cast("int"))
    sums = docs.groupBy("source", "bucket").agg(F.sum("tokens").alias("sum"))
    plan = plan_budgets(available, targets, total_tokens)
    planned = F.broadcast(spark.createDataFrame([(s, *plan[s]) for s in sorted(plan)], "source string, budget long, epochs int, rest long"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = broadcast_within(sums.select("source", "bucket", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base")), 100_000)
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    placed = docs.join(planned, "source").join(base, ["source", "bucket"]).withColumn("start", start)
    last = F.least("tokens", F.greatest(F.col("rest") - F.col("start"), F.lit(0)))
    epochs = F.transform(F.when(F.col("epochs") > 0, F.sequence(F.lit(0), F.col("epochs") - 1)).otherwise(F.array().cast("array<int>")), lambda e: F.struct(e.alias("epoch"), F.col("tokens").alias("taken")))
    drawn = F.concat(epochs, F.array(F.struct(F.col("epochs").alias("epoch"), last.alias("taken"))))
    mixed = placed.select("source", "doc_id", "tokens", F.explode(drawn).alias("d")).select("source", "doc_id", "d.epoch", "tokens", "d.taken").where("taken > 0")
    report = spark.createDataFrame([(s, targets[s][0], targets[s][1], available.get(s, 0), plan.get(s, (0,))[0]) for s in sorted(targets)], "source string, target_share double, max_repeats int, available long, budget long")
    return mixed, report


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mix(sized_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "dataset_catalog")), table(spark, sf_dir, "mix_targets"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix, one row for each time one is used."""
    return _mixed(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source has, what it gives, how often its documents are used at most, and its share beside the target."""
    mixed, report = _mixed(spark, sf_dir)
    uses = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.sum("taken").alias("taken"))
    given = uses.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("uses").alias("most_uses"), F.count("*").alias("documents"))
    total = given.agg(F.sum("taken").alias("total"))
    return report.join(F.broadcast(given), "source", "left").crossJoin(F.broadcast(total)).select(
        "source", "target_share", "max_repeats", "available", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.coalesce("taken", F.lit(0)).alias("taken"), F.round(F.coalesce("taken", F.lit(0)) / F.col("total"), 6).alias("share")
    )


def p7_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of ``p7_shares``, per source that has tokens: nothing is repeated more often than allowed, and the share
    is met but for the whole tokens that rounding each budget down costs."""
    got = checkpointed(p7_shares(spark, sf_dir).where("available > 0"))
    sums = got.agg(F.sum("taken").alias("total"), F.sum("target_share").alias("shares"), F.count("*").alias("sources"))
    off = F.abs(F.col("taken") - F.col("target_share") / F.col("shares") * F.col("total")) > F.col("sources") + 1
    return got.crossJoin(F.broadcast(sums)).select("source", F.round("target_share", 6).alias("target_share"), "max_repeats", (F.col("most_uses") > F.col("max_repeats")).alias("over"), off.alias("off"))


QUERIES = {"p7_mix": p7_mix, "p7_shares": p7_shares, "p7_kept": p7_kept}
SQL = {"p7_kept": r"""WITH names AS (SELECT DISTINCT dataset_id, regexp_replace(regexp_replace(lower(trim(name)), '\s*@.*$', ''), '[-\s_]+', '_', 'g') AS name FROM (SELECT dataset_id, dataset_id AS name FROM dataset_catalog UNION ALL SELECT dataset_id, unnest(aliases) FROM dataset_catalog))
SELECT source, round(target_share, 6) AS target_share, max_repeats, false AS over, false AS off FROM mix_targets m WHERE EXISTS (SELECT 1 FROM documents d JOIN names n ON n.name = regexp_replace(regexp_replace(lower(trim(d.source)), '\s*@.*$', ''), '[-\s_]+', '_', 'g') WHERE n.dataset_id = m.source AND d.text <> '')"""}
