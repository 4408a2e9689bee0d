"""Problem 1: how many tokens each source, language and domain provides."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions.catalog import catalogue_names, spelling, two_letter_language
from lakeloom.llm.tokens import longest_match, read_vocabulary
from lakeloom.session import broadcast_within
from lakeloom.sources.tables import table


def sized(items: DataFrame, catalog: DataFrame, vocabulary: bytes | None = None) -> DataFrame:
    """(item, dataset, language, text) -> (item, dataset, language, tokens, catalogue_id, meant, domain), a row per row.

    Tokens are exact longest-match counts (trie with failure links), 0 for a null or empty text. ``catalogue_id`` and
    ``domain`` are null where no dataset of the catalogue is meant; ``meant`` is the two-letter language or ``und``.
    The text leaves the row in the first stage, so no shuffle carries it.
    """
    data = vocabulary or read_vocabulary()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = longest_match(data)
        for p in batches:
            yield pd.DataFrame({"item": p["item"], "dataset": p["dataset"], "language": p["language"], "tokens": [matcher.count(t) for t in p["text"]]})

    counted = items.select(F.col("item").cast("string"), "dataset", "language", "text").mapInPandas(count, "item string, dataset string, language string, tokens long")
    names = broadcast_within(catalogue_names(catalog))
    return counted.join(names, spelling(counted["dataset"]) == names["spelled"], "left").select(
        "item", "dataset", "language", "tokens", "catalogue_id", two_letter_language(F.col("language"), F.col("only_language")).alias("meant"), "domain"
    )


def record_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "audio_records").select(F.col("id").alias("item"), F.col("dataset_id").alias("dataset"), "language", F.col("target").alias("text"))


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.col("source").alias("dataset"), F.col("lang").alias("language"), "text")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose stored dataset or language isn't the catalogue's, with what is meant."""
    catalog = table(spark, sf_dir, "dataset_catalog")
    ids = broadcast_within(catalog.where("dataset_id is not null").select(F.col("dataset_id").alias("literal")).distinct())
    rows = sized(record_items(spark, sf_dir), catalog)
    odd = rows.join(ids, rows["dataset"] == ids["literal"], "left").where("literal is null or language is null or language not in ('zh', 'en', 'de')")
    return odd.where("tokens is not null").select(F.col("item").alias("id"), F.col("catalogue_id").alias("dataset_id"), F.col("meant").alias("language")).distinct()


def p1_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, tokens and the largest text of each kind of item, dataset, language and domain; redelivered records count once."""
    catalog = table(spark, sf_dir, "dataset_catalog")
    records = sized(record_items(spark, sf_dir), catalog).groupBy("item").agg(F.min(F.struct("tokens", "catalogue_id", "meant", "domain")).alias("r")).select(F.lit("record").alias("kind"), "r.*")
    documents = sized(document_items(spark, sf_dir), catalog).select(F.lit("document").alias("kind"), "tokens", "catalogue_id", "meant", "domain")
    return (
        records.unionByName(documents)
        .groupBy("kind", F.coalesce("catalogue_id", F.lit("unknown")).alias("dataset_id"), F.col("meant").alias("language"), F.coalesce("domain", F.lit("unknown")).alias("domain"))
        .agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("largest"))
    )


def p1_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many items the totals of ``p1_token_budget`` are over."""
    return p1_token_budget(spark, sf_dir).select("kind", "dataset_id", "language", "domain", "items")


QUERIES = {"p1_found": p1_found, "p1_token_budget": p1_token_budget, "p1_items": p1_items}

NAMES_SQL = """
own AS (SELECT dataset_id, languages, json_extract_string(provenance, '$.domain') AS domain, aliases FROM dataset_catalog),
spelled AS (
  SELECT DISTINCT dataset_id, regexp_replace(regexp_replace(lower(trim(name)), '\\s*@.*$', ''), '[-\\s_]+', '_', 'g') AS name
  FROM (SELECT dataset_id, dataset_id AS name FROM own UNION ALL SELECT dataset_id, unnest(aliases) FROM own)
),
facts AS (SELECT dataset_id, min(l) AS first_language, count(DISTINCT l) AS n, max(domain) AS domain FROM (SELECT dataset_id, domain, unnest(languages) AS l FROM own) GROUP BY dataset_id),
names AS (SELECT s.name, s.dataset_id, CASE WHEN f.n = 1 THEN f.first_language END AS only_language, f.domain FROM spelled s JOIN facts f USING (dataset_id))
"""
_MEANT = """CASE WHEN {x} IS NULL OR lower(trim({x})) IN ('', 'n/a') THEN coalesce(n.only_language, 'und')
       WHEN regexp_extract(lower(trim({x})), '^[^-_ ]+') IN ('zh', 'zho', 'chi', 'cmn', 'chinese', '中文') THEN 'zh'
       WHEN regexp_extract(lower(trim({x})), '^[^-_ ]+') IN ('en', 'eng', 'english') THEN 'en'
       WHEN regexp_extract(lower(trim({x})), '^[^-_ ]+') IN ('de', 'deu', 'ger', 'german', 'deutsch') THEN 'de' ELSE 'und' END"""
_NAMED = "LEFT JOIN names n ON n.name = regexp_replace(regexp_replace(lower(trim({x})), '\\s*@.*$', ''), '[-\\s_]+', '_', 'g')"
SQL = {
    "p1_items": f"""
WITH {NAMES_SQL},
r AS (SELECT DISTINCT ON (r.id) 'record' AS kind, n.dataset_id, {_MEANT.format(x='r.language')} AS language, n.domain FROM audio_records r {_NAMED.format(x='r.dataset_id')}),
d AS (SELECT 'document' AS kind, n.dataset_id, {_MEANT.format(x='d.lang')} AS language, n.domain FROM documents d {_NAMED.format(x='d.source')})
SELECT kind, coalesce(dataset_id, 'unknown') AS dataset_id, language, coalesce(domain, 'unknown') AS domain, count(*) AS items FROM (SELECT * FROM r UNION ALL SELECT * FROM d) GROUP BY ALL""",
    "p1_found": f"""
WITH {NAMES_SQL}
SELECT DISTINCT r.id, n.dataset_id,
  CASE WHEN r.language IS NULL OR lower(trim(r.language)) IN ('', 'n/a') THEN coalesce(n.only_language, 'und')
       WHEN regexp_extract(lower(trim(r.language)), '^[^-_ ]+') IN ('zh', 'zho', 'chi', 'cmn', 'chinese', '中文') THEN 'zh'
       WHEN regexp_extract(lower(trim(r.language)), '^[^-_ ]+') IN ('en', 'eng', 'english') THEN 'en'
       WHEN regexp_extract(lower(trim(r.language)), '^[^-_ ]+') IN ('de', 'deu', 'ger', 'german', 'deutsch') THEN 'de' ELSE 'und' END AS language
FROM audio_records r LEFT JOIN names n ON n.name = regexp_replace(regexp_replace(lower(trim(r.dataset_id)), '\\s*@.*$', ''), '[-\\s_]+', '_', 'g')
WHERE r.dataset_id IS NULL OR r.dataset_id NOT IN (SELECT dataset_id FROM dataset_catalog) OR r.language IS NULL OR r.language NOT IN ('zh', 'en', 'de')
""",
}
