"""Spellings of catalogue names: dataset ids with aliases, and languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of a language besides its two-letter code, lower case, without region or script.
LANGUAGE_NAMES = {
    "zh": ["zh", "zho", "chi", "cmn", "chinese", "mandarin", "chinesisch", "中文", "汉语", "华语", "普通话", "国语"],
    "en": ["en", "eng", "english", "englisch", "英语", "英文"],
    "de": ["de", "deu", "ger", "german", "deutsch", "德语", "德文"],
}
MISSING_LANGUAGE = ["", "n/a", "na", "none", "null", "nan", "unknown", "-"]


def spelling(name: Column) -> Column:
    """The comparable form of a dataset name: no version after ``@``, no outer space, lower case, ``_`` as the only separator."""
    bare = F.regexp_replace(F.lower(F.trim(F.regexp_replace(name, r"[\s 　]+", " "))), r"\s*@.*$", "")
    return F.regexp_replace(bare, r"[-\s_]+", "_")


def two_letter_language(stored: Column, default: Column) -> Column:
    """The two-letter language meant; a missing one is ``default`` or else ``und``; an unknown name with a two-letter
    primary subtag is that subtag, any other is ``und``."""
    whole = F.lower(F.trim(F.regexp_replace(stored, r"[\s 　]+", " ")))
    primary = F.element_at(F.split(whole, r"[-_ ]"), 1)
    known = F.lit(None).cast("string")
    for code, names in LANGUAGE_NAMES.items():
        known = F.when(primary.isin(names), F.lit(code)).otherwise(known)
    return (
        F.when(stored.isNull() | whole.isin(MISSING_LANGUAGE), F.coalesce(default, F.lit("und")))
        .when(known.isNotNull(), known)
        .when(primary.rlike("^[a-z]{2}$"), primary)
        .otherwise(F.lit("und"))
    )


def catalogue_names(catalog: DataFrame) -> DataFrame:
    """One row per spelling of each dataset: (spelled, catalogue_id, only_language, domain).

    ``only_language`` is null unless all versions together give just one. A spelling that two datasets claim goes to
    a dataset of that very id, else to the first in order.
    """
    flat = catalog.where("dataset_id is not null").select("dataset_id", "languages", "aliases", F.get_json_object("provenance", "$.domain").alias("domain"))
    facts = flat.groupBy("dataset_id").agg(F.array_distinct(F.flatten(F.collect_list("languages"))).alias("languages"), F.max("domain").alias("domain"))
    own = flat.select("dataset_id", spelling(F.col("dataset_id")).alias("spelled"), F.lit(0).alias("rank"))
    other = flat.select("dataset_id", F.explode("aliases").alias("alias")).select("dataset_id", spelling(F.col("alias")).alias("spelled"), F.lit(1).alias("rank"))
    names = own.unionByName(other).where("spelled is not null").groupBy("spelled").agg(F.min(F.struct("rank", "dataset_id")).alias("best"))
    return names.join(facts, F.col("best.dataset_id") == facts["dataset_id"]).select(
        "spelled", F.col("best.dataset_id").alias("catalogue_id"), F.when(F.size("languages") == 1, F.element_at("languages", 1)).alias("only_language"), "domain"
    )


def split_groups(catalog: DataFrame) -> DataFrame:
    """(catalogue_id, catalogue_version, catalogue_split, split_group) of every split of every version."""
    return catalog.select("dataset_id", "version", F.explode("splits").alias("split", "spec")).select(
        F.col("dataset_id").alias("catalogue_id"), F.col("version").alias("catalogue_version"), F.col("split").alias("catalogue_split"), F.col("spec.split_group").alias("split_group")
    )
