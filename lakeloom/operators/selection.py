"""Row selection: quality flags, id lists, durations, hold-outs, partitions, read rules, quotas and samples.

All filters are plain column predicates or semi and anti joins, so Catalyst pushes what it can into the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.draws import hash_order


def clean_flag(metadata: Column) -> Column:
    """``metadata.clean.pass`` if it is a JSON boolean; null for a missing, textual or numeric flag, or bad JSON."""
    return F.from_json(metadata, "clean struct<pass: boolean>")["clean"]["pass"]


def clean_pass(metadata: Column) -> Column:
    """True only for the boolean true."""
    return F.coalesce(clean_flag(metadata), F.lit(False))


def supervision_clean(start: Column, duration: Column, cut_duration: Column, flag: Column) -> Column:
    """A labelled span with a passed flag, a positive duration, and inside its cut."""
    return F.coalesce((flag == F.lit(True)) & (duration > 0) & (start >= 0) & (start + duration <= cut_duration), F.lit(False))


def main_slot(slots: Column) -> Column:
    """The slot ``primary``, else ``mixture``, else the last; null without slots."""
    named = lambda n: F.get(F.filter(slots, lambda s: s["name"] == n), F.lit(0))
    return F.coalesce(named("primary"), named("mixture"), F.get(slots, F.size(slots) - 1))


def include_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def exclude_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key isn't listed; a null key isn't listed."""
    return rows.join(ids.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def allow_prefixed(rows: DataFrame, allowed: DataFrame, prefix: Column, key: str = "id") -> DataFrame:
    """Rows allowed under their id or under ``prefix`` + id."""
    names = allowed.select(F.col(key).alias("allowed_id")).distinct()
    tries = rows.withColumn("tried_id", F.explode(F.array(F.col(key), F.concat(prefix, F.col(key)))))
    return tries.join(names, F.col("tried_id") == F.col("allowed_id"), "left_semi").drop("tried_id").dropDuplicates([key])


def holdout_anti(rows: DataFrame, keys: DataFrame, row_keys: Column) -> DataFrame:
    """Rows none of whose source keys is held out."""
    return rows.withColumn("held_keys", row_keys).join(
        rows.withColumn("source_key", F.explode(row_keys)).join(keys.select(F.col("key").alias("source_key")).distinct(), "source_key", "left_semi").select("id").distinct(), "id", "left_anti"
    ).drop("held_keys")


def hash_holdout(key: Column, modulus: int) -> Column:
    """Whether the first 60 bits of the key's SHA-256 divide by ``modulus`` (at least 2)."""
    if modulus < 2:
        raise ValueError("the modulus is at least 2")
    return F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 15), 16, 10).cast("long"), F.lit(modulus)) == 0


def mixture_family(record_id: Column, parts: int = 1) -> Column:
    """The second-to-last ``|`` field's first ``parts`` ``_`` parts."""
    fields = F.split(record_id, r"\|")
    return F.substring_index(F.get(fields, F.size(fields) - 2), "_", parts)


def read_rule_reason(text: Column, language: Column, split: Column, duration: Column, max_s: float = 30.0) -> Column:
    """Why a text can't be read as a transcript, first reason first; null if it can."""
    bare = stripped(text)
    han = F.length(F.regexp_replace(bare, r"[^一-鿿]", ""))
    kana = F.length(F.regexp_replace(bare, r"[^぀-ヿ]", ""))
    latin = F.length(F.regexp_replace(bare, r"[^A-Za-z]", ""))
    primary = F.lower(F.element_at(F.split(language, "[-_]"), 1))
    mismatch = F.when(primary == "zh", (han == 0) & (latin > 0)).when(primary == "ja", (kana == 0) & (han == 0)).otherwise(han >= 6)
    return (
        F.when(split.isin("eval", "test", "dev"), "eval_split")
        .when(duration > max_s, "too_long")
        .when(bare.rlike(r"</?[A-Za-z][^>]*>|\{[^}]*\}|https?://"), "markup")
        .when(~bare.rlike(r"[\p{L}\p{N}]"), "no_lexical")
        .when(mismatch, "script_mismatch")
    )


def stripped(text: Column) -> Column:
    """Without format tags, empty brackets and leading ``#``, spaces collapsed."""
    x = F.regexp_replace(text, r"</?(?:b|i|u|em|strong)>", "")
    x = F.regexp_replace(x, r"\(\s*\)|\[\s*\]", " ")
    return F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+", " ")), r"^#+ *", "")


def largest_remainder(weights: DataFrame, window: int, order: list[str]) -> DataFrame:
    """(…, weight) -> (…, quota): ``window`` shared by weight, floors first, leftovers to the largest fractions.

    One row per source, so the window over all rows is bounded by the number of sources.
    """
    everything = Window.partitionBy()
    exact = F.col("weight") * F.lit(float(window)) / F.sum("weight").over(everything)
    w = weights.withColumn("exact", exact).withColumn("base", F.floor("exact").cast("long"))
    left = F.lit(window) - F.sum("base").over(everything)
    rank = F.row_number().over(everything.orderBy(F.round(F.col("exact") - F.col("base"), 9).desc(), *order))
    return w.withColumn("quota", F.col("base") + (rank <= left).cast("long")).drop("exact", "base")


def capped_subset_counts(sizes: DataFrame, limit: int, order: list[str]) -> DataFrame:
    """(…, n) -> (…, taken): at most ``limit`` rows in proportion to size; leftovers go, largest fraction and then
    largest size first, to as many as each has room for. Everything is kept if there are no more than ``limit``."""
    everything = Window.partitionBy()
    total = F.sum("n").over(everything)
    w = sizes.withColumn("exact", F.col("n") * F.lit(float(limit)) / total).withColumn("base", F.least(F.floor("exact").cast("long"), F.col("n"))).withColumn("total", total)
    by_fraction = everything.orderBy(F.round(F.col("exact") - F.floor("exact"), 9).desc(), F.col("n").desc(), *order)
    left = F.lit(limit) - F.sum("base").over(everything)
    room_before = F.coalesce(F.sum(F.col("n") - F.col("base")).over(by_fraction.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    extra = F.least(F.col("n") - F.col("base"), F.greatest(left - room_before, F.lit(0)))
    return w.withColumn("taken", F.when(F.col("total") <= limit, F.col("n")).otherwise(F.col("base") + extra)).drop("exact", "base", "total")


def top_per_key(rows: DataFrame, key: list[str], k: int, order: list[Column]) -> DataFrame:
    """The first ``k`` rows of each key; Spark prunes each partition to ``k`` a key before it shuffles."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sample_per_source(rows: DataFrame, source: str, k: int, seed: int, key: str = "id") -> DataFrame:
    """``k`` rows of each source without replacement, by hash rank."""
    return top_per_key(rows, [source], k, [hash_order(seed, "sample", F.col(key)), F.col(key)])
