"""Queries of speaker attribution, hotword retrieval by script, and merged batches.

The outputs scored here are the first deliveries of turns in which, by hash, some speakers are exchanged, some turns go
to a new speaker, some take the text of the next turn and some are lost; the references are the latest deliveries.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.functions import alignment as A
from lakeloom.functions import text as X
from lakeloom.functions.draws import hash_order, hash_sql, u
from lakeloom.operators import attribution as T
from lakeloom.operators.sampling import hotword_list, merged_batches
from lakeloom.operators.timeline import SHARD, overlapping
from lakeloom.plans.views import records, turns
from lakeloom.sources.tables import table


def _outputs(spark, d):
    t = turns(spark, d, first=True)
    x = u(31, "output", "turn_id")
    w = Window.partitionBy("window_id", F.floor(F.col("s") / SHARD)).orderBy("s", "e", "turn_id")
    t = t.withColumn("x", x).withColumn("next", F.lead("text").over(w))
    other = F.when(F.col("speaker") == "S1", "S2").otherwise("S1")
    speaker = F.when(F.col("x") < 0.1, other).when(F.col("x") < 0.15, F.lit("S99")).otherwise(F.col("speaker"))
    text = F.when((F.col("x") >= 0.2) & (F.col("x") < 0.25), F.coalesce("next", "text")).otherwise(F.col("text"))
    return t.where("x < 0.15 or x >= 0.2").select("turn_id", "window_id", speaker.alias("speaker"), "s", "e", text.alias("text"))


def attribution_turns(spark, d):
    """Of each turn the edits of its text alone, those charged to it under the speaker mapping, and who
    holds its text where these are more."""
    return T.attribution(turns(spark, d), _outputs(spark, d))


def attribution_kinds(spark, d):
    """Surplus edits by kind."""
    t = attribution_turns(spark, d).withColumn("over", F.greatest(F.col("speaker_edits") - F.col("text_edits"), F.lit(0)))
    return t.where("kind is not null").groupBy("kind").agg(F.count("*").alias("turns"), F.sum("over").alias("edits"))


def attribution_rates(spark, d):
    """Text, speaker-aligned and attribution error rates of turns that others overlap and of clean ones."""
    t = attribution_turns(spark, d)
    rate = lambda c: F.round(F.sum(c) / F.sum("units"), 6)
    over = F.greatest(F.col("speaker_edits") - F.col("text_edits"), F.lit(0))
    return t.groupBy("overlapped").agg(F.count("*").alias("turns"), rate(F.col("text_edits")).alias("text_rate"), rate(F.col("speaker_edits")).alias("speaker_rate"), rate(over).alias("attribution_rate"))


def wrong_speaker(spark, d):
    """The share of overlapped turns whose output is nearer to another speaker's text than to their own, by split."""
    x = T.wrong_speakers(turns(spark, d), _outputs(spark, d)).join(turns(spark, d).select("turn_id", "split"), "turn_id")
    return x.groupBy("split").agg(F.count("*").alias("turns"), F.round(F.avg((F.col("other") < F.col("own")).cast("double")), 6).alias("wrong"))


def output_categories(spark, d):
    """What the outputs of turns consist of, as if none were due: the turns of others that overlap them, and what their
    speaker said first in the window, decide."""
    t = turns(spark, d).where("speaker is not null and text is not null").select("turn_id", "window_id", "speaker", "s", "e", X.bare(F.col("text")).alias("text"))
    said = _outputs(spark, d).select("turn_id", X.bare(F.col("text")).alias("said")).where("said <> ''")
    pairs = overlapping(t.drop("text"), t, ["window_id"]).where("a_speaker <> b_speaker")
    # Turns that overlap one turn are as many as fit beside it in time.
    others = pairs.groupBy(F.col("a_turn_id").alias("turn_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b_s", "b_turn_id", "b_text"))), lambda x: x["b_text"]), "").alias("others"))
    first = t.groupBy("window_id", "speaker").agg(F.min_by("text", F.struct("s", "e", "turn_id")).alias("own"))
    x = t.select("turn_id", "window_id", "speaker").join(said, "turn_id").join(others, "turn_id", "left").join(first, ["window_id", "speaker"])

    @F.pandas_udf("string")
    def kind(said: pd.Series, others: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([T.output_category(a, b or "", c or "", "嗯呃啊哦诶uhmerä") for a, b, c in zip(said, others, own)])

    return x.groupBy(kind("said", "others", "own").alias("kind")).agg(F.count("*").alias("turns"))


def alphabetic_hotwords(spark, d):
    """Of the list drawn for each record with an alphabetic target, of up to 24 words with distractors of its
    dataset, those that pass the score, the comparison of the best with the tenth, and the verification by length."""
    r = records(spark, d).where("target is not null and hotwords is not null")
    r = r.where(X.ideograph_share(F.regexp_replace("target", r"\s", "")) < 0.3).select("id", "target", F.col("dataset_id").alias("pool"), "hotwords")
    pool = r.select("pool", F.explode("hotwords").alias("word")).distinct()
    lists = hotword_list(r.select("id", "pool", "hotwords"), pool, 33, 1.0, 0.2, 24).where("offered <> 'N/A'")
    x = lists.join(r.select("id", "target"), "id").select("id", "target", F.split("offered", ", ").alias("words"))

    @F.pandas_udf("array<string>")
    def kept(words: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([A.alphabetic_hotwords([w for w in ws if w], t) for ws, t in zip(words, text)])

    return x.select("id", F.size("words").alias("listed"), kept("words", "target").alias("kept"))


def merged_updates(spark, d):
    """Batches in hash order, windows of 16 sorted by their longest, two at a time."""
    b = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("batch_id")).agg(F.max("l_quantity").alias("longest"))
    return merged_batches(b, "batch_id", F.col("longest"), hash_order(7, "merge", "batch_id"), 2, 16)


QUERIES = {f.__name__: f for f in [attribution_turns, attribution_kinds, attribution_rates, wrong_speaker, output_categories, alphabetic_hotwords, merged_updates]}
SQL = {
    "merged_updates": f"WITH b AS (SELECT l_orderkey AS batch_id, max(l_quantity) AS longest FROM lineitem GROUP BY ALL), p AS (SELECT *, row_number() OVER (ORDER BY {hash_sql(7, 'merge', 'batch_id')}) - 1 AS p FROM b), w AS (SELECT *, p // 16 AS win, row_number() OVER (PARTITION BY p // 16 ORDER BY longest, p) - 1 AS i FROM p) SELECT batch_id, win * 8 + i // 2 AS step, i % 2 AS place FROM w",
}
