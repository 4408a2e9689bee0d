"""Turns on timelines: islands, overlaps, gaps, windows and activity, as windows and bucketed interval joins.

Tables have (window_id, s, e) in whole units, e exclusive. Interval joins meet in buckets of time, so that a window
that is always on isn't paired with itself as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.alignment import batched, indel_similarity, units
from lakeloom.session import checkpointed

BUCKET = 3000
SHARD = 1 << 18


def _across(rows: DataFrame, keys: list[str], shard: Column, summary: dict[str, Column], after: dict) -> DataFrame:
    """Rows with ``_shard`` and what ``after`` says of the shards around theirs, as functions of a window over one summary
    row per shard: no window ever holds more than a shard's rows, or one row per shard."""
    at = rows.withColumn("_shard", shard)
    sums = at.groupBy(*keys, "_shard").agg(*[c.alias(n) for n, c in summary.items()])
    w = Window.partitionBy(*keys).orderBy("_shard")
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_shard").alias("_other"), *[c(w).alias(n) for n, c in after.items()])
    on = F.col("_shard") == F.col("_other")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return at.join(sums, on).drop("_other", *[f"_k{i}" for i in range(len(keys))])


def running_total(rows: DataFrame, keys: list[str], shard: Column, order: Column, value: Column, name: str) -> DataFrame:
    """Rows with the sum of ``value`` of those before them in their key's order; ``shard`` must be monotone in it."""
    got = _across(rows.withColumn("_v", value), keys, shard, {"_sum": F.sum("_v")}, {"_before": lambda w: F.sum("_sum").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    w = Window.partitionBy(*keys, "_shard").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return got.withColumn(name, F.coalesce("_before", F.lit(0)) + F.coalesce(F.sum("_v").over(w), F.lit(0))).drop("_v", "_before", "_shard")


def _unions(t: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("s", "e")
    top = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = t.withColumn("new", F.when(F.col("s") <= top, 0).otherwise(1))
    numbered = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


def islands(t: DataFrame, keys: list[str], shard: int | None = SHARD) -> DataFrame:
    """Unions of overlapping or touching intervals per key: (keys, s, e).

    Unions are made within shards of ``shard`` units; those that touch a shard's edge, at most two a shard, are joined
    in a second window per key, so a key that is always on makes no task of its size. Without shards keys are bounded.
    """
    if shard is None:
        return _unions(t.select(*keys, "s", "e"), keys)
    at = t.select(*keys, "s", "e", F.explode(F.sequence(F.floor(F.col("s") / shard), F.floor((F.col("e") - 1) / shard))).alias("_shard"))
    base = F.col("_shard") * shard
    local = _unions(at.select(*keys, "_shard", F.greatest("s", base).alias("s"), F.least("e", base + shard).alias("e")), [*keys, "_shard"])
    part = local.withColumn("_part", F.when((F.col("s") > base) & (F.col("e") < base + shard), F.col("_shard")))
    w = Window.partitionBy(*keys, "_part").orderBy("s")
    part = part.withColumn("_new", F.when(F.col("s") == F.lag("e").over(w), 0).otherwise(1))
    part = part.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return part.groupBy(*keys, "_part", "_run").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_part", "_run")


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], margin: int = 0, bucket: int = BUCKET) -> DataFrame:
    """Pairs of rows of ``a`` (columns a_…) and ``b`` (b_…) with equal keys whose intervals, ``a`` widened by
    ``margin``, share time. A pair is taken in the first bucket both touch."""
    left = a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns]).withColumn("lo", F.col("a_s") - margin).withColumn("hi", F.col("a_e") + margin)
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    left = left.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / bucket), F.floor((F.col("hi") - 1) / bucket))))
    right = right.withColumn("b_bucket", F.explode(F.sequence(F.floor(F.col("b_s") / bucket), F.floor((F.col("b_e") - 1) / bucket))))
    on = (F.col("bucket") == F.col("b_bucket")) & (F.floor(F.greatest("lo", "b_s") / bucket) == F.col("bucket")) & (F.col("lo") < F.col("b_e")) & (F.col("b_s") < F.col("hi"))
    for k in keys:
        on = on & (F.col(f"a_{k}") == F.col(f"b_{k}"))
    return left.join(right, on).drop("bucket", "b_bucket", "lo", "hi")


def plain_text(text: Column) -> Column:
    """Letters, digits and ideographs of a text in one width and lower case."""
    return batched(lambda t, _: "".join(units(t)).replace("'", ""), "string")(text, F.lit(""))


def similar_starts(ref: DataFrame, hyp: DataFrame, within: int = 1500, least_chars: int = 10, least: float = 0.7, plain: bool = False) -> DataFrame:
    """Turns (turn_id, window_id, s, text) of ``ref`` with the turn of ``hyp`` that is most similar by normalised indel
    similarity among those of the window starting less than ``within`` units away: (turn_id, window_id, match, similarity, off).

    Pairs of lengths that rule ``least`` out aren't compared. Null texts match nothing. ``plain`` texts are
    ``plain_text`` already.
    """
    said = F.col("text") if plain else plain_text(F.col("text"))
    near = F.abs(F.col("s") - F.col("t")) < within
    a = ref.select("turn_id", "window_id", "s", said.alias("x")).where(F.length("x") >= least_chars)
    b = hyp.select(F.col("turn_id").alias("match"), "window_id", F.col("s").alias("t"), said.alias("y"), F.floor(F.col("s") / (4 * within)).alias("bucket"))
    spread = F.explode(F.sequence(F.floor((F.col("s") - within) / (4 * within)), F.floor((F.col("s") + within) / (4 * within))))
    best = F.max_by(F.struct("match", "similarity", (F.col("t") - F.col("s")).alias("off")), F.struct("similarity", -F.col("t"), -F.col("match")))
    columns = ["turn_id", "window_id", "match", "similarity", "off"]
    # A turn with an equal one nearby needs no comparison: nothing is more similar. Texts meet by their hashes.
    key = ["window_id", "bucket", "h"]
    equal = a.select("turn_id", "window_id", "s", F.xxhash64("x").alias("h"), F.xxhash64(F.lit("second"), "x").alias("h2"), spread.alias("bucket")).join(b.select("match", "window_id", "t", F.xxhash64("y").alias("h"), F.xxhash64(F.lit("second"), "y").alias("h3"), "bucket"), key).where(near & (F.col("h2") == F.col("h3")))
    equal = checkpointed(equal.withColumn("similarity", F.lit(1.0)).groupBy("turn_id", "window_id").agg(best.alias("m")).select("turn_id", "window_id", "m.*"))
    rest = a.join(equal.select("turn_id"), "turn_id", "left_anti").withColumn("bucket", spread)
    shorter, longer = F.least(F.length("x"), F.length("y")), F.greatest(F.length("x"), F.length("y"))
    p = rest.join(b, ["window_id", "bucket"]).where(near & (2 * shorter >= least * (shorter + longer) - 1e-9))
    p = p.withColumn("similarity", batched(indel_similarity, "double")("x", "y")).where(F.col("similarity") >= least)
    fuzzy = p.groupBy("turn_id", "window_id").agg(best.alias("m")).select("turn_id", "window_id", "m.*")
    return equal.select(*columns).unionByName(fuzzy.select(*columns))


def covered(t: DataFrame, other: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """(id_col, covered): units of each interval of ``t`` that the union of ``other`` covers."""
    shared = F.least("a_e", "b_e") - F.greatest("a_s", "b_s")
    hits = overlapping(t.select(id_col, *keys, "s", "e"), islands(other, keys), keys)
    sums = hits.groupBy(F.col(f"a_{id_col}").alias(id_col)).agg(F.sum(shared).alias("covered"))
    return t.select(id_col).join(sums, id_col, "left").select(id_col, F.coalesce("covered", F.lit(0)).alias("covered"))


def active_spans(t: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, s, e, active): between any two neighbouring bounds how many intervals are active."""
    steps = t.select(*keys, F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("d")), F.struct(F.col("e").alias("at"), F.lit(-1).alias("d")))).alias("x"))
    sums = steps.groupBy(*keys, F.col("x.at").alias("s")).agg(F.sum("x.d").alias("d"))
    got = _across(sums, keys, F.floor(F.col("s") / SHARD), {"_sum": F.sum("d"), "_first": F.min("s")}, {"_before": lambda w: F.sum("_sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), "_next": lambda w: F.lead("_first").over(w)})
    w = Window.partitionBy(*keys, "_shard").orderBy("s")
    active = F.coalesce("_before", F.lit(0)) + F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return got.select(*keys, "s", F.coalesce(F.lead("s").over(w), "_next").alias("e"), active.alias("active")).where("e is not null")


def followed(t: DataFrame, columns: list[str]) -> DataFrame:
    """Turns with ``next``, a struct (s, e, turn_id, columns) of the turn that follows in their window by (s, e, turn_id).

    Neighbours are found within shards of time; the first and last turn of each shard meet in a second window.
    """
    row, order = F.struct("s", "e", "turn_id", *columns), ["s", "e", "turn_id"]
    w = Window.partitionBy("window_id", "_shard").orderBy(*order)
    at = t.withColumn("_shard", F.floor(F.col("s") / SHARD)).withColumn("_next", F.lead(row).over(w)).withColumn("_first", F.lag("turn_id").over(w).isNull())
    edge = F.when(F.col("_next").isNotNull() & ~F.col("_first"), F.col("_shard"))
    by = Window.partitionBy("window_id", "_edge").orderBy(*order)
    return at.withColumn("_edge", edge).withColumn("next", F.coalesce("_next", F.lead(row).over(by))).drop("_shard", "_next", "_first", "_edge")


def next_few(t: DataFrame, columns: list[str], few: int) -> DataFrame:
    """Turns with ``few``, the list of up to that many structs (s, e, turn_id, columns) that follow in their window. Each shard
    gets the first ones of the shards after it, never more than ``few`` of each."""
    row = F.struct("s", "e", "turn_id", *columns)
    w = Window.partitionBy("window_id", "_shard").orderBy("s", "e", "turn_id")
    at = t.withColumn("_shard", F.floor(F.col("s") / SHARD)).withColumn("_n", F.row_number().over(w))
    at = at.withColumn("_here", F.collect_list(row).over(w.rowsBetween(1, few)))
    heads = at.where(F.col("_n") <= few).groupBy("window_id", "_shard").agg(F.array_sort(F.collect_list(row)).alias("_head"))
    by = Window.partitionBy("window_id").orderBy("_shard").rowsBetween(1, few)
    heads = heads.select(F.col("window_id").alias("_w"), F.col("_shard").alias("_s"), F.flatten(F.collect_list("_head").over(by)).alias("_after"))
    j = at.join(heads, at["window_id"].eqNullSafe(heads["_w"]) & (at["_shard"] == heads["_s"]))
    return j.withColumn("few", F.slice(F.concat("_here", "_after"), 1, few)).drop("_shard", "_n", "_here", "_after", "_w", "_s")


def speaker_change_gaps(t: DataFrame) -> DataFrame:
    """(window_id, gap): time from each turn's end to the next start where another speaker follows; negative if they overlap."""
    n = followed(t.select("window_id", "s", "e", "turn_id", "speaker"), ["speaker"])
    return n.where("next.speaker is not null and speaker is not null and next.speaker <> speaker").select("window_id", (F.col("next.s") - F.col("e")).alias("gap"))


def self_overlaps(t: DataFrame) -> DataFrame:
    """Turns that start before an earlier turn of their own speaker has ended."""
    keys = ["window_id", "speaker"]
    got = _across(t.where("speaker is not null"), keys, F.floor(F.col("s") / SHARD), {"_top": F.max("e")}, {"_before": lambda w: F.max("_top").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    w = Window.partitionBy(*keys, "_shard").orderBy("s", "e", "turn_id").rowsBetween(Window.unboundedPreceding, -1)
    return got.withColumn("top", F.greatest(F.max("e").over(w), "_before")).where("s < top").drop("top", "_before", "_shard")


def first_speech_labels(t: DataFrame) -> DataFrame:
    """(window_id, speaker, label): speakers numbered by first speech, ties by name."""
    first = t.where("speaker is not null").groupBy("window_id", "speaker").agg(F.min("s").alias("first"))
    rank = F.dense_rank().over(Window.partitionBy("window_id").orderBy("first", "speaker"))
    return first.select("window_id", "speaker", F.concat(F.lit("S"), rank).alias("label"))


def frames(t: DataFrame, hop: int, bit: Column) -> DataFrame:
    """(window_id, frame, code): the bits of the intervals that touch each frame of ``hop`` units."""
    at = t.withColumn("bit", bit).select("window_id", "bit", F.explode(F.sequence(F.floor(F.col("s") / hop), F.ceil(F.col("e") / hop) - 1)).alias("frame"))
    return at.groupBy("window_id", "frame").agg(F.bit_or("bit").alias("code"))


def frame_runs(f: DataFrame) -> DataFrame:
    """(window_id, code, first, last): runs of neighbouring frames of one code."""
    runs = islands(f.select("window_id", "code", F.col("frame").alias("s"), (F.col("frame") + 1).alias("e")), ["window_id", "code"])
    return runs.select("window_id", "code", F.col("s").alias("first"), (F.col("e") - 1).alias("last"))


def sliding_windows(t: DataFrame, length: int, least_tail: int) -> DataFrame:
    """(window_id, w_start, turns): half-overlapping windows over each timeline, with the turns wholly inside.

    The last window ends at the end of the timeline if more than ``least_tail`` is left over.
    """
    ends = t.groupBy("window_id").agg(F.max("e").alias("total"))
    last = F.floor((F.col("total") - length) / F.lit(length // 2))
    regular = F.when(F.col("total") >= length, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array().cast("array<bigint>"))
    starts = F.transform(regular, lambda k: k * (length // 2))
    covered_to = F.when(F.col("total") >= length, last * (length // 2) + length).otherwise(F.lit(0))
    tail = F.when(F.col("total") - covered_to > least_tail, F.array(F.greatest(F.col("total") - length, F.lit(0)))).otherwise(F.array().cast("array<bigint>"))
    made = ends.select("window_id", F.explode(F.array_distinct(F.concat(starts, tail))).alias("w_start"))
    w = made.withColumn("s", F.col("w_start")).withColumn("e", F.col("w_start") + length)
    inside = overlapping(w, t.select("window_id", "turn_id", "s", "e"), ["window_id"]).where("b_s >= a_s and b_e <= a_e")
    counts = inside.groupBy(F.col("a_window_id").alias("window_id"), F.col("a_w_start").alias("w_start")).agg(F.count("*").alias("turns"))
    return made.join(counts, ["window_id", "w_start"], "left").select("window_id", "w_start", F.coalesce("turns", F.lit(0)).alias("turns"))


def solo(t: DataFrame, shortest: int) -> DataFrame:
    """(window_id, speaker, s, e): stretches in which one speaker alone is active, of at least ``shortest``."""
    own = islands(t.where("speaker is not null"), ["window_id", "speaker"])
    spans = active_spans(own, ["window_id"]).where("active = 1")
    alone = overlapping(spans.select("window_id", "s", "e"), own, ["window_id"]).select(F.col("a_window_id").alias("window_id"), F.col("b_speaker").alias("speaker"), F.col("a_s").alias("s"), F.col("a_e").alias("e"))
    return islands(alone, ["window_id", "speaker"]).where(F.col("e") - F.col("s") >= shortest)


def overlap_categories(t: DataFrame, min_chars: int = 3, backchannel: int = 2) -> DataFrame:
    """(turn_id, category) of turns of more than ``min_chars``: none, backchannel_only, light, medium or heavy."""
    scored = t.where(f"chars > {min_chars} and speaker is not null")
    named = t.where("speaker is not null")
    pairs = overlapping(scored.select("turn_id", "window_id", "speaker", "s", "e"), named.select("turn_id", "window_id", "speaker", "chars", "s", "e"), ["window_id"]).where("a_speaker <> b_speaker")
    small = pairs.groupBy(F.col("a_turn_id").alias("turn_id")).agg(F.max(F.coalesce("b_chars", F.lit(0))).alias("largest"))
    # The union of the others' shares: pieces clipped to the turn, joined per turn.
    clipped = pairs.select(F.col("a_turn_id").alias("turn_id"), F.greatest("a_s", "b_s").alias("s"), F.least("a_e", "b_e").alias("e"))
    share = islands(clipped, ["turn_id"], None).groupBy("turn_id").agg(F.sum(F.col("e") - F.col("s")).alias("covered"))
    j = scored.select("turn_id", "s", "e").join(small, "turn_id", "left").join(share, "turn_id", "left")
    part = F.col("covered") / (F.col("e") - F.col("s"))
    return j.select("turn_id", F.when(F.col("largest").isNull(), "none").when(F.col("largest") <= backchannel, "backchannel_only").when(part < 0.3, "light").when(part < 0.7, "medium").otherwise("heavy").alias("category"))
