"""Problem 5: records of evaluation splits that also occur, exactly or almost, in a training split."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions.catalog import catalogue_names, spelling, split_groups
from lakeloom.functions.text import char_ngrams, jaccard
from lakeloom.llm.minhash import SHINGLE, band_keys, count_sketches, parity_sketches
from lakeloom.operators.intervals import to_units
from lakeloom.session import broadcast_within, checkpointed, stored
from lakeloom.sources.tables import table

LEAST_CHARS, PART_EDITED = 40, 10
CELL_TEXTS = 100_000
BUCKET_MS, BUCKET_STEP, LEVELS = 60_000, 64, 5
TEXT_TASKS = ["asr", "target_speaker_asr"]
_NOT_CONTENT = re.compile(r"[\W_]+")


def comparable(text: str | None) -> str:
    """Letters, digits and ideographs only, in one width and lower case; empty for null."""
    return _NOT_CONTENT.sub("", unicodedata.normalize("NFKC", text).lower()) if text else ""


def same_cut_id(cut_id: Column) -> Column:
    """The cut meant, whatever folder, case, file extension, or channel, speed and volume suffix its id is written with."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(cut_id)), r"^.*[/\\]", ""), r"\.(?:wav|flac|mp3|opus|ogg|m4a)$", "")
    return F.regexp_replace(bare, r"(?:[-_#.](?:ch|sp|vp|tempo|speed|vol|volume)[-_]?\d+(?:\.\d+)?)+$", "")


def with_roles(records: DataFrame, catalog: DataFrame) -> DataFrame:
    """(id, train, target, spans, catalogue_id, version, split) of rows of a train, validation or test split; all others
    are neither and drop out. ``target`` is null for tasks whose texts aren't compared.

    ``spans`` are the cut meant, start and end in milliseconds of each primary or mixture slot, bounds null for a whole
    cut. A ref without start, or without a positive duration, gives no span; times that aren't finite, or of 31 years or
    more, are no place in a cut, so such a slot is left out.
    """
    names = broadcast_within(catalogue_names(catalog).select("spelled", F.col("catalogue_id").alias("named")))
    splits = broadcast_within(split_groups(catalog).where("split_group in ('train', 'validation', 'test')"))
    rows = records.where("id is not null").select("id", "task", "target", "audio_slots", "dataset_id", "version", "split")
    found = rows.join(names, spelling(rows["dataset_id"]) == names["spelled"])
    found = found.join(splits, (F.col("named") == F.col("catalogue_id")) & (rows["version"] == F.col("catalogue_version")) & (rows["split"] == F.col("catalogue_split")))

    def span(s: Column) -> Column:
        start, length = to_units(s["ref"]["start"], 1000), to_units(s["ref"]["duration"], 1000)
        both = start.isNotNull() & (length > 0)
        lost = (s["ref"]["start"].isNotNull() & start.isNull()) | (s["ref"]["duration"].isNotNull() & length.isNull())
        return F.when(~lost, F.struct(same_cut_id(s["ref"]["cut_id"]).alias("cut"), F.when(both, start).alias("start"), F.when(both, start + length).alias("end")))

    slots = F.filter("audio_slots", lambda s: s["name"].isin("primary", "mixture") & s["ref"]["cut_id"].isNotNull())
    return found.select(
        rows["id"],
        (F.col("split_group") == "train").alias("train"),
        F.when(rows["task"].isin(TEXT_TASKS), rows["target"]).alias("target"),
        F.array_distinct(F.filter(F.transform(slots, span), lambda s: s.isNotNull())).alias("spans"),
        F.col("catalogue_id"),
        rows["version"],
        rows["split"],
    )


def _comparable_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for p in batches:
        texts = [comparable(t) for t in p.column("target").to_pylist()]
        norm = pa.array([t if len(t) >= LEAST_CHARS else None for t in texts], pa.string())
        at = p.schema.get_field_index("target")
        yield pa.RecordBatch.from_arrays([norm if i == at else c for i, c in enumerate(p.columns)], ["norm" if n == "target" else n for n in p.schema.names])


def prepared(records: DataFrame, catalog: DataFrame) -> DataFrame:
    """What is compared, read and normalised once and written to the shared folder: ``with_roles`` with ``norm``, the comparable text of at
    least LEAST_CHARS characters or null, in place of ``target``, and two keys of it."""
    rows = with_roles(records, catalog)
    schema = "id string, train boolean, norm string, spans array<struct<cut: string, start: long, end: long>>, catalogue_id string, version string, split string"
    made = rows.mapInArrow(_comparable_batches, schema)
    k1 = F.expr("(xxhash64(norm) & -65536L) | least(length(norm), 65535)")
    return stored(made.withColumn("k1", F.when(F.col("norm").isNotNull(), k1)).withColumn("k2", F.when(F.col("norm").isNotNull(), F.xxhash64(F.lit("second"), "norm"))))


def _bits_apart(words: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words ^ other[:, None]).sum(axis=0, dtype=np.int32)


def _alike(known: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """Pairs of one cell whose lengths and sketches don't rule a tenth of edits out; (ka, x) beside (kb, y)."""
    none = pd.DataFrame({"ka": np.zeros(0, np.int64), "kb": np.zeros(0, np.int64)})
    if known.empty or asked.empty:
        return none
    n = known["x"].str.len().to_numpy()
    by = np.argsort(n, kind="stable")
    n, x, ka = n[by], known["x"].to_numpy()[by], known["ka"].to_numpy()[by]
    y, kb = asked["y"].to_numpy(), asked["kb"].to_numpy()
    bits = max(256, 1 << int(8 * n[-1] - 1).bit_length())
    (left, left3), (right, right3) = ([parity_sketches(list(t), bits, k) for k in (2, 3)] for t in (x, y))
    half, found = len(left) // 2, []
    for j, text in enumerate(y):
        m = len(text)
        a, b = np.searchsorted(n, m - m // PART_EDITED), np.searchsorted(n, m * PART_EDITED // (PART_EDITED - 1), "right")
        edits = np.maximum(n[a:b], m) // PART_EDITED
        differ = np.zeros(b - a, np.int32)
        for word, w in zip(left[:half, a:b], right[:half, j]):
            differ += np.bitwise_count(word ^ w)
        at = np.flatnonzero(differ <= 4 * edits)
        at = at[differ[at] + _bits_apart(left[half:, at + a], right[half:, j]) <= 4 * edits[at]]
        at = at[_bits_apart(left3[:, at + a], right3[:, j]) <= 6 * edits[at]]
        found += [(ka[i], kb[j]) for i in at + a if x[i] != text]
    return pd.DataFrame(found, columns=["ka", "kb"]) if found else none


def _band_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        texts = p["norm"].tolist()
        if texts:
            keys = band_keys(texts)
            yield pd.DataFrame({"bucket": keys.ravel(), "k": np.repeat(p["k1"].to_numpy(), keys.shape[1]), "c": np.repeat(count_sketches(texts), keys.shape[1])})


def _banded(distinct: DataFrame) -> DataFrame:
    """(ka, kb) of training and evaluation texts that share a bucket and whose lengths and character counts don't rule a
    tenth of edits out; the counts are compared in the join, so that what they rule out is never shuffled."""
    bands = "bucket long, k long, c long"
    a = distinct.where("in_train").select("norm", "k1").mapInPandas(_band_rows, bands).alias("a")
    b = distinct.where("in_eval").select("norm", "k1").mapInPandas(_band_rows, bands).alias("b")
    n, m = "(a.k & 65535)", "(b.k & 65535)"
    edits = f"(greatest({n}, {m}) div {PART_EDITED})"
    apart = " + ".join(f"abs((((shiftright(a.c, {i}) & 15) - (shiftright(b.c, {i}) & 15)) & 15) - 8)" for i in range(0, 64, 4))
    long = f"greatest({n}, {m}) = 65535"
    return a.join(b, F.expr(f"a.bucket = b.bucket and ({long} or (abs({n} - {m}) <= {edits} and 128 - ({apart}) <= 2 * {edits}))")).select(F.col("a.k").alias("ka"), F.col("b.k").alias("kb")).distinct()


def _celled(distinct: DataFrame) -> DataFrame:
    """(ka, kb) of all pairs in cells of similar length whose parity sketches don't rule a tenth of edits out: nothing is
    left to chance, and the work grows with the square of the distinct texts."""
    n = F.length("norm")
    level = lambda size: F.floor(F.log(size.cast("double")) * 10).cast("int")
    known = distinct.where("in_train").select("norm", "k1", level(n).alias("level"))
    reach = F.sequence(level(n - F.floor(n / PART_EDITED)), level(F.floor(n * PART_EDITED / (PART_EDITED - 1))))
    asked = distinct.where("in_eval").select("norm", "k1", F.explode(reach).alias("level"))
    parts = lambda df, name: df.groupBy("level").agg(F.ceil(F.count("*") / CELL_TEXTS).cast("int").alias(name))
    grid = broadcast_within(parts(known, "rows").join(parts(asked, "columns"), "level"))
    own = lambda k: F.pmod(F.xxhash64("norm"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    cell = ["level", "row", "column"]
    a = known.join(grid, "level").select(F.col("k1").alias("ka"), F.col("norm").alias("x"), "level", own("rows").alias("row"), every("columns").alias("column"))
    b = asked.join(grid, "level").select(F.col("k1").alias("kb"), F.col("norm").alias("y"), "level", every("rows").alias("row"), own("columns").alias("column"))
    return a.groupBy(*cell).cogroup(b.groupBy(*cell)).applyInPandas(_alike, "ka long, kb long")


def text_classes(rows: DataFrame, exact: bool = False) -> DataFrame:
    """(ka, ka2, kb, kb2, jaccard): keys of the distinct training and evaluation texts that are the same but for a tenth
    of edits, and the exact Jaccard similarity of their shingles.

    Texts are first reduced to distinct ones, so a hot group of copies is one row. Distinct texts meet by banded minwise
    hashes of character shingles; only buckets with texts of both sides give candidates. ``exact`` compares all texts
    of similar length instead, which finds every pair at a cost that grows with the square. The edit distance decides.
    Keys only lead to texts; texts that share one are all compared.
    """
    distinct = stored(rows.where("norm is not null").groupBy("norm", "k1", "k2").agg(F.max("train").alias("in_train"), F.max(~F.col("train")).alias("in_eval")))
    near = _celled(distinct) if exact else _banded(distinct)
    left = distinct.where("in_train").select(F.col("k1").alias("ka"), F.col("k2").alias("ka2"), F.col("norm").alias("x"))
    right = distinct.where("in_eval").select(F.col("k1").alias("kb"), F.col("k2").alias("kb2"), F.col("norm").alias("y"))
    limit = f"cast(greatest(length(x), length(y)) div {PART_EDITED} as int)"
    close = near.join(left, "ka").join(right, "kb").where(f"x <> y and levenshtein(x, y, {limit}) >= 0")
    close = close.select("ka", "ka2", "kb", "kb2", jaccard(char_ngrams(F.col("x"), SHINGLE), char_ngrams(F.col("y"), SHINGLE)).alias("jaccard"))
    equal = distinct.where("in_train and in_eval").select(F.col("k1").alias("ka"), F.col("k2").alias("ka2"), F.col("k1").alias("kb"), F.col("k2").alias("kb2"), F.lit(1.0).alias("jaccard"))
    return close.unionByName(equal)


def text_pairs(rows: DataFrame, exact: bool = False) -> DataFrame:
    """(train_id, eval_id) of ``prepared`` rows whose texts are near in ``text_classes``, copies expanded."""
    keyed = rows.where("norm is not null")
    train_ids = keyed.where("train").select(F.col("id").alias("train_id"), F.col("k1").alias("ka"), F.col("k2").alias("ka2"))
    eval_ids = keyed.where("not train").select(F.col("id").alias("eval_id"), F.col("k1").alias("kb"), F.col("k2").alias("kb2"))
    return text_classes(rows, exact).join(train_ids, ["ka", "ka2"]).join(eval_ids, ["kb", "kb2"]).select("train_id", "eval_id")


def audio_matches(sides: DataFrame, carry: list[str]) -> DataFrame:
    """Pairs of training and evaluation rows (train, cut, start, end, and the columns of ``carry``, which come out as a_…
    and b_…) that refer to the same cut and, where both give a span, share at least half of the shorter one.

    Spans meet per cut in buckets of time: the longer of two in buckets of its own level, a minute and 64 times as much
    from level to level, so none lies in more than 65 and a long recording with many spans doesn't pair all of them. A
    pair is taken in the first bucket both touch. Only the levels that occur are listed, and only cuts of both sides.
    """
    cuts = sides.groupBy("cut").agg(F.max("train").alias("known"), F.max(~F.col("train")).alias("asked")).where("known and asked").select("cut")
    sides = stored(sides.join(broadcast_within(cuts, 200_000), "cut", "left_semi"))
    a_b = [[F.col(f"{s}.{c}").alias(f"{s}_{c}") for c in carry] for s in ("a", "b")]
    out = a_b[0] + a_b[1]
    level = lambda n: sum((F.when(n > BUCKET_MS * BUCKET_STEP ** (k + 1), 1).otherwise(0) for k in range(LEVELS - 1)), F.lit(0))
    spans = sides.where("start is not null").withColumn("own", level(F.col("end") - F.col("start")))
    whole = sides.where("start is null")
    levels = sorted(r[0] for r in spans.select("own").distinct().collect())

    def side(df: DataFrame, train: bool, name: str) -> DataFrame:
        return df.where("train" if train else "not train").alias(name)

    both = F.col("a.cut") == F.col("b.cut")
    one = side(whole, True, "a").join(side(sides, False, "b"), both).select(*out)
    two = side(spans, True, "a").join(side(whole, False, "b"), both).select(*out)
    found = one.unionByName(two)
    if levels:
        at = lambda k: F.transform(F.sequence(F.expr(f"start div {BUCKET_MS * BUCKET_STEP**k}"), F.expr(f"(end - 1) div {BUCKET_MS * BUCKET_STEP**k}")), lambda x: F.struct(F.lit(k).alias("level"), x.alias("bucket")))
        none = F.array().cast("array<struct<level: int, bucket: bigint>>")
        placed = spans.withColumn("p", F.explode(F.concat(*[F.when(F.col("own") <= k, at(k)).otherwise(none) for k in levels])))
        placed = placed.select("*", F.col("p.level").alias("level"), F.col("p.bucket").alias("bucket"))
        shared = F.least("a.end", "b.end") - F.greatest("a.start", "b.start")
        shorter = F.least(F.col("a.end") - F.col("a.start"), F.col("b.end") - F.col("b.start"))
        width = F.element_at(F.array(*[F.lit(BUCKET_MS * BUCKET_STEP**k) for k in range(LEVELS)]), F.col("a.level") + 1)
        meet = both & (F.col("a.level") == F.col("b.level")) & (F.col("a.bucket") == F.col("b.bucket")) & (F.greatest("a.own", "b.own") == F.col("a.level"))
        three = (
            side(placed, True, "a")
            .join(side(placed, False, "b"), meet)
            .where((F.col("a.bucket") == F.floor(F.greatest("a.start", "b.start") / width)) & (shared > 0) & (2 * shared >= shorter))
            .select(*out)
        )
        found = found.unionByName(three)
    return found


def audio_sides(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select("train", *keep, F.explode("spans").alias("s")).select("train", *keep, "s.cut", "s.start", "s.end")


def audio_pairs(rows: DataFrame) -> DataFrame:
    """(train_id, eval_id) of ``prepared`` rows whose slots match in ``audio_matches``."""
    return audio_matches(audio_sides(rows, "id"), ["id"]).select(F.col("a_id").alias("train_id"), F.col("b_id").alias("eval_id"))


def cross_split_pairs(records: DataFrame, catalog: DataFrame, exact: bool = False) -> DataFrame:
    """Distinct (train_id, eval_id, by_audio, by_text) of all overlaps between training and evaluation records.

    Redelivered rows count once. Rows with a null id, dataset, version or split, or of a split without group, have none.
    Whether texts are found by banded minwise hashes or, with ``exact``, by comparing all of similar length.
    """
    rows = prepared(records, catalog)
    audio = audio_pairs(rows).withColumn("by_audio", F.lit(True)).withColumn("by_text", F.lit(False))
    text = text_pairs(rows, exact).withColumn("by_audio", F.lit(False)).withColumn("by_text", F.lit(True))
    return audio.unionByName(text).where("train_id <> eval_id").groupBy("train_id", "eval_id").agg(F.max("by_audio").alias("by_audio"), F.max("by_text").alias("by_text"))


def overlap_report(records: DataFrame, catalog: DataFrame, reports: DataFrame) -> DataFrame:
    """(dataset_id, version, split, source_data, eval_records, train_records, text_pairs, audio_pairs, least_jaccard) per
    evaluation split and source data of the training records.

    The source is that of the latest passed report of the record's dataset version with source data, ``unknown`` where
    there is none. Pairs are counted by classes of equal texts and equal spans, as products of their sizes, and records
    by joining each class once, so copies are never expanded into pairs.
    """
    names = broadcast_within(catalogue_names(catalog).select("spelled", "catalogue_id"))
    passed = reports.where("passed and inputs.source_data is not null")
    source = broadcast_within(
        passed.join(names, spelling(passed["dataset_id"]) == names["spelled"])
        .groupBy("catalogue_id", "version")
        .agg(F.max(F.struct("created_at", F.col("inputs.source_data").alias("source_data"))).alias("latest"))
        .select("catalogue_id", "version", "latest.source_data")
    )
    rows = prepared(records, catalog).dropDuplicates(["id"])
    rows = checkpointed(rows.join(source, ["catalogue_id", "version"], "left").withColumn("source_data", F.coalesce("source_data", F.lit("unknown"))))
    per = ["catalogue_id", "version", "split"]
    text, span = rows.where("norm is not null"), audio_sides(rows, "id", "source_data", *per).distinct()
    text_key, cut_key = ["k1", "k2"], ["cut", "start", "end"]
    near = checkpointed(text_classes(rows).select(F.struct(F.col("ka").alias("k1"), F.col("ka2").alias("k2")).alias("a"), F.struct(F.col("kb").alias("k1"), F.col("kb2").alias("k2")).alias("b"), "jaccard"))
    keyed = span.withColumn("key", F.struct(*cut_key))
    same = checkpointed(audio_matches(keyed.select("train", *cut_key, "key").distinct(), ["key"]).select(F.col("a_key").alias("a"), F.col("b_key").alias("b"), F.lit(None).cast("double").alias("jaccard")))

    def counted(classes: DataFrame, members: DataFrame, pairs: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        train, held = members.where("train"), members.where("not train")
        by_source = train.groupBy(F.col("key").alias("a"), "source_data").agg(F.count("*").alias("n"))
        by_split = held.groupBy(F.col("key").alias("b"), *per).agg(F.count("*").alias("m"))
        met = classes.join(by_source, "a").join(by_split, "b")
        sums = met.groupBy(*per, "source_data").agg(F.sum(F.col("n") * F.col("m")).alias(pairs), F.min("jaccard").alias("least_jaccard"))
        evals = met.select(F.col("b").alias("key"), "source_data").distinct().join(held.select("id", "key", *per), "key").select("id", *per, "source_data")
        trains = met.select(F.col("a").alias("key"), *per).distinct().join(train.select("id", "key", "source_data"), "key").select("id", *per, "source_data")
        return sums, evals, trains

    t, te, tt = counted(near, text.withColumn("key", F.struct(*text_key)), "text_pairs")
    s, se, st = counted(same, keyed, "audio_pairs")
    group = [*per, "source_data"]
    evals = te.unionByName(se).distinct().groupBy(*group).agg(F.count("*").alias("eval_records"))
    trains = tt.unionByName(st).distinct().groupBy(*group).agg(F.count("*").alias("train_records"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return evals.join(trains, group).join(t, group, "left").join(s.drop("least_jaccard"), group, "left").select(F.col("catalogue_id").alias("dataset_id"), "version", "split", "source_data", "eval_records", "train_records", zero("text_pairs"), zero("audio_pairs"), F.round("least_jaccard", 6).alias("least_jaccard"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_a, id_b), the smaller id first, of each overlap."""
    pairs = cross_split_pairs(table(spark, sf_dir, "audio_records"), table(spark, sf_dir, "dataset_catalog"))
    return pairs.select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b")).distinct()


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per evaluation dataset, version and split, and per source data of the training records."""
    return overlap_report(*(table(spark, sf_dir, t) for t in ("audio_records", "dataset_catalog", "prep_reports")))


def p5_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_a, id_b) of the overlaps by audio."""
    pairs = audio_pairs(prepared(table(spark, sf_dir, "audio_records"), table(spark, sf_dir, "dataset_catalog"))).where("train_id <> eval_id")
    return pairs.select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b")).distinct()


def p5_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pairs are found among: per side the records, the distinct cuts, and the texts that can be compared."""
    rows = prepared(table(spark, sf_dir, "audio_records"), table(spark, sf_dir, "dataset_catalog"))
    cuts = rows.select("train", F.explode("spans.cut").alias("cut")).groupBy("train").agg(F.count_distinct("cut").alias("cuts"))
    return rows.groupBy("train").agg(F.count_distinct("id").alias("records"), F.count_distinct(F.when(F.col("norm").isNotNull(), F.col("id"))).alias("texts")).join(cuts, "train")


QUERIES = {"p5_found": p5_found, "p5_report": p5_report, "p5_audio": p5_audio, "p5_kept": p5_kept}

_ROLES = r"""
WITH names AS (SELECT DISTINCT dataset_id, regexp_replace(regexp_replace(lower(trim(name)), '\s*@.*$', ''), '[-\s_]+', '_', 'g') AS name FROM (SELECT dataset_id, dataset_id AS name FROM dataset_catalog UNION ALL SELECT dataset_id, unnest(aliases) FROM dataset_catalog)),
splits AS (SELECT dataset_id, version, unnest(map_entries(splits)) AS e FROM dataset_catalog),
roles AS (SELECT r.id, r.task, r.target, r.audio_slots, s.e.value.split_group = 'train' AS train FROM audio_records r JOIN names n ON n.name = regexp_replace(regexp_replace(lower(trim(r.dataset_id)), '\s*@.*$', ''), '[-\s_]+', '_', 'g') JOIN splits s ON s.dataset_id = n.dataset_id AND s.version = r.version AND s.e.key = r.split WHERE s.e.value.split_group IN ('train', 'validation', 'test')),
slots AS (SELECT id, train, unnest(audio_slots) AS s FROM roles),
cuts AS (SELECT DISTINCT id, train, regexp_replace(regexp_replace(regexp_replace(lower(trim(s.ref.cut_id)), '^.*[/\\]', ''), '\.(?:wav|flac|mp3|opus|ogg|m4a)$', ''), '(?:[-_#.](?:ch|sp|vp|tempo|speed|vol|volume)[-_]?\d+(?:\.\d+)?)+$', '') AS cut,
  CASE WHEN s.ref.duration > 0 THEN CAST(round(s.ref.start * 1000) AS BIGINT) END AS a, CASE WHEN s.ref.duration > 0 AND s.ref.start IS NOT NULL THEN CAST(round(s.ref.start * 1000) AS BIGINT) + CAST(round(s.ref.duration * 1000) AS BIGINT) END AS b
  FROM slots WHERE s.name IN ('primary', 'mixture') AND s.ref.cut_id IS NOT NULL)
"""
SQL = {
    "p5_audio": f"{_ROLES} SELECT DISTINCT least(x.id, y.id) AS id_a, greatest(x.id, y.id) AS id_b FROM cuts x JOIN cuts y ON x.cut = y.cut AND x.train AND NOT y.train AND x.id <> y.id WHERE x.a IS NULL OR y.a IS NULL OR (least(x.b, y.b) > greatest(x.a, y.a) AND 2 * (least(x.b, y.b) - greatest(x.a, y.a)) >= least(x.b - x.a, y.b - y.a))",
    "p5_kept": f"{_ROLES} SELECT r.train, count(DISTINCT r.id) AS records, count(DISTINCT CASE WHEN r.task IN ('asr', 'target_speaker_asr') AND length(regexp_replace(lower(r.target), '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 40 THEN r.id END) AS texts, any_value(c.cuts) AS cuts FROM roles r JOIN (SELECT train, count(DISTINCT cut) AS cuts FROM cuts GROUP BY train) c ON c.train = r.train GROUP BY r.train",
}
