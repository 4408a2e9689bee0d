"""Queries of the text measures. Those over alignments have no SQL; tests hold them against brute force."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.functions import alignment as A
from lakeloom.functions import text as X
from lakeloom.operators.timeline import followed
from lakeloom.plans.views import RECORDS_SQL, TURNS_SQL, records, turns
from lakeloom.sources.tables import table

STOP = ["the", "a", "of", "we", "i", "to", "in"]


def _pairs(spark, d):
    """Each turn beside the next of its window."""
    t = followed(turns(spark, d).where(F.col("text").isNotNull()).select("turn_id", "window_id", "s", "e", "text"), ["text"])
    return t.where("next is not null").select("turn_id", "text", F.col("next.text").alias("other"))


def cer_pairs(spark, d):
    """X13; without SQL, as DuckDB's edit distance counts bytes."""
    return _pairs(spark, d).select("turn_id", F.round(X.char_error_rate(F.lower("other"), F.lower("text")), 6).alias("cer"))


def bigram_jaccard(spark, d):
    """X18, X19."""
    p = _pairs(spark, d).select("turn_id", X.char_ngrams(F.lower("text"), 2).alias("a"), X.char_ngrams(F.lower("other"), 2).alias("b"))
    return p.select("turn_id", F.round(X.jaccard(F.col("a"), F.col("b")), 6).alias("j"))


def word_overlap(spark, d):
    """X6, X24, X40, X5."""
    p = _pairs(spark, d)
    return p.select("turn_id", F.round(X.content_overlap(F.col("text"), F.col("other"), STOP), 6).alias("overlap"), X.contains_tokens(F.lower("other"), F.lit("the")).alias("has_the"), X.bare(F.col("text")).alias("bare"), X.presence(X.units(F.regexp_replace("other", "^[a-m].*", "")), X.units(F.regexp_replace("text", "^[a-m].*", ""))).alias("presence"))


def output_parsing(spark, d):
    """Model outputs made of part names, some without tag."""
    tagged = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(F.concat(F.lit("language English<asr_text>"), F.col("p_name")))
    answer = F.concat(F.lit("Language: en\nHotwords: "), F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("\nTranscription: "), F.col("p_name"))).otherwise(""))
    return table(spark, d, "part").select("p_partkey", X.transcript(tagged).alias("said"), X.well_formed(tagged).alias("formed"), X.structured(answer, "Transcription").alias("transcription"), X.structured(answer, "Hotwords").alias("hotwords"), F.round(X.format_reward(answer), 6).alias("reward"))


def hotword_scores(spark, d):
    """Outputs of all records with a target, in which the first offered word is missing and the
    last one is added. Records without hotwords have no reward; some outputs have no offered word, some no spoken one."""
    r = records(spark, d).where("target is not null")
    prompt = F.concat(F.lit("Transcribe.\nHotwords: "), F.coalesce(F.array_join("hotwords", ", "), F.lit("N/A")))
    offered = F.coalesce(F.array_distinct("hotwords"), X.empty())
    x = r.select("id", "target", offered.alias("words"), X.prompt_hotwords(prompt).alias("prompted"))
    first, last = F.coalesce(F.get("words", F.lit(0)), F.lit("")), F.coalesce(F.get("words", F.size("words") - 1), F.lit(""))
    cut = F.when(first == "", F.col("target")).otherwise(F.replace("target", first, F.lit("")))
    x = x.withColumn("said", F.concat(cut, F.lit(" "), last)).withColumn("wanted", F.filter("words", lambda w: F.contains(F.col("target"), w)))
    return x.select("id", F.size("prompted").alias("prompted"), F.round(X.set_f1(F.col("words"), F.col("wanted")), 6).alias("f1"), F.round(X.hotword_reward(F.col("said"), F.col("target"), F.col("words")), 6).alias("reward"), F.round(X.candidate_accuracy(F.col("said"), F.col("target"), F.col("words")), 6).alias("candidates"))


def hotword_languages(spark, d):
    """Scripts of hotwords and ideograph shares of targets."""
    w = records(spark, d).select(F.explode("hotwords").alias("w"))
    return w.groupBy(X.script_language(F.col("w")).alias("script"), (X.ideograph_share(F.col("w")) >= 0.3).alias("dominant")).agg(F.count("*").alias("n"))


def hotword_retrieval(spark, d):
    """For each target that is Chinese by script, whatever language it is tagged with, the five best words
    of its dataset's pool with a score over 1; alphabetic ones are in ``alphabetic_hotwords``.

    A word that isn't in the text scores 0.8 at most, so only contained words can pass: words and texts meet by the
    word's first three characters (all of a shorter one), never through a cross join. Without a pronunciation table the
    pronunciation term is 0.
    """
    r = records(spark, d).where("target is not null").where(X.ideograph_share(F.regexp_replace("target", r"\s", "")) >= 0.3).select("id", "dataset_id", "hotwords", "target", F.size(X.char_ngrams(F.col("target"), 2)).alias("bigrams"))
    pool = r.select("dataset_id", F.explode("hotwords").alias("word")).distinct().where("length(word) >= 2").withColumn("gram", F.substring("word", 1, 3))
    grams = F.array_union(X.char_ngrams(F.col("target"), 2), X.char_ngrams(F.col("target"), 3))
    texts = r.select("dataset_id", "id", F.explode(grams).alias("gram"))
    hits = texts.join(pool, ["dataset_id", "gram"]).select("id", "word").join(r.select("id", "target", "bigrams"), "id").where(F.contains("target", F.col("word")))
    # A contained word has all its characters and bigrams in the text, so its Jaccard similarity is a quotient of sizes.
    score = 2.0 * X.substring_bonus(F.col("word"), F.col("target")) + 0.5 + 0.3 * F.size(X.char_ngrams(F.col("word"), 2)) / F.col("bigrams")
    w = Window.partitionBy("id").orderBy(F.desc("score"), "word")
    return hits.withColumn("score", F.round(score, 6)).where("score > 1.0").withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("id", "rank", "word", "score")


def turn_parsing(spark, d):
    """Lines of all attributed targets, in any of five notations, retimed, and why a target isn't valid."""
    r = records(spark, d).where("task = 'speaker_attributed_asr' and target is not null").select("id", X.any_turn_lines(F.col("target")).alias("t"), F.get("audio_slots", F.lit(0))["ref"]["duration"].alias("total"))
    good = F.filter("t", lambda t: t.isNotNull())
    return r.select("id", F.size("t").alias("lines"), F.size(good).alias("parsed"), F.round(F.array_max(F.transform(X.retimed(good, 0.5), lambda t: t["end"])), 3).alias("half_end"), X.turn_errors(F.col("t"), F.col("total")).alias("error"))


def target_views(spark, d):
    """The lines of all attributed targets, in any of five notations, relabelled with speaker 2 as the wanted one."""
    r = records(spark, d).where("task = 'speaker_attributed_asr' and target is not null").select("id", F.filter(X.any_turn_lines(F.col("target")), lambda t: t.isNotNull()).alias("t"))
    wanted = F.array(F.lit(2))
    return r.select("id", X.target_view(F.col("t"), wanted).alias("view"), X.target_view(F.col("t"), wanted, only=True).alias("only"))


def sizes(spark, d):
    """Sizes parsed and written, paths moved."""
    n = F.when(F.col("p_size") % 4 == 0, F.concat(F.col("p_size"), F.lit("G"))).when(F.col("p_size") % 4 == 1, F.concat(F.col("p_size") / 2, F.lit(" MB"))).when(F.col("p_size") % 4 == 2, F.col("p_size").cast("string")).otherwise("much")
    path = F.concat(F.when(F.col("p_size") % 2 == 0, "/data/a/").otherwise("/data/"), F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", X.parse_size(n).alias("bytes"), X.replace_prefix(path, {"/data/": "/new/", "/data/a/": "/fast/"}).alias("path"))


def backchannel_ladder(spark, d):
    """The first category that fits a turn."""
    t = turns(spark, d).where("text is not null")
    kind = F.when(F.trim("text") == "", "empty").when(F.col("text").rlike(r"^[\[\(<{（【＜*]"), "sound").when(F.col("text").rlike(r"^[嗯呃啊哦诶]+[.，]*$"), "filler").when(F.length("text") <= 4, "backchannel").otherwise("speech")
    return t.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def loop_flags(spark, d):
    """texts in which a unit repeats."""
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", F.col("text").rlike(X.LOOP).alias("loop"), F.col("text").rlike(X.DEGENERATE).alias("degenerate"))


def unit_accuracy(spark, d):
    """Accuracy of the first delivery of a turn against the latest."""
    t = table(spark, d, "turns").where("text is not null").groupBy("turn_id").agg(F.min_by("text", "ingested_at").alias("first"), F.max_by("text", "ingested_at").alias("last"), F.count("*").alias("n")).where("n > 1")
    return t.select("turn_id", F.round(A.batched(A.accuracy, "double")("last", "first"), 6).alias("accuracy"))


def fuzzy_scores(spark, d):
    """Subsequence, partial and semi-global similarity of neighbouring turns."""
    p = _pairs(spark, d)
    return p.select("turn_id", F.round(A.batched(lambda a, b: A.lcs_ratio(a.split(), b.split()), "double")("text", "other"), 6).alias("lcs"), F.round(A.batched(A.partial_ratio, "double")("text", "other"), 6).alias("partial"), A.batched(lambda a, b: A.semi_global(a.split(), b.split()), "long")("text", "other").alias("semi_global"))


def speaker_errors(spark, d):
    """Untimed targets against their segments, speakers mapped for least edits."""
    seg = "array<struct<speaker: string, start: double, duration: double, text: string>>"
    r = records(spark, d).where("target is not null and metadata like '%\"segments\"%'").select("id", "target", F.transform(F.array_sort(F.transform(F.from_json("metadata", f"segments {seg}")["segments"], lambda s: F.struct(s["start"].alias("k"), s["speaker"].alias("speaker"), s["text"].alias("text")))), lambda s: F.concat_ws("\t", s["speaker"], s["text"])).alias("segments"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for rid, target, segments in zip(p["id"], p["target"], p["segments"]):
                ref: dict[str, list] = {}
                for s in segments:
                    who, _, said = s.partition("\t")
                    ref.setdefault(who, []).extend(A.units(said))
                hyp: dict[str, list] = {}
                for line in target.split("\n"):
                    who, _, said = line.partition("] ")
                    hyp.setdefault(who.strip("[ "), []).extend(A.units(said))
                mapped, edits = A.speaker_mapping(ref, hyp)
                out.append((rid, sum(map(len, ref.values())), edits, len(mapped)))
            if out:
                yield pd.DataFrame(out, columns=["id", "units", "edits", "mapped"])

    return r.mapInPandas(score, "id string, units int, edits int, mapped int")


def correction_outcomes(spark, d):
    """What the latest delivery of a turn has where the first has its third unit, read off their alignment:
    ``gold`` that unit, ``alt`` the confusable one, here the first's fourth unit where it differs, or ``other``; and the
    mean score of +1, -1 and 0."""
    t = table(spark, d, "turns").where("text is not null").groupBy("turn_id").agg(F.min_by("text", "ingested_at").alias("first"), F.max_by("text", "ingested_at").alias("last"), F.count("*").alias("n")).where("n > 1")

    def outcome(a: str, b: str) -> str:
        x = A.units(a)
        alt = x[3:4] if x[2:3] != x[3:4] else []
        return A.target_outcome(x, A.units(b), 2, 3, alt) if len(x) > 2 else "short"

    score = F.when(F.col("outcome") == "gold", 1).when(F.col("outcome") == "alt", -1).when(F.col("outcome") == "other", 0)
    return t.select(A.batched(outcome, "string")("first", "last").alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"), F.avg(score).alias("score"))


QUERIES = {f.__name__: f for f in [cer_pairs, bigram_jaccard, word_overlap, output_parsing, hotword_scores, hotword_languages, hotword_retrieval, turn_parsing, target_views, sizes, backchannel_ladder, loop_flags, unit_accuracy, fuzzy_scores, speaker_errors, correction_outcomes]}

_PAIRS = f"{TURNS_SQL}, l AS (SELECT turn_id, text, lead(text) OVER (PARTITION BY window_id ORDER BY s, e, turn_id) AS other FROM t WHERE text IS NOT NULL), p AS (SELECT * FROM l WHERE other IS NOT NULL)"
_UNITS = r"regexp_extract_all(lower({x}), '[\x{{3040}}-\x{{30ff}}\x{{3400}}-\x{{9fff}}\x{{ac00}}-\x{{d7af}}]|[a-z0-9\x{{00df}}-\x{{024f}}]+(?:''[a-z0-9\x{{00df}}-\x{{024f}}]+)*')"
_GRAMS = "list_distinct(list_transform(range(1, length({x})), lambda i: substr({x}, i, 2)))"
_JACCARD = "CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) ELSE 0.0 END"
def _notation(field: int, other: str = "NULL") -> str:
    """A header's field (0 speaker, 1 start, 2 end, 3 unit, 4 text) by the first notation that matches."""
    when = " ".join(f"WHEN regexp_matches(l, '{p}') THEN " + (f"regexp_extract(l, '{p}', {g[field]})" if g[field] else "''") for p, g in X.NOTATIONS)
    return f"CASE {when} ELSE {other} END"


CLOCK_SQL = "list_reduce(list_prepend(0::DOUBLE, list_transform(string_split(replace({x}, ',', '.'), ':'), lambda p: TRY_CAST(p AS DOUBLE))), lambda a, b: a * 60 + b)"
HEADERS_SQL = f"""r AS (SELECT id, target, metadata, dataset_id, language, audio_slots[1].ref.duration AS total FROM records WHERE task = 'speaker_attributed_asr' AND target IS NOT NULL),
raw AS (SELECT id, total, unnest(regexp_split_to_array(target, '\\r\\n|[\\r\\n]')) AS l, generate_subscripts(regexp_split_to_array(target, '\\r\\n|[\\r\\n]'), 1) AS pos FROM r),
heads AS (SELECT id, total, pos, l, {_notation(0)} AS who, {_notation(1)} AS t0, {_notation(2)} AS t1, CASE WHEN {_notation(3)} = 'ms' THEN 1000.0 ELSE 1.0 END AS scale, {_notation(4)} AS said FROM raw)"""
_LINES = f"""{HEADERS_SQL}, numbered AS (SELECT *, TRY_CAST(regexp_extract(trim(who), '{X.NUMBERED}', 1) AS INTEGER) AS spk FROM heads WHERE trim(l) <> ''),
lines AS (SELECT id, total, pos, l, spk IS NOT NULL AS ok, spk, CASE WHEN spk IS NOT NULL THEN {CLOCK_SQL.format(x='t0')} / scale END AS s, CASE WHEN spk IS NOT NULL AND t1 <> '' THEN {CLOCK_SQL.format(x='t1')} / scale END AS e, said FROM numbered)"""
# A unit of w characters repeats k + 1 times where k * w characters in a row equal the one w places on.
_RUN = "contains(array_to_string(list_transform(range(1, n - {w} + 1), lambda i: CASE WHEN c[i] = c[i + {w}]{line} THEN '1' ELSE '0' END), ''), repeat('1', {size}))"
_LOOP = "(" + " OR ".join(_RUN.format(w=w, size=7 * w, line=" AND c[i] NOT IN (chr(10), chr(13), chr(133), chr(8232), chr(8233))") for w in range(1, 5)) + ")"
_DEGENERATE = "(" + " OR ".join(_RUN.format(w=w, size=29 if w == 1 else 19 * w, line="") for w in range(1, 11)) + ")"
SQL = {
    "loop_flags": f"WITH d AS (SELECT doc_id, string_split(text, '') AS c, len(string_split(text, '')) AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, {_LOOP} AS loop, {_DEGENERATE} AS degenerate FROM d",
    "bigram_jaccard": f"WITH {_PAIRS}, g AS (SELECT turn_id, {_GRAMS.format(x='lower(text)')} AS a, {_GRAMS.format(x='lower(other)')} AS b FROM p) SELECT turn_id, round({_JACCARD.format(a='a', b='b')}, 6) AS j FROM g",
    "word_overlap": rf"""WITH {_PAIRS}, x AS (SELECT *, list_filter(list_distinct(regexp_split_to_array(lower(text), '\s+')), lambda w: w NOT IN ('the', 'a', 'of', 'we', 'i', 'to', 'in')) AS w, regexp_split_to_array(lower(other), '\s+') AS o, regexp_replace(text, '^[a-m].*', '') AS h, regexp_replace(other, '^[a-m].*', '') AS f FROM p)
SELECT turn_id, CASE WHEN len(w) > 0 THEN round(len(list_intersect(w, o)) / len(w), 6) ELSE 0.0 END AS overlap, contains(' ' || lower(other) || ' ', ' the ') AS has_the, lower(regexp_replace(text, '[\p{{P}}\p{{Z}}\p{{S}}]', '', 'g')) AS bare, CASE WHEN len({_UNITS.format(x='h')}) = 0 THEN CASE WHEN len({_UNITS.format(x='f')}) = 0 THEN 1 ELSE -1 END WHEN len({_UNITS.format(x='f')}) = 0 THEN -1 ELSE 0 END AS presence FROM x""",
    "output_parsing": "SELECT p_partkey, p_name AS said, p_size % 3 <> 0 AS formed, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END AS transcription, p_brand AS hotwords, round(CASE WHEN p_size % 2 = 0 THEN 3 ELSE 2 END / 3, 6) AS reward FROM part",
    "hotword_scores": f"""WITH {RECORDS_SQL}, x AS (SELECT id, target, coalesce(list_filter(list_transform(range(1, len(hotwords) + 1), lambda i: CASE WHEN list_position(hotwords, hotwords[i]) = i THEN hotwords[i] END), lambda w: w IS NOT NULL), []::VARCHAR[]) AS words, coalesce(len(list_filter(list_transform(hotwords, lambda w: trim(w)), lambda w: w <> '' AND w <> 'N/A')), 0) AS prompted FROM records WHERE target IS NOT NULL),
y AS (SELECT *, CASE WHEN coalesce(words[1], '') = '' THEN target ELSE replace(target, words[1], '') END || ' ' || coalesce(words[-1], '') AS said, list_filter(words, lambda w: contains(target, w)) AS wanted FROM x),
z AS (SELECT *, ' ' || array_to_string({_UNITS.format(x='said')}, ' ') || ' ' AS h, ' ' || array_to_string({_UNITS.format(x='target')}, ' ') || ' ' AS r, list_filter(list_transform(words, lambda w: ' ' || array_to_string({_UNITS.format(x='w')}, ' ') || ' '), lambda w: w <> '  ') AS listed FROM y),
n AS (SELECT *, len(list_filter(listed, lambda w: contains(r, w))) AS spoken, len(list_filter(listed, lambda w: contains(r, w) AND contains(h, w))) AS hits, len(list_filter(listed, lambda w: NOT contains(r, w) AND contains(h, w))) AS wrong FROM z)
SELECT id, prompted, CASE WHEN len(words) + len(wanted) = 0 THEN 1.0 ELSE round(2.0 * len(wanted) / (len(words) + len(wanted)), 6) END AS f1,
 CASE WHEN len(words) > 0 THEN round(CASE WHEN spoken > 0 THEN hits / spoken ELSE 1.0 END - least(1.0, wrong / greatest(1, spoken)), 6) END AS reward,
 CASE WHEN len(words) > 0 THEN round(len(list_filter(words, lambda w: contains(target, w) = contains(said, w))) / len(words), 6) ELSE 1.0 END AS candidates FROM n""",
    "hotword_languages": rf"WITH {RECORDS_SQL}, w AS (SELECT unnest(hotwords) AS w FROM records) SELECT CASE WHEN regexp_matches(w, '[\x{{3040}}-\x{{30ff}}]') THEN 'ja' WHEN regexp_matches(w, '[\x{{ac00}}-\x{{d7af}}]') THEN 'ko' WHEN regexp_matches(w, '[\x{{4e00}}-\x{{9fff}}]') THEN 'zh' WHEN regexp_matches(w, '[A-Za-z]') THEN 'en' ELSE 'other' END AS script, CASE WHEN length(w) > 0 THEN length(regexp_replace(w, '[^\x{{4e00}}-\x{{9fff}}]', '', 'g')) / length(w) ELSE 0 END >= 0.3 AS dominant, count(*) AS n FROM w WHERE w IS NOT NULL GROUP BY ALL",
    "hotword_retrieval": f"""WITH {RECORDS_SQL}, r AS (SELECT * FROM records WHERE target IS NOT NULL AND length(regexp_replace(target, '\\s', '', 'g')) > 0 AND length(regexp_replace(target, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) / length(regexp_replace(target, '\\s', '', 'g')) >= 0.3), pool AS (SELECT * FROM (SELECT DISTINCT dataset_id, unnest(hotwords) AS word FROM r) WHERE length(word) >= 2),
tg AS (SELECT id, dataset_id, target, {_GRAMS.format(x='target')} AS g FROM r), wg AS (SELECT *, {_GRAMS.format(x='word')} AS h FROM pool),
c AS (SELECT id, word, round(2.0 * contains(target, word)::INT + 0.5 * len(list_filter(string_split(word, ''), lambda ch: ch <> '' AND contains(target, ch))) / len(string_split(word, '')) + 0.3 * len(list_intersect(g, h)) / len(list_distinct(list_concat(g, h))), 6) AS score FROM tg JOIN wg USING (dataset_id) WHERE len(list_intersect(g, h)) > 0)
SELECT id, rank, word, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, word) AS rank FROM c WHERE score > 1.0) WHERE rank <= 5""",
    "turn_parsing": f"""WITH {RECORDS_SQL}, {_LINES}, w AS (SELECT *, lag(s) OVER (PARTITION BY id ORDER BY pos) AS ps, coalesce(max(spk) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM lines)
SELECT id, count(*) AS lines, sum(ok::INT) AS parsed, round(max(CASE WHEN ok THEN e * 0.5 END), 3) AS half_end, CASE WHEN NOT bool_and(ok) THEN 'malformed' WHEN bool_or(coalesce(s >= e, false) OR coalesce(e > total, false)) THEN 'bounds' WHEN bool_or(s < ps) THEN 'order' WHEN bool_or(spk > seen + 1) THEN 'numbering' END AS error FROM w GROUP BY id""",
    "target_views": f"""WITH {RECORDS_SQL}, {_LINES}, k AS (SELECT * FROM lines WHERE ok), f AS (SELECT id, spk, row_number() OVER (PARTITION BY id ORDER BY min(pos)) AS n FROM k WHERE spk <> 2 GROUP BY id, spk),
v AS (SELECT k.id, k.pos, k.spk, '[' || CASE WHEN k.spk = 2 THEN 'T1' ELSE 'S' || f.n END || '] ' || said AS line FROM k LEFT JOIN f ON f.id = k.id AND f.spk = k.spk)
SELECT r.id, coalesce(string_agg(line, chr(10) ORDER BY pos), '') AS view, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE spk = 2), '') AS only FROM r LEFT JOIN v ON v.id = r.id GROUP BY r.id""",
    "sizes": "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_size * 1073741824::BIGINT WHEN p_size % 4 = 1 THEN CAST(p_size / 2 * 1048576 AS BIGINT) WHEN p_size % 4 = 2 THEN p_size END AS bytes, CASE WHEN p_size % 2 = 0 THEN '/fast/' ELSE '/new/' END || p_brand AS path FROM part",
    "backchannel_ladder": rf"WITH {TURNS_SQL} SELECT CASE WHEN trim(text) = '' THEN 'empty' WHEN regexp_matches(text, '^[\[\(<{{（【＜*]') THEN 'sound' WHEN regexp_full_match(text, '[嗯呃啊哦诶]+[.，]*') THEN 'filler' WHEN length(text) <= 4 THEN 'backchannel' ELSE 'speech' END AS kind, count(*) AS n FROM t WHERE text IS NOT NULL GROUP BY ALL",
}
