"""Text measures as columns. What built-in functions can say stays in the JVM; alignments are Arrow batches (alignment.py)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeloom.operators.aggregates import let

# Patterns of repetition loops and of turn lines.
LOOP = r"(.{1,4}?)\1{7,}"
DEGENERATE = r"(?s)(.)\1{29,}|(.{2,10}?)\2{19,}"
TURN = r"^\[S(\d+)\]\[(\d+(?:\.\d+)?)-(\d+(?:\.\d+)?)\]\s?(.*)$"


def empty() -> Column:
    return F.array().cast("array<string>")


def transcript(output: Column) -> Column:
    """What follows the first ``<asr_text>`` tag; the whole text without one."""
    at = F.instr(output, "<asr_text>")
    return F.when(at > 0, F.substring(output, at + 10, F.length(output))).otherwise(output)


def well_formed(output: Column) -> Column:
    return output.rlike(r"(?s)^language [A-Za-z]+<asr_text>.*$")


def units(text: Column) -> Column:
    """One unit per ideograph, kana or hangul syllable, one per word of other letters or digits, apostrophes inside it
    included; lower case.

    For text that is already in compatibility form; ``alignment.units`` also folds width.
    """
    letter = r"[\p{L}\p{N}&&[^぀-ヿ㐀-鿿가-힯]]"
    return F.regexp_extract_all(F.lower(text), F.lit(rf"([぀-ヿ㐀-鿿가-힯]|{letter}+(?:'{letter}+)*)"), 1)


def char_error_rate(hyp: Column, ref: Column) -> Column:
    """Edit distance by reference length; 0 if both are empty, 1 if only the reference is; null for null."""
    return F.when(F.length(ref) == 0, (F.length(hyp) > 0).cast("double")).otherwise(F.levenshtein(hyp, ref) / F.length(ref))


def presence(hyp: Column, ref: Column) -> Column:
    """Of two unit lists: without a reference 1 for no output and -1 for any; with one -1 for no output, else 0."""
    return F.when(F.size(ref) == 0, F.when(F.size(hyp) == 0, 1).otherwise(-1)).otherwise(F.when(F.size(hyp) == 0, -1).otherwise(0))


def contains_tokens(tokens: Column, part: Column) -> Column:
    """Whether ``part`` occurs as whole tokens in a row."""
    return F.contains(F.concat(F.lit(" "), tokens, F.lit(" ")), F.concat(F.lit(" "), part, F.lit(" ")))


def prompt_hotwords(prompt: Column) -> Column:
    """The comma-separated words of the ``Hotwords:`` lines of a prompt."""
    lines = F.filter(F.split(prompt, "\n"), lambda l: l.rlike("^Hotwords: "))
    words = F.flatten(F.transform(lines, lambda l: F.split(F.regexp_replace(l, "^Hotwords: ", ""), ",")))
    return F.filter(F.transform(words, lambda w: F.trim(w)), lambda w: (w != "") & (w != "N/A"))


def structured(answer: Column, field: str) -> Column:
    """A field of a ``Language / Hotwords / Transcription`` answer; empty if it isn't there."""
    return F.regexp_extract(answer, rf"(?m)^{field}:[ \t]*(.*)$", 1)


def format_reward(answer: Column) -> Column:
    return sum((answer.rlike(rf"(?m)^{f}:").cast("double") for f in ("Language", "Hotwords", "Transcription")), F.lit(0.0)) / 3


def set_f1(found: Column, wanted: Column) -> Column:
    """F1 of two word sets; 1 if both are empty."""
    a, b = F.array_distinct(found), F.array_distinct(wanted)
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(2.0 * both / (F.size(a) + F.size(b)))


def spaced(unit_list: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(unit_list, " "), F.lit(" "))


def hotword_reward(hyp: Column, ref: Column, offered: Column) -> Column:
    """Of texts ``hyp`` and ``ref`` and the listed words: the share of the listed words in the reference that the output
    has, 1 if none is spoken, minus those it has that aren't spoken, by the spoken ones, at most 1.

    Words count as whole units in a row. Null without a list; a word without units is in neither.
    """
    words = F.filter(F.transform(offered, lambda w: F.trim(w)), lambda w: w != "")
    listed = F.transform(words, lambda w: spaced(units(w)))
    h, r = spaced(units(hyp)), spaced(units(ref))
    has = lambda text, w: (w != "  ") & F.contains(text, w)

    def score(x: Column) -> Column:
        spoken = F.size(F.filter(x["words"], lambda w: has(x["r"], w)))
        hits = F.size(F.filter(x["words"], lambda w: has(x["r"], w) & has(x["h"], w)))
        false = F.size(F.filter(x["words"], lambda w: ~has(x["r"], w) & has(x["h"], w)))
        recall = F.when(spoken > 0, hits / spoken).otherwise(1.0)
        return recall - F.least(F.lit(1.0), false / F.greatest(F.lit(1), spoken))

    none = (F.coalesce(F.size(words), F.lit(0)) <= 0) | ((F.size(words) == 1) & (F.get(words, F.lit(0)) == "N/A"))
    return F.when(~none, let(F.struct(listed.alias("words"), h.alias("h"), r.alias("r")), score))


def candidate_accuracy(hyp: Column, ref: Column, candidates: Column) -> Column:
    """The share of candidates that are in both texts or in neither; 1 without candidates."""
    same = F.size(F.filter(candidates, lambda c: F.contains(hyp, c) == F.contains(ref, c)))
    return F.when(F.size(candidates) > 0, same / F.size(candidates)).otherwise(1.0)


def char_ngrams(text: Column, n: int) -> Column:
    """The distinct character n-grams; none for a text shorter than ``n``."""
    # From an array of characters, as each substring would be sought from the start of the text.
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    grams = let(chars, lambda cs: F.transform(F.sequence(F.lit(1), F.size(cs) - (n - 1)), lambda i: F.array_join(F.slice(cs, i, n), "")))
    return F.when(F.length(text) >= n, F.array_distinct(grams)).otherwise(empty())


def jaccard(a: Column, b: Column) -> Column:
    """0 if either set is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def overlap_recall(word: Column, text: Column) -> Column:
    """The share of a word's characters that the text has."""
    chars = F.split(word, "")
    return let(F.filter(chars, lambda c: c != ""), lambda cs: F.when(F.size(cs) > 0, F.size(F.filter(cs, lambda c: F.contains(text, c))) / F.size(cs)).otherwise(0.0))


def substring_bonus(word: Column, text: Column) -> Column:
    return F.when(F.contains(text, word), 1.0).otherwise(0.0)


def content_overlap(a: Column, b: Column, stopwords: list[str]) -> Column:
    """The share of a's words, without stopwords, that b has; 0 without any."""
    stop = F.array(*[F.lit(w) for w in stopwords])
    x = F.array_except(F.split(F.lower(a), r"\s+"), stop)
    return F.when(F.size(x) > 0, F.size(F.array_intersect(x, F.split(F.lower(b), r"\s+"))) / F.size(x)).otherwise(0.0)


def ideograph_share(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.length(F.regexp_replace(text, r"[^一-鿿]", "")) / F.length(text)).otherwise(0.0)


def script_language(word: Column) -> Column:
    """zh, ja, ko or en by the script of a word, else other."""
    return F.when(word.rlike(r"[぀-ヿ]"), "ja").when(word.rlike(r"[가-힯]"), "ko").when(word.rlike(r"[一-鿿]"), "zh").when(word.rlike("[A-Za-z]"), "en").otherwise("other")


def bare(text: Column) -> Column:
    """Without punctuation, separators and symbols, lower case."""
    return F.lower(F.regexp_replace(text, r"[\p{P}\p{Z}\p{S}]", ""))


def turn_lines(text: Column) -> Column:
    """The ``[S1][0.00-2.50] text`` lines of a text as structs; null for a malformed line."""
    number = lambda l, g: F.regexp_extract(l, TURN, g)
    return F.transform(
        F.filter(F.split(text, r"\r\n|[\r\n]"), lambda l: F.trim(l) != ""),
        lambda l: F.when(l.rlike(TURN), F.struct(number(l, 1).cast("int").alias("speaker"), number(l, 2).cast("double").alias("start"), number(l, 3).cast("double").alias("end"), number(l, 4).alias("text"))),
    )


# Notations of a turn's header as (pattern, groups of speaker, start, end, unit and text; 0 where there is none).
TIME = r"((?:\d{1,9}:){0,2}\d{1,12}(?:[.,]\d{1,12})?)"
NOTATIONS = [
    (rf"^\s*\[([^\[\]]*)\]\s*\[\s*{TIME}\s*[-–~]\s*{TIME}\s*(ms|s)?\s*\]\s?(.*)$", (1, 2, 3, 4, 5)),
    (rf"^\s*{TIME}\s*-->\s*{TIME}\s([^:：]*)[:：]\s?(.*)$", (3, 1, 2, 0, 4)),
    (rf"^\s*\(\s*{TIME}\s*\)([^<>]*)>\s?(.*)$", (2, 1, 0, 0, 3)),
    (rf"^([^:：()\[\]<>]*)\(\s*{TIME}\s*[-–~]\s*{TIME}\s*\)\s*[:：]\s?(.*)$", (1, 2, 3, 0, 4)),
    (rf"^\s*<\s*{TIME}\s*>\s*<\s*{TIME}\s*>([^:：]*)[:：]\s?(.*)$", (3, 1, 2, 0, 4)),
]
NUMBERED = r"^(?i:s|ｓ|Ｓ|spk|speaker|spkr|说话人|发言人|讲话人|sprecher)?[\s_\-#.]*0*(\d+)$"


def clock_seconds(text: Column) -> Column:
    """Seconds of ``12.5``, ``1:02.5`` or ``1:00:02,5``."""
    return F.aggregate(F.split(F.replace(text, F.lit(","), F.lit(".")), ":"), F.lit(0.0), lambda total, part: total * 60 + part.try_cast("double"))


def any_turn_lines(text: Column) -> Column:
    """The lines of a text in any of the five NOTATIONS as structs (speaker, start, end, text); null for a line in none, or
    whose label has no speaker's number. A notation without an end gives a null one."""

    def parsed(line: Column, pattern: str, groups: tuple[int, ...]) -> Column:
        who, start, end, unit, said = (F.regexp_extract(line, pattern, g) if g else F.lit("") for g in groups)
        scale = F.when(unit == "ms", 1000.0).otherwise(1.0)
        speaker = F.regexp_extract(F.trim(who), NUMBERED, 1).try_cast("int")
        turn = F.struct(speaker.alias("speaker"), (clock_seconds(start) / scale).alias("start"), F.when(end != "", clock_seconds(end) / scale).alias("end"), said.alias("text"))
        return F.when(speaker.isNotNull(), turn)

    def first(line: Column) -> Column:
        out = None
        for pattern, groups in NOTATIONS:
            out = F.when(line.rlike(pattern), parsed(line, pattern, groups)) if out is None else out.when(line.rlike(pattern), parsed(line, pattern, groups))
        return out

    return F.transform(F.filter(F.split(text, r"\r\n|[\r\n]"), lambda l: F.trim(l) != ""), first)


def turn_text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.format_string("[S%d][%.2f-%.2f] %s", t["speaker"], t["start"], t["end"], t["text"])), "\n")


def retimed(turns: Column, ratio: float) -> Column:
    """All times multiplied."""
    return F.transform(turns, lambda t: F.struct(t["speaker"].alias("speaker"), (t["start"] * ratio).alias("start"), (t["end"] * ratio).alias("end"), t["text"].alias("text")))


def turn_errors(turns: Column, duration: Column) -> Column:
    """Why a list of turns isn't a valid target, first reason first; null if it is: malformed lines, bounds, order,
    speakers not numbered by first speech."""
    first = F.transform(turns, lambda t, i: F.when(t["speaker"] > F.coalesce(F.array_max(F.transform(F.slice(turns, 1, i), lambda p: p["speaker"])), F.lit(0)) + 1, 1).otherwise(0))
    return (
        F.when(F.size(turns) == 0, "empty")
        .when(F.exists(turns, lambda t: t.isNull()), "malformed")
        .when(F.exists(turns, lambda t: F.coalesce((t["start"] >= t["end"]) | (t["end"] > duration), F.lit(False))), "bounds")
        .when(F.exists(F.transform(turns, lambda t, i: (i > 0) & (t["start"] < F.get(turns, i - 1)["start"])), lambda x: x), "order")
        .when(F.array_max(first) > 0, "numbering")
    )


def target_view(turns: Column, targets: Column, only: bool = False) -> Column:
    """Speakers named in ``targets`` become T1.. in their order there, others S1.. by first speech; or only the former."""
    others = F.array_distinct(F.filter(F.transform(turns, lambda t: t["speaker"]), lambda s: ~F.array_contains(targets, s)))
    label = lambda s: F.when(F.array_contains(targets, s), F.concat(F.lit("T"), F.array_position(targets, s))).otherwise(F.concat(F.lit("S"), F.array_position(others, s)))
    kept = F.filter(turns, lambda t: F.array_contains(targets, t["speaker"])) if only else turns
    return F.array_join(F.transform(kept, lambda t: F.concat(F.lit("["), label(t["speaker"]), F.lit("] "), t["text"])), "\n")


def parse_size(text: Column) -> Column:
    """Bytes of sizes such as ``50G`` or ``1.5 MB``; null for anything else."""
    unit = F.upper(F.regexp_extract(text, r"^\s*[0-9.]+\s*([KMGTP]?)i?B?\s*$", 1))
    power = F.when(unit == "K", 1).when(unit == "M", 2).when(unit == "G", 3).when(unit == "T", 4).when(unit == "P", 5).otherwise(0)
    ok = text.rlike(r"(?i)^\s*[0-9]+(\.[0-9]+)?\s*[KMGTP]?i?B?\s*$")
    return F.when(ok, (F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?)", 1).cast("double") * F.pow(F.lit(1024.0), power)).cast("long"))


def format_size(n: Column) -> Column:
    out = F.concat(n.cast("string"), F.lit("B"))
    for power, unit in enumerate("KMGTP", 1):
        out = F.when(n >= 1024**power, F.format_string(f"%.1f{unit}", n / float(1024**power))).otherwise(out)
    return out


def replace_prefix(path: Column, prefixes: dict[str, str]) -> Column:
    """The longest matching prefix is replaced."""
    out = path
    for old, new in sorted(prefixes.items(), key=lambda p: len(p[0])):
        out = F.when(path.startswith(old), F.concat(F.lit(new), F.substring(path, len(old) + 1, 10_000_000))).otherwise(out)
    return out
