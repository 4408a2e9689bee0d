"""Problem 3: transcripts into clean, ordered speaker turns."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions.catalog import catalogue_names, spelling, two_letter_language
from lakeloom.functions.text import NUMBERED
from lakeloom.llm.boosting import BoostedTrees
from lakeloom.llm.fillers import FillerModel, train_fillers
from lakeloom.plans.text_metrics import CLOCK_SQL, HEADERS_SQL
from lakeloom.plans.views import RECORDS_SQL
from lakeloom.session import broadcast_within
from lakeloom.sources.tables import table

TRAIN_RECORDS = 300
TURN_SCHEMA = "id string, turn_no int, start_cs long, end_cs long, speaker string, text string, utterances int, corrected int"

_TIME = r"(?:\d{1,9}:){0,2}\d{1,12}(?:[.,]\d{1,12})?"
_SPAN = rf"\s*+(?P<start>{_TIME})\s*+[-–~]\s*+(?P<end>{_TIME})\s*+"
# A header gives the speaker and the start, mostly the end; what follows it is text. Possessive, so that a line of any
# length is read once.
_HEADERS = [
    re.compile(rf"\s*+\[(?P<who>[^\[\]]*+)\]\s*+\[{_SPAN}(?P<unit>ms|s)?\s*+\]\s?(?P<text>.*)", re.S),
    re.compile(rf"\s*+(?P<start>{_TIME})\s*+-->\s*+(?P<end>{_TIME})\s(?P<who>[^:：]*+)[:：]\s?(?P<text>.*)", re.S),
    re.compile(rf"\s*+\(\s*+(?P<start>{_TIME})\s*+\)(?P<who>[^<>]*+)>\s?(?P<text>.*)", re.S),
    re.compile(rf"(?P<who>[^:：()\[\]<>]*+)\({_SPAN}\)\s*+[:：]\s?(?P<text>.*)", re.S),
    re.compile(rf"\s*+<\s*+(?P<start>{_TIME})\s*+>\s*+<\s*+(?P<end>{_TIME})\s*+>(?P<who>[^:：]*+)[:：]\s?(?P<text>.*)", re.S),
]
_LINES = re.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_NUMBERED = re.compile(r"(?:s|spk|speaker|spkr|说话人|发言人|讲话人|sprecher)?[\s_\-#.]*+(\d++)", re.I)
_BRACKETS = {"(": ")", "[": "]", "{": "}", "<": ">", "（": "）", "【": "】", "＜": "＞", "［": "］", "〔": "〕"}
_CLOSING = {b: a for a, b in _BRACKETS.items()}
_BRACKET = re.compile(r"[()\[\]{}<>（）【】＜＞［］〔〕]")
_MARKED = re.compile(r"\*[^*\s][^*]*+\*|♪[^♪]*+♪")


class Utterance(NamedTuple):
    label: str
    who: str | None
    start: Decimal | None
    end: Decimal | None
    text: str


def without_annotations(text: str) -> str:
    """The text with every sound annotation replaced by a space: what stands in paired brackets of one kind, nested ones
    included, between two asterisks or between two notes, of any length. Brackets without a partner stay."""
    if _BRACKET.search(text):
        open_at: dict[str, list[int]] = {}
        spans: list[list[int]] = []
        for m in _BRACKET.finditer(text):
            c, at = m.group(), m.start()
            if c in _BRACKETS:
                open_at.setdefault(c, []).append(at)
            elif open_at.get(_CLOSING[c]):
                start = open_at[_CLOSING[c]].pop()
                while spans and spans[-1][0] >= start:
                    spans.pop()
                if spans and spans[-1][1] >= start:
                    start = spans.pop()[0]
                spans.append([start, at + 1])
        out, last = [], 0
        for start, end in spans:
            out += [text[last:start], " "]
            last = end
        text = "".join(out) + text[last:]
    return _MARKED.sub(" ", text) if "*" in text or "♪" in text else text


def clean_text(text: str, fillers: FillerModel, language: str = "und") -> str:
    """The text without sound annotations and hesitations; empty if no letter or digit remains."""
    text = fillers.removed(without_annotations(text), language)
    text = re.sub(r"\s+", " ", text).strip()
    text = re.sub(r"(?<=[一-鿿]) (?=[一-鿿])", "", text)
    text = re.sub(r"^[\s,，.。、…]+", "", text)
    return text if any(c.isalnum() for c in text) else ""


def speaker_of(label: str, identities: dict[str, str]) -> str | None:
    """``S`` and the speaker's number, from the label or from whose name it is; None if it tells neither."""
    name = unicodedata.normalize("NFKC", label).strip().casefold()
    known = identities.get(name)
    number = _NUMBERED.fullmatch(known if known is not None else name)
    return f"S{''.join(str(int(d)) for d in number.group(1)).lstrip('0') or '0'}" if number else None


def _seconds(text: str, unit: str | None) -> Decimal:
    total = Decimal(0)
    for part in text.replace(",", ".").split(":"):
        total = total * 60 + Decimal(part)
    return total / 1000 if unit == "ms" else total


def _number(value) -> Decimal | None:
    if isinstance(value, bool) or value is None:
        return None
    try:
        d = Decimal(str(value).strip())
        return d if d.is_finite() and abs(d) < 10**12 else None
    except InvalidOperation:
        return None


def _cs(seconds: Decimal | None) -> int | None:
    return None if seconds is None else int((seconds * 100).quantize(Decimal(1), ROUND_HALF_UP))


def utterances_of(target: str | None, metadata: str | None) -> list[Utterance]:
    """The utterances as written: of the target's timed lines, else of ``metadata.segments``.

    A line without header continues the one above; before any header it is nobody's and left out. A segment without a
    valid start (a number below 10^12) takes that of the one above. Unreadable metadata counts as empty.
    """
    try:
        meta = json.loads(metadata) if metadata else {}
    except ValueError:
        meta = {}
    meta = meta if isinstance(meta, dict) else {}
    named = meta.get("speaker_identities")
    identities = {unicodedata.normalize("NFKC", v).strip().casefold(): unicodedata.normalize("NFKC", k).strip().casefold() for k, v in named.items() if isinstance(v, str)} if isinstance(named, dict) else {}
    out: list[list] = []
    for line in _LINES.split(target or ""):
        found = next((m for h in _HEADERS if (m := h.fullmatch(line)) and m["who"].strip()), None)
        if found:
            g = found.groupdict()
            start, end = _seconds(g["start"], g.get("unit")), _seconds(g["end"], g.get("unit")) if g.get("end") else None
            out.append([g["who"].strip(), start, end, [g["text"]]])
        elif out and line.strip():
            out[-1][3].append(line)
    if not out and isinstance(meta.get("segments"), list):
        start = Decimal(0)
        for s in meta["segments"]:
            if isinstance(s, dict):
                own, length = _number(s.get("start")), _number(s.get("duration"))
                start = start if own is None else own
                out.append([str(s.get("speaker") or ""), start, None if length is None else start + length, [str(s.get("text") or "")]])
    return [Utterance(who, speaker_of(who, identities), start, end, " ".join(text)) for who, start, end, text in out]


def clean_utterances(target: str | None, metadata: str | None, fillers: FillerModel, language: str = "und") -> list[Utterance]:
    """Utterances in which a word remains, in order of start (ties as written), with clean text."""
    kept = [u._replace(text=text) for u in utterances_of(target, metadata) if (text := clean_text(u.text, fillers, language))]
    kept.sort(key=lambda u: u.start)
    return kept


_ENDS = tuple(".?!。？！…")
FEATURES = ["same_speaker", "same_label", "gap_s", "overlaps", "length_before", "length_after", "sentence_ended", "returns"]


def pair_features(us: list[Utterance], hide_labels: bool = False) -> list[list[float]]:
    """Of each adjacent pair what the labels, the gap and the context say; -1 for what isn't known."""
    rows = []
    for i in range(1, len(us)):
        a, b = us[i - 1], us[i]
        known = not hide_labels and a.who is not None and b.who is not None
        gap = float(b.start - a.end) if a.end is not None else -1.0
        after = us[i + 1] if i + 1 < len(us) else None
        rows.append(
            [
                float(a.who == b.who) if known else -1.0,
                float(a.label == b.label) if not hide_labels else -1.0,
                max(-60.0, min(60.0, gap)),
                float(a.end is not None and b.start < a.end),
                min(500.0, len(a.text)),
                min(500.0, len(b.text)),
                float(a.text.endswith(_ENDS)),
                -1.0 if after is None or hide_labels or after.who is None or a.who is None else float(after.who == a.who),
            ]
        )
    return rows


def train_boundaries(samples: list[list[Utterance]]) -> BoostedTrees:
    """Boundary decisions learned from pairs whose speakers are both known; half of the evidence is shown without
    labels, so that the model can also decide by gap and context where labels are missing."""
    x, y = [], []
    for us in samples:
        truth = [float(a.who != b.who) if a.who and b.who else None for a, b in zip(us, us[1:])]
        for hidden in (False, True):
            for row, t in zip(pair_features(us, hidden), truth):
                if t is not None:
                    x.append(row)
                    y.append(t)
    return BoostedTrees().fit(np.array(x, float).reshape(-1, len(FEATURES)), np.array(y))


def _named(u: Utterance) -> str:
    return u.who or unicodedata.normalize("NFKC", u.label).strip().casefold()


def turns_of_batch(ids: list, utterances: list[list[Utterance]], model: BoostedTrees) -> pd.DataFrame:
    """Turns of many records at once: one prediction for all adjacent pairs, known speakers or not.

    The exact check that follows: where both utterances name a speaker, by number or else by label, a boundary is where
    these differ. ``corrected`` counts the decisions at or in a turn that the check had to change. A turn's speaker is
    the first known number in it, else the label as written.
    """
    rows = [r for us in utterances for r in pair_features(us)]
    cut = model.probability(np.array(rows)) >= 0.5 if rows else np.zeros(0, bool)
    out, at = [], 0
    for rid, us in zip(ids, utterances):
        turns: list[list[Utterance]] = []
        wrong: list[int] = []
        for i, u in enumerate(us):
            new, changed = True, 0
            if i:
                new, one, two = bool(cut[at]), _named(us[i - 1]), _named(u)
                at += 1
                if one and two and new != (one != two):
                    new, changed = not new, 1
            if new:
                turns.append([u])
                wrong.append(changed)
            else:
                turns[-1].append(u)
                wrong[-1] += changed
        for n, t in enumerate(turns):
            who = next((u.who for u in t if u.who), None) or unicodedata.normalize("NFKC", t[0].label).strip()
            ends = [u.end for u in t if u.end is not None]
            out.append((rid, n, _cs(t[0].start), _cs(max(ends)) if ends else None, who, " ".join(u.text for u in t), len(t), wrong[n]))
    p = pd.DataFrame(out, columns=["id", "turn_no", "start_cs", "end_cs", "speaker", "text", "utterances", "corrected"])
    return p.astype({"start_cs": "Int64", "end_cs": "Int64"})


def clean_turns(records: DataFrame, catalog: DataFrame, train_records: int = TRAIN_RECORDS) -> DataFrame:
    """Turns of every ``speaker_attributed_asr`` row of ``records``, without a shuffle.

    Both models are fitted on the driver: the boundaries on at most ``train_records`` records, those least by the hash
    of their id, the fillers on the labelled forms. A record without utterances, or with a null id, gives no row; a
    redelivered record gives its rows again.
    """
    names = broadcast_within(catalogue_names(catalog).select("spelled", "only_language"))
    mine = records.where("task = 'speaker_attributed_asr' and id is not null").select("id", "target", "metadata", "language", "dataset_id")
    rows = mine.join(names, spelling(mine["dataset_id"]) == names["spelled"], "left").select(
        "id", "target", "metadata", two_letter_language(F.col("language"), F.col("only_language")).alias("meant")
    )
    fillers = train_fillers()
    # The records are found by their hashes alone, so that no task sends texts of records that aren't among the least.
    hashed = F.xxhash64("id")
    last = rows.select(hashed.alias("h")).orderBy("h").limit(train_records).agg(F.max("h")).first()[0]
    sample = rows.where(hashed <= (last or 0)).orderBy(hashed, "id").limit(train_records).toPandas()
    model = train_boundaries([clean_utterances(t, m, fillers, c) for t, m, c in zip(sample["target"], sample["metadata"], sample["meant"])])

    def turns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            made = turns_of_batch(p["id"].tolist(), [clean_utterances(t, m, fillers, c) for t, m, c in zip(p["target"], p["metadata"], p["meant"])], model)
            if len(made):
                yield made

    return rows.mapInPandas(turns, TURN_SCHEMA)


def p3_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean turns of every record; redelivered records count once."""
    return clean_turns(table(spark, sf_dir, "audio_records"), table(spark, sf_dir, "dataset_catalog")).dropDuplicates(["id", "turn_no"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, start_cs, speaker) of each clean turn."""
    return clean_turns(table(spark, sf_dir, "audio_records"), table(spark, sf_dir, "dataset_catalog")).select("id", "start_cs", "speaker").distinct()


QUERIES = {"p3_found": p3_found, "p3_turns": p3_turns}

_SOUND = r"\[\[[^\[\]]*\]\]|\[[^\[\]]*\]|\([^()]*\)|（[^（）]*）|【[^【】]*】|<[^<>]*>|＜[^＜＞]*＞|\{[^{}]*\}|\*[^*\s][^*]*\*"
_BARE = f"regexp_replace(regexp_replace(said, '{_SOUND}', ' ', 'g'), '{_SOUND}', ' ', 'g')"
_HESITATION = "[嗯呃啊哦诶唔噢喔欸额呣哎唉]+|u+h+m*|u+m+|e+r+m*|e+h+m*|a+h+m*|h+m+|m{2,}|m+h+m+|ä+h+m*|ö+h+m*|ü+h+m*"
SQL = {
    # Hesitations by patterns, annotations to a depth of two: a plain check of the operator's turns on these tables.
    "p3_found": f"""WITH {RECORDS_SQL}, {HEADERS_SQL},
headed AS (SELECT *, sum((trim(who) <> '')::INT) OVER (PARTITION BY id ORDER BY pos) AS g FROM heads),
written AS (SELECT id, g AS place, max(trim(who)) AS who, max(CASE WHEN trim(who) <> '' THEN {CLOCK_SQL.format(x='t0')} / scale END) AS start, string_agg(CASE WHEN trim(who) <> '' THEN said ELSE l END, ' ' ORDER BY pos) AS said FROM headed WHERE g > 0 GROUP BY id, g),
att AS (SELECT id, metadata FROM records WHERE task = 'speaker_attributed_asr' AND json_valid(metadata)),
untimed AS (SELECT id, unnest(CAST(json_extract(metadata, '$.segments[*]') AS JSON[])) AS x, generate_subscripts(CAST(json_extract(metadata, '$.segments[*]') AS JSON[]), 1) AS place FROM att WHERE id NOT IN (SELECT id FROM written)),
listed AS (SELECT id, place, coalesce(x->>'speaker', '') AS who, coalesce(last_value(TRY_CAST(x->>'start' AS DOUBLE) IGNORE NULLS) OVER (PARTITION BY id ORDER BY place), 0) AS start, coalesce(x->>'text', '') AS said FROM untimed),
named AS (SELECT id, label, lower(trim(json_extract_string(metadata, '$.speaker_identities.' || label))) AS name FROM (SELECT id, metadata, unnest(json_keys(metadata, '$.speaker_identities')) AS label FROM att)),
told AS (SELECT u.id, u.place, u.start, 'S' || CAST(regexp_extract(trim(coalesce(n.label, u.who)), '{NUMBERED}', 1) AS BIGINT) AS speaker, regexp_extract_all(lower({_BARE}), '[\\p{{L}}\\p{{N}}]+') AS words FROM (SELECT * FROM written UNION ALL SELECT * FROM listed) u LEFT JOIN named n ON n.id = u.id AND n.name = lower(trim(u.who))),
kept AS (SELECT *, lag(speaker) OVER (PARTITION BY id ORDER BY start, place) AS before FROM told WHERE len(list_filter(words, lambda w: NOT regexp_full_match(w, '{_HESITATION}'))) > 0)
SELECT DISTINCT id, CAST(round(start * 100 + 1e-7) AS BIGINT) AS start_cs, speaker FROM kept WHERE before IS NULL OR before <> speaker""",
}
