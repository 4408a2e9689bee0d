"""Which speaker a turn's words went to: errors of speaker-attributed text, turn by turn."""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.alignment import charged_edits, common_share, semi_global, speaker_mapping, units
from lakeloom.functions.text import char_error_rate
from lakeloom.operators.timeline import overlapping

# Seconds around a turn in which its text may be, and the share of edits up to which it is there.
NEAR_S, FOUND = 2.0, 0.34
LEAST_UNITS = 4


# The share of an output's characters from which it counts as somebody's words, and what is short.
COVERED, SHORT = 0.5, 4


def output_category(said: str, others: str, own: str, fillers: str) -> str:
    """What an output that should not be there consists of, first reason first: fillers only, words of others that speak at
    the time, words the speaker said elsewhere, something short, or anything else. Texts are bare characters."""
    if said and set(said) <= set(fillers):
        return "filler"
    theirs, mine = common_share(said, others), common_share(said, own)
    if theirs >= COVERED and theirs >= mine:
        return "words of others"
    if mine >= COVERED:
        return "words from elsewhere"
    return "short" if len(said) <= SHORT else "unrelated"


class Turn(NamedTuple):
    key: int
    speaker: str
    start: float
    end: float
    units: list[str]


class Attributed(NamedTuple):
    key: int
    units: int
    text_edits: int
    speaker_edits: int
    overlapped: bool
    kind: str | None


def text_edits(turn: Turn, near: list[Turn]) -> int:
    """The least edits by which a turn's text is found among nearby turns whoever speaks: in one of them, or in all of
    them in order of time; never more than its units."""
    texts = [h.units for h in near]
    together = [x for t in texts for x in t]
    return min([len(turn.units), *(semi_global(turn.units, t) for t in [*texts, together])])


def attributed(ref: list[Turn], hyp: list[Turn]) -> list[Attributed]:
    """Each reference turn's edits once as text alone and once under the speaker mapping of fewest edits, and who holds
    its text where the second number is larger.

    ``split``: a speaker to whom no reference speaker is mapped; ``swap``: one mapped to another; ``merged``: the turn's
    speaker has none; ``same``: the mapped one itself; ``lost``: nobody near. Null without surplus.
    """
    ref, hyp = (sorted(t, key=lambda x: (x.start, x.end, x.key)) for t in (ref, hyp))
    by_speaker: list[dict[str, list[str]]] = [{}, {}]
    owners: dict[str, list[int]] = {}
    for side, turns in enumerate((ref, hyp)):
        for t in turns:
            by_speaker[side].setdefault(t.speaker, []).extend(t.units)
            if side == 0:
                owners.setdefault(t.speaker, []).extend([t.key] * len(t.units))
    mapped, _ = speaker_mapping(*by_speaker)
    taken = set(mapped.values())
    charged: dict[int, int] = {}
    for speaker, said in by_speaker[0].items():
        for key, n in charged_edits(owners[speaker], said, by_speaker[1].get(mapped.get(speaker), [])).items():
            charged[key] = charged.get(key, 0) + n
    out = []
    for t in ref:
        near = [h for h in hyp if h.start < t.end + NEAR_S and t.start - NEAR_S < h.end]
        alone, with_speaker = text_edits(t, near), charged.get(t.key, 0)
        kind = None
        if with_speaker > alone:
            edits, holder = min(((semi_global(t.units, h.units), h.speaker) for h in near if h.units), key=lambda x: x[0], default=(len(t.units), None))
            if holder is None or edits > FOUND * len(t.units):
                kind = "lost"
            elif t.speaker not in mapped:
                kind = "merged"
            elif holder == mapped[t.speaker]:
                kind = "same"
            else:
                kind = "swap" if holder in taken else "split"
        overlapped = any(o.speaker != t.speaker and o.start < t.end and t.start < o.end for o in ref)
        out.append(Attributed(t.key, len(t.units), alone, with_speaker, overlapped, kind))
    return out


SCHEMA = "window_id string, stretch long, turn_id long, units int, text_edits int, speaker_edits int, overlapped boolean, kind string"


def attribution(ref: DataFrame, hyp: DataFrame, stretch: int = 6_000) -> DataFrame:
    """(turn_id, window_id, speaker, s, e, text) on both sides -> ``attributed`` of every reference turn of LEAST_UNITS
    units or more.

    Windows are scored in stretches of ``stretch`` units by the turns' starts, so that one that is always on is many
    tasks. Rows without speaker or text take no part.
    """
    def side(t: DataFrame) -> DataFrame:
        return t.where("speaker is not null and text is not null").select("window_id", F.floor(F.col("s") / stretch).alias("stretch"), "turn_id", "speaker", "s", "e", "text")

    def turns(p: pd.DataFrame) -> list[Turn]:
        return [Turn(int(r.turn_id), r.speaker, r.s / 100, r.e / 100, units(r.text)) for r in p.itertuples()]

    def score(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        got = [(*key, *x) for x in attributed(turns(a), turns(b)) if x.units >= LEAST_UNITS] if len(a) else []
        return pd.DataFrame(got, columns=["window_id", "stretch", "turn_id", "units", "text_edits", "speaker_edits", "overlapped", "kind"])

    keys = ["window_id", "stretch"]
    return side(ref).groupBy(*keys).cogroup(side(hyp).groupBy(*keys)).applyInPandas(score, SCHEMA)


def wrong_speakers(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """(turn_id, own, other) of turns whose output isn't empty and that others overlap: the character error rate of the
    output against the turn's own text, and the least against those of others at the time."""
    t = ref.where("speaker is not null and text is not null").select("turn_id", "window_id", "speaker", "s", "e", F.lower("text").alias("text"))
    said = hyp.where("text is not null and trim(text) <> ''").select("turn_id", F.lower("text").alias("said"))
    pairs = overlapping(t.drop("text"), t, ["window_id"]).where("a_speaker <> b_speaker").select(F.col("a_turn_id").alias("turn_id"), F.col("b_text").alias("text"))
    others = pairs.join(said, "turn_id").groupBy("turn_id").agg(F.min(char_error_rate(F.col("said"), F.col("text"))).alias("other"))
    return t.join(said, "turn_id").join(others, "turn_id").select("turn_id", "window_id", char_error_rate(F.col("said"), F.col("text")).alias("own"), "other")
