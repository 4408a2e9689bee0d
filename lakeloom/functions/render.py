"""Records as conversations: templates, messages, answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeloom.functions.draws import u

# Templates of each task: user text with one <audio> per slot, variants chosen per record.
TEMPLATES = {
    "asr": ["<audio>Write down what is said.", "<audio>Transcribe this recording in {language}."],
    "target_speaker_asr": ["<audio>This is the speaker. <audio>Write down what they say.", "<audio><audio>Transcribe only the first voice."],
    "speaker_attributed_asr": ["<audio>Write down who says what.", "<audio>Transcribe all speakers with their labels."],
}


def template(task: Column, key: Column, seed: int) -> Column:
    """The variant of a task's template that a record draws; null for an unknown task."""
    out = F.lit(None).cast("string")
    for name, variants in TEMPLATES.items():
        pick = F.element_at(F.array(*[F.lit(v) for v in variants]), (F.floor(u(seed, "template", F.lit(name), key) * len(variants)) + 1).cast("int"))
        out = F.when(task == name, pick).otherwise(out)
    return out


def fill(text: Column, values: dict[str, Column]) -> Column:
    """``{name}`` replaced; a missing value is an empty string."""
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return text


def placeholders(text: Column) -> Column:
    return F.regexp_count(text, F.lit("<audio>"))


def messages(system: Column, user: Column, assistant: Column) -> Column:
    """Role and content in order; an empty system prompt is left out, an empty answer is ``None``."""
    m = F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")), F.struct(F.lit("assistant").alias("role"), F.when(F.coalesce(F.trim(assistant), F.lit("")) == "", F.lit("None")).otherwise(assistant).alias("content")))
    return F.filter(m, lambda x: (x["role"] != "system") | (F.coalesce(x["content"], F.lit("")) != ""))


def structured_answer(language: Column, hotwords: Column, target: Column) -> Column:
    """Language, hotwords and transcription by line."""
    words = F.when(F.size(hotwords) > 0, F.array_join(hotwords, ", ")).otherwise("N/A")
    return F.concat(F.lit("Language: "), F.coalesce(language, F.lit("N/A")), F.lit("\nHotwords: "), words, F.lit("\nTranscription: "), F.coalesce(target, F.lit("")))


def task_code(task: Column, target: Column, hotwords: Column, replay: Column) -> Column:
    """0 asr, 1 target present, 2 target absent, 3 speaker-attributed, 4 asr with hotwords, 5 left out of replay."""
    bare = F.coalesce(F.trim(target), F.lit("")) == ""
    return F.when(~replay, 5).when((task == "target_speaker_asr") & ~bare, 1).when(task == "target_speaker_asr", 2).when(task == "speaker_attributed_asr", 3).when(F.size(hotwords) > 0, 4).otherwise(0)


def numeric_leaves(json: Column, depth: int = 3) -> Column:
    """A map of ``a/b/c`` paths to the numbers of a JSON object down to a depth."""
    flat = F.from_json(json, "map<string,string>")
    for _ in range(depth - 1):
        flat = F.map_from_entries(
            F.flatten(
                F.transform(
                    F.map_entries(flat),
                    lambda e: F.when(
                        F.ltrim(e["value"]).startswith("{"),
                        F.transform(F.map_entries(F.from_json(e["value"], "map<string,string>")), lambda i: F.struct(F.concat(e["key"], F.lit("/"), i["key"]).alias("key"), i["value"].alias("value"))),
                    ).otherwise(F.array(F.struct(e["key"].alias("key"), e["value"].alias("value")))),
                )
            )
        )
    return F.map_filter(F.transform_values(flat, lambda _, v: v.try_cast("double")), lambda _, v: v.isNotNull())
