import os
import random

import pytest
from pyspark.sql import functions as F

from lakeloom.llm import token_budget as B
from lakeloom.llm import tokens as T

pytestmark = pytest.mark.skipif(not os.path.isdir(T.TOKENIZER_DIR), reason="no vocabulary files")
CATALOG = "dataset_id string, version string, languages array<string>, aliases array<string>, provenance string"


def catalog(spark):
    rows = [("alpha_set", "1", ["zh"], ["alf", "Alpha-One"], '{"domain": "calls"}'), ("beta", "1", ["en"], [], '{"domain": "talks"}'), ("beta", "2", ["en", "de"], None, None), (None, "1", ["en"], [], "{}")]
    return spark.createDataFrame(rows, CATALOG)


def greedy(words, text):
    longest, n = max(map(len, words)), 0
    for w in T.LongestMatch._WORD.findall(text.encode()):
        i = 0
        while i < len(w):
            i = next(j for j in range(min(len(w), i + longest), i, -1) if w[i:j] in words)
            n += 1
    return n


def test_longest_match_is_greedy():
    rng = random.Random(5)
    single = {bytes([b]) for b in range(256)}
    for _ in range(40):
        words = single | {bytes(rng.choice(b"abc ") for _ in range(rng.randint(2, 6))) for _ in range(12)}
        m = T.LongestMatch(words)
        for _ in range(30):
            text = "".join(rng.choice("abcd  \n") for _ in range(rng.randint(0, 40)))
            assert m.count(text) == greedy(words, text)
    with pytest.raises(ValueError):
        T.LongestMatch({b"a"})


def test_vocabulary_counts():
    data = T.read_vocabulary()
    m, words = T.longest_match(data), set(T._ranks(data))
    for text in ["", None, "hello world", "没人知道松坪西那边", "ä" * 50, "x" * 5000, " \r\n\t ", "1" * 300]:
        assert m.count(text) == (greedy(words, text) if text else 0)
    long = "The held-out speakers of Barastead never appear. " * 2000
    assert abs(m.count(long) / len(T.encoding(data).encode_ordinary(long)) - 1) < 0.05


def test_names_and_languages(spark):
    rows = [("1", "ALPHA-SET", None, "x"), ("2", "alf@1", "N/A", None), ("3", " beta ", "", ""), ("4", "beta", "English", "hi"), ("5", "nobody", "pt-BR", "hi"), ("6", None, "Klingon", "hi"), ("7", "alpha one", "zh_Hans", "hi"), (None, "beta", "GER", "hi")]
    df = spark.createDataFrame(rows, "item string, dataset string, language string, text string").withColumn("spelled", F.lit("clash")).withColumn("catalogue_id", F.lit("clash"))
    got = {r["item"]: (r["catalogue_id"], r["meant"], r["tokens"]) for r in B.sized(df, catalog(spark)).collect()}
    assert {k: v[:2] for k, v in got.items()} == {"1": ("alpha_set", "zh"), "2": ("alpha_set", "zh"), "3": ("beta", "und"), "4": ("beta", "en"), "5": (None, "pt"), "6": (None, "und"), "7": ("alpha_set", "zh"), None: ("beta", "de")}
    assert got["2"][2] == got["3"][2] == 0 and got["4"][2] == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "item string, dataset string, language string, text string")
    assert B.sized(df, catalog(spark)).count() == 0
