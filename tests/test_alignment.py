"""Alignments against plain dynamic programming and exhaustive search."""

import itertools
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeloom.functions import alignment as A

words = st.lists(st.sampled_from("abc"), max_size=8)


def plain(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (x != y))
    return d[-1]


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_edit_distance(a, b):
    assert A.edit_distance(a, b) == plain(a, b)
    assert A.semi_global(a, b) == min(plain(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))


@settings(max_examples=100, deadline=None)
@given(words, words)
def test_alignment_steps(a, b):
    steps = A.alignment(a, b)
    assert sum(op != "=" for op, _, _ in steps) == plain(a, b)
    assert [a[i] for op, i, _ in steps if op != "ins"] == a and [b[j] for op, _, j in steps if op != "del"] == b
    assert sum(A.charged_edits(["x"] * len(a), a, b).values()) == (plain(a, b) if a else 0)


@settings(max_examples=100, deadline=None)
@given(words, words)
def test_lcs(a, b):
    best = max((len(c) for n in range(len(a) + 1) for c in itertools.combinations(a, n) if all(x in it for it in [iter(b)] for x in c)), default=0)
    assert A.lcs_ratio(a, b) == (2 * best / (len(a) + len(b)) if a and b else 0.0)


def test_assignment():
    rng = random.Random(1)
    for _ in range(60):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        cost = np.array([[rng.randint(-9, 9) for _ in range(m)] for _ in range(n)])
        got = A.best_assignment(cost)
        small, big = min(n, m), max(n, m)
        best = min(sum(cost[i, j] if n <= m else cost[j, i] for i, j in enumerate(p)) for p in itertools.permutations(range(big), small))
        assert len(got) == small and sum(cost[i, j] for i, j in got) == best


def test_speaker_mapping():
    mapped, edits = A.speaker_mapping({"a": list("xyz"), "b": list("pq")}, {"1": list("pq"), "2": list("xyw")})
    assert mapped == {"a": "2", "b": "1"} and edits == 1
    assert A.speaker_mapping({}, {"1": ["x"]}) == ({}, 1)


def test_units_and_accents():
    assert A.units("Ｈello 世界, don't") == ["hello", "世", "界", "don't"]
    assert A.units(None) == [] and A.strip_accents("Ärger, né?") == "arger ne" and A.strip_accents(None) is None
    assert A.accuracy("", "") == 1.0 and A.accuracy("", "x") == 0.0 and A.accuracy("a b", "a c") == 0.5
    assert A.partial_ratio("bcd", "abcde") == 1.0 and A.partial_ratio("", "x") == 0.0


def test_repeated_grams():
    assert round(A.repeated_grams("abcdefgh" * 2), 6) == round(1 / 9, 6) == round(A.repeated_grams("Ab, cdefgＨ! abcdefgh"), 6)
    assert round(A.repeated_grams("没人知道那边为什么，" * 2), 6) == round(2 / 11, 6)
    assert A.repeated_grams("abcdefg") == 0 and A.repeated_grams("") == 0


def test_repeated_character_ngrams(spark, tmp_path):
    """Every language and null ones count; only a null text gives no row."""
    from lakeloom.plans.metrics import repeated_character_ngrams

    rows = [(1, "没人知道那边为什么" * 2, "zh"), (2, "abcdefgh" * 2, None), (3, "abcdefgh" * 2, "en-US"), (4, None, "en"), (5, "", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["repeated"] for r in repeated_character_ngrams(spark, str(tmp_path)).collect()}
    assert found == {1: 0.181818, 2: 0.111111, 3: 0.111111, 5: 0.0}


@given(words, words)
def test_indel_similarity(a, b):
    assert A.indel_similarity("".join(a), "".join(b)) == A.lcs_ratio(a, b)
