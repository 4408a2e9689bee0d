"""Packing, mixing and pieces."""

import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import chunking as C
from lakeloom.llm import mixing as M
from lakeloom.llm import packing as P
from lakeloom.llm import tokens as T

pytestmark = pytest.mark.skipif(not os.path.isdir(T.TOKENIZER_DIR), reason="no vocabulary files")
DOC = "doc_id long, text string, source string, tokens long, curve long, limit_name string"


def documents(spark):
    rng = random.Random(4)
    words = ["harbour", "the", "梯子", "of", "speech", "松坪西那边", "\n", "\n\n", "。", ",", "window", "12", "…"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 40, 200, 1500]))) for _ in range(120)] + [None, "", texts_equal(), texts_equal()]
    return spark.createDataFrame([(i, t, rng.choice(["aa", "AA@1", "bb", "none", None]), 1, 1, "clash") for i, t in enumerate(texts)] + [(None, "x", "aa", 1, 1, "clash")], DOC)


def texts_equal():
    return "the same text twice " * 30


def test_packing(spark):
    docs = documents(spark)
    sizes = {r["doc_id"]: r["tokens"] for r in P.curve_positions(docs).collect()}
    got = P.pack(docs, [("pack_a", 300, 0), ("pack_b", 1000, 0)]).toPandas()
    for (name, cap) in (("pack_a", 300), ("pack_b", 1000)):
        g = got[got["limit_name"] == name]
        per = g.groupby("container_id")["tokens"].sum()
        assert per.max() <= cap and per.sum() == sum(sizes.values())
        assert per.sum() / (len(per) * cap) > 0.93
        for doc, rows in g.groupby("doc_id"):
            assert (len(rows) == 1) == (sizes[doc] <= cap)
            spans = sorted(zip(rows["token_start"], rows["tokens"]))
            assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[-1][0] + spans[-1][1] == sizes[doc]
        assert set(g["doc_id"]) == set(sizes)
    assert P.pack(docs.limit(0), [("pack_a", 300, 0)]).count() == 0 and P.pack(docs, []).count() == 0


def test_best_fit_and_limits(spark):
    b = P.BestFit(10)
    assert b.put(7, "x") == "x" and b.put(6, "y") == "y" and b.put(4, "z") == "y" and b.put(3, "q") == "x"
    b.close(0)
    assert b.put(0, "new") == "new"
    df = spark.createDataFrame([("pack_a", 5, None), ("pack_a", 5, None), ("piece_b", 7, 2)], "limit_name string, capacity_tokens int, overlap_tokens int")
    assert P.limits_of(df, "pack_") == [("pack_a", 5, 0)] and P.limits_of(df, "piece_") == [("piece_b", 7, 2)]


def test_hilbert_curve_steps_by_one():
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    order = cells[np.argsort(P.hilbert_key(cells, 3))]
    assert sorted(P.hilbert_key(cells, 3)) == list(range(512)) and (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_similar_documents_lie_closer():
    enc = T.encoding(T.read_vocabulary())
    at = lambda t: P.curve_cells(np.array(enc.encode_ordinary(t)))
    a, b, c = at("the ladder is in the garden " * 20), at("the ladder is in the big garden " * 20), at("松坪西那边为什么把喷泉粉刷了" * 20)
    assert np.abs(a - b).sum() < np.abs(a - c).sum()


def test_budgets():
    t = {"a": (0.5, 2), "b": (0.3, 1), "c": (0.2, 4), "gone": (0.0, 1)}
    plan = M.plan_budgets({"a": 100, "b": 90, "c": 10}, t)
    assert plan == {"a": (100, 1, 0), "b": (60, 0, 60), "c": (40, 4, 0)}
    assert M.plan_budgets({"a": 100, "b": 90, "c": 10}, t, 1000)["b"] == (90, 1, 0)
    assert M.plan_budgets({}, t) == {}


def test_mix(spark):
    cat = spark.createDataFrame([("aa", ["en"], [], "{}"), ("bb", ["en"], [], "{}")], "dataset_id string, languages array<string>, aliases array<string>, provenance string")
    sized = M.sized_documents(documents(spark), cat)
    targets = spark.createDataFrame([("aa", 0.7, 3), ("bb", 0.3, 2), ("empty", 0.1, 2), (None, 0.1, 2)], "source string, target_share double, max_repeats int")
    mixed, report = M.mix(sized, targets)
    g = mixed.toPandas()
    assert g.groupby(["source", "doc_id"]).size().max() <= 3 and (g["taken"] <= g["tokens"]).all() and (g["taken"] > 0).all()
    share = g.groupby("source")["taken"].sum() / g["taken"].sum()
    assert abs(share["aa"] - 0.7) < 1e-3 and abs(share["bb"] - 0.3) < 1e-3
    assert (g[g["taken"] < g["tokens"]].groupby("source").size() <= 1).all()
    assert sorted(mixed.collect()) == sorted(M.mix(sized, targets)[0].collect())
    assert {r["source"]: r["available"] for r in report.collect()}["empty"] == 0
    none, _ = M.mix(sized.limit(0), targets)
    assert none.count() == 0


def test_epochs_repeat_whole_documents(spark):
    sized = spark.createDataFrame([(1, "aa", 10), (2, "aa", 10), (3, "bb", 100), (4, "bb", 0)], "doc_id long, catalogue_id string, tokens long")
    targets = spark.createDataFrame([("aa", 0.5, 3), ("bb", 0.5, 1)], "source string, target_share double, max_repeats int")
    g = M.mix(sized, targets)[0].toPandas()
    assert (g[g["source"] == "aa"].groupby("doc_id")["taken"].sum() == 30).all() and g[g["source"] == "bb"]["taken"].sum() == 60


def check_pieces(text, capacity, overlap, enc):
    got = C.split_text(text, capacity, overlap, enc)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for (s, e, core, n, _), nxt in zip(got, [*got[1:], None]):
        assert len(enc.encode_ordinary(text[s:e])) == n <= capacity
        if nxt:
            assert nxt[2] == e and nxt[0] < e or overlap == 0
            assert abs(len(enc.encode_ordinary(text[nxt[0] : e])) - overlap) <= C.SLACK + 4
    return got


def test_pieces():
    enc = T.encoding(T.read_vocabulary())
    rng = random.Random(8)
    prose = "".join(" ".join(rng.choice(["harbour", "speech", "a", "window", "梯子坏了"]) for _ in range(rng.randint(4, 14))) + rng.choice([". ", "。", "!\n", ".\n\n", ", "]) for _ in range(400))
    for text in [prose, "零一二三四五六七八九" * 3000, "0123456789abcdef" * 3000, "😀👨‍👩‍👧" * 1500, "x" * 60_000, " " * 20_000, "a\r\nb\r\n" * 3000]:
        got = check_pieces(text, 128, 16, enc)
        assert got == check_pieces(text, 128, 16, enc)
    natural = [k for *_, k in check_pieces(prose, 256, 32, enc)[:-1]]
    assert set(natural) <= {"paragraph", "line", "sentence"}
    for text in [None, "", "short", "word " * 50]:
        assert C.split_text(text, 128, 16, enc) == []
    assert C.split_text("word " * 300, 128, 0, enc)[0][0] == 0


def test_edits_stay_local():
    enc = T.encoding(T.read_vocabulary())
    rng = random.Random(9)
    text = "".join(" ".join(rng.choice(["harbour", "speech", "a", "window", "ladder", "report"]) for _ in range(rng.randint(4, 14))) + ". " for _ in range(1500))
    other = text[: len(text) // 2] + " some inserted words here " + text[len(text) // 2 :]
    cores = lambda t: {t[c:e] for _, e, c, _, _ in C.split_text(t, 512, 64, enc)}
    a, b = cores(text), cores(other)
    assert len(a) > 40 and len(a - b) <= 6


def test_piece_query(spark):
    docs = documents(spark)
    got = C.split_documents(docs, [("piece_a", 200, 20), ("piece_b", 900, 0)])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = got.toPandas()
    assert len(rows) and all(texts[r.doc_id][r.start_char : r.end_char] == r.text for r in rows.itertuples())
    for (_, doc), g in rows.groupby(["limit_name", "doc_id"]):
        g = g.sort_values("piece_no")
        assert "".join(texts[doc][c:e] for c, e in zip(g["core_start"], g["end_char"])) == texts[doc]
    assert C.split_documents(docs.limit(0), [("piece_a", 200, 20)]).count() == 0 and C.split_documents(docs, []).count() == 0
