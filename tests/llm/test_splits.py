import random

import pytest
from pyspark.sql import functions as F

from lakeloom.llm import grouped_splits as G

CATALOG = "dataset_id string, version string, languages array<string>, aliases array<string>, provenance string"
REC = "id string, dataset_id string, source_record_id string, component string, spelled string"


def catalog(spark):
    return spark.createDataFrame([("aa", "1", ["zh"], ["a-alias"], "{}"), ("bb", "1", ["en"], [], "{}")], CATALOG)


def plan(spark):
    return spark.createDataFrame([("train", 0.9), ("validation", 0.05), ("test", 0.05)], "split_name string, target_share double")


def records(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], REC)


def test_codes(spark):
    ids = {"K000007_U12": ["K000007"], "k7_u1": ["K000007"], "wav/R18/R000018_U2.flac": ["R000018"], "F000109-3-28073": ["F000109"], "cabin_road_v0:D000111_U57": ["D000111"], "H1_U2#sp1.1": ["H000001"], "sim|v2|K1_K0002_72598|w28": ["K000001", "K000002"], "1spk|mix|g118_76668|w18": ["G000118"], "U5_U6": [], "": [], "x": [], "|": [], "mix|K1234567_9|w": ["K1234567"]}
    df = spark.createDataFrame([(k,) for k in ids], "s string").select("s", G.speaker_codes(F.col("s")).alias("c"))
    assert {r["s"]: r["c"] for r in df.collect()} == ids
    assert spark.createDataFrame([(None,)], "s string").select(G.speaker_codes(F.col("s")).alias("c")).first()[0] is None


def test_groups_and_splits(spark):
    rows = [("1", "aa", "K1_U1"), ("2", "A-ALIAS", "k0001_u9"), ("3", "aa", "mix|K2_K1_5|w"), ("4", "aa", "mix|K3_K2_5|w"), ("5", "bb", "K1_U1"), ("6", "aa", None), ("7", "aa", ""), ("8", None, "K1_U1"), ("9", "aa", "K9_U1"), ("1", "aa", "K1_U1"), (None, "aa", "K1_U1")]
    got = {r["id"]: r for r in G.assign_splits(records(spark, rows), catalog(spark), plan(spark), bins=4).collect()}
    assert set(got) == {str(k) for k in range(1, 10)}
    assert {got[k]["group_key"] for k in "1234"} == {"aa:K000001"} and got["5"]["group_key"] == "bb:K000001" and got["9"]["group_size"] == 1
    assert not got["6"]["related"] and not got["8"]["related"] and got["6"]["group_key"] == "record:6"
    assert len({got[k]["split"] for k in "1234"}) == 1


def test_shares_with_a_giant_group(spark):
    rng = random.Random(2)
    rows = [(f"g{i}", "aa", "K1_U1") for i in range(700)] + [(f"r{i}", "bb", f"M{rng.randrange(600)}_U{i}") for i in range(1400)]
    df = G.assign_splits(records(spark, rows), catalog(spark), plan(spark), shard_components=40, merged=3)
    got = {r["split"]: r["n"] for r in df.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert sum(got.values()) == 2100 and df.select("id").distinct().count() == 2100
    assert abs(got["train"] - 1890) <= 15 and abs(got["test"] - 105) <= 15 and abs(got["validation"] - 105) <= 15
    assert df.groupBy("group_key").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0


def test_empty_and_bad_plans(spark):
    assert G.assign_splits(records(spark, []), catalog(spark), plan(spark)).count() == 0
    with pytest.raises(ValueError):
        G.assign_splits(records(spark, []), catalog(spark), plan(spark).limit(0))


def test_differencing_balances():
    rng = random.Random(1)
    weights = [rng.randint(1, 1000) for _ in range(500)]
    bins = G.largest_differencing(weights, 7)
    sums = [sum(w for w, b in zip(weights, bins) if b == k) for k in range(7)]
    assert max(sums) - min(sums) <= 5
    assert G.largest_differencing([], 3) == [] and sorted(G.largest_differencing([5, 5, 5], 3)) == [0, 1, 2]
    assert G.allocate_bins([10, 1, 1], [("a", 0.8), ("b", 0.2)]) == ["a", "b", "b"]
