import random

from lakeloom.llm import split_overlap as O
from lakeloom.llm.minhash import band_keys, count_sketches

REF = "struct<dataset_id: string, version: string, split: string, cut_id: string, channel: array<int>, start: double, duration: double, purpose: string>"
REC = f"id string, task string, target string, dataset_id string, version string, split string, audio_slots array<struct<name: string, purpose: string, ref: {REF}>>, split_group string, named string"
CATALOG = "dataset_id string, version string, languages array<string>, aliases array<string>, provenance string, splits map<string, struct<artifacts: map<string, array<string>>, split_group: string>>"


def catalog(spark):
    groups = {"train": ({}, "train"), "dev": ({}, "validation"), "eval": ({}, "test"), "spare": ({}, None)}
    return spark.createDataFrame([("aa", "1", ["en"], ["alias-a"], "{}", groups)], CATALOG)


def record(rid, split, target=None, cut=None, span=(None, None), task="asr", name="primary", dataset="aa"):
    slots = [(name, None, ("aa", "1", split, cut, None, *span, None))] if cut else None
    return (rid, task, target, dataset, "1", split, slots, "clash", "clash")


def pairs(spark, rows, exact=False):
    return {tuple(sorted((r["train_id"], r["eval_id"]))) for r in O.cross_split_pairs(spark.createDataFrame(rows, REC), catalog(spark), exact).collect()}


def test_cut_names(spark):
    from pyspark.sql import functions as F

    names = {"cut-hdc-00x1": "cut-hdc-00x1", "hdc/CUT-HDC-00X1": "cut-hdc-00x1", "cut-hdc-00x1_sp1.1": "cut-hdc-00x1", "cut-hdc-00x1-ch1_vp0.83": "cut-hdc-00x1", " cut-hdc-00x1.flac ": "cut-hdc-00x1", "cut-hdc-00x11": "cut-hdc-00x11"}
    df = spark.createDataFrame([(k,) for k in names], "s string")
    assert {r[0]: r[1] for r in df.select("s", O.same_cut_id(F.col("s"))).collect()} == names


def test_audio(spark):
    rows = [record("t1", "train", cut="c1"), record("e1", "eval", cut="x/C1_sp0.9"), record("t2", "train", cut="c2", span=(0.0, 100.0)), record("e2", "dev", cut="c2", span=(90.0, 20.0)), record("e3", "dev", cut="c2", span=(91.0, 20.0)), record("e4", "dev", cut="c2"), record("t3", "train", cut="c2", span=(0.0, 0.0)), record("e5", "eval", cut="c1", name="enrollment"), record("s1", "spare", cut="c1"), record("t4", "train", cut="c1"), record("t1", "train", cut="c1"), record("e6", "eval", cut=None), record("e7", "eval", cut="c1", dataset=None), record("e8", "eval", cut="c9", span=(float("nan"), 1.0)), record("t9", "train", cut="c9", span=(float("inf"), float("nan")))]
    assert pairs(spark, rows) == {("e1", "t1"), ("e1", "t4"), ("e2", "t2"), ("e4", "t2"), ("e2", "t3"), ("e3", "t3"), ("e4", "t3")}


def test_spans_of_all_lengths(spark):
    """Against brute force, from a millisecond to weeks, on bucket edges, and beyond any recording."""
    rng = random.Random(8)
    spans = [(rng.choice([0, 60, 3840, 1e5, 245760, 3e6]) + rng.uniform(0, 5) * k, 10 ** rng.uniform(-3, 6.5)) for k in range(12) for _ in range(10)] + [(0.0, 2e9), (5e9, 3.0)]
    rows = [record(f"{'te'[i % 2]}{i}", "train" if i % 2 == 0 else "dev", cut="c", span=s) for i, s in enumerate(spans)]
    ms = [(round(s * 1000), round(s * 1000) + round(n * 1000)) if s < 1e9 and n < 1e9 else None for s, n in spans]
    want = set()
    for i, a in enumerate(ms):
        for j, b in enumerate(ms):
            if i % 2 == 0 and j % 2 and a and b:
                shared = min(a[1], b[1]) - max(a[0], b[0])
                if shared > 0 and 2 * shared >= min(a[1] - a[0], b[1] - b[0]):
                    want.add((f"e{j}", f"t{i}"))
    assert pairs(spark, rows) == want and len(want) > 100


def edited(text, n, rng):
    for _ in range(n):
        k = rng.randrange(len(text))
        text = rng.choice([text[:k] + text[k + 1 :], text[:k] + rng.choice("abc的") + text[k:], text[:k] + rng.choice("xyz西") + text[k + 1 :]])
    return text


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (x != y))
    return d[-1]


def test_text_against_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefghijklmnop没人知道松坪西那边为什么") for _ in range(rng.randint(35, 160))) for _ in range(40)]
    train = [(f"t{i:02d}", b) for i, b in enumerate(base)]
    test = [(f"e{i:02d}", edited(b, int(len(b) * rng.choice([0, 0.02, 0.04, 0.06, 0.15])), rng)) for i, b in enumerate(base)]
    test[0] = ("e00", base[0].upper().replace("A", " Ａ, "))
    rows = [record(i, "train", t, task=rng.choice(O.TEXT_TASKS)) for i, t in train] + [record(i, "eval", t) for i, t in test]
    rows += [record("t90", "train", base[1], task="speaker_attributed_asr"), record("e90", "eval", "too short"), record("e91", "eval", None), record("e92", "eval", "")]
    want = set()
    for i, a in train:
        for j, b in test:
            x, y = O.comparable(a), O.comparable(b)
            if min(len(x), len(y)) >= 40 and 10 * distance(x, y) <= max(len(x), len(y)):
                want.add((j, i))
    assert pairs(spark, rows) == want and len(want) > 20


def test_text_at_the_limit(spark):
    """Exactly a tenth of edits, spread evenly: the exact way finds all."""
    rng = random.Random(5)
    train = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in [40, 50, 90, 120, 400, 700] * 10]
    test = ["".join("0" if k % 10 == 5 else c for k, c in enumerate(t)) for t in train]
    over = ["".join("0" if k % 10 == 5 or k == 0 else c for k, c in enumerate(t)) for t in train]
    cut = ["".join(c for k, c in enumerate(t) if k % 10 != 5) for t in train if len(t) >= 50]
    rows = [record(f"{s}{i:02d}", "train" if s == "t" else "eval", t) for s, ts in (("t", train), ("e", test), ("o", over), ("c", cut)) for i, t in enumerate(ts)]
    at = [i for i, t in enumerate(train) if len(t) >= 50]
    assert pairs(spark, rows, exact=True) == {(f"e{i:02d}", f"t{i:02d}") for i in range(60)} | {(f"c{k:02d}", f"t{i:02d}") for k, i in enumerate(at)}


def test_recall_of_bands():
    """The share of pairs that meet in a bucket, by share of edits; spread evenly is the worst case."""
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.choice([40, 60, 110, 230, 400]))) for _ in range(600)]
    keys = band_keys(base)

    def met(other):
        return (keys == band_keys(other)).any(axis=1).mean()

    def scattered(t, share):
        at = set(rng.sample(range(len(t)), int(len(t) * share)))
        return "".join("0" if i in at else c for i, c in enumerate(t))

    got = {share: met([scattered(t, share) for t in base]) for share in (0.05, 0.07, 0.08, 0.09, 0.1)}
    even = met(["".join("0" if i % 10 == 5 else c for i, c in enumerate(t)) for t in base])
    print(got, even)
    assert got[0.05] == 1 and got[0.07] >= 0.995 and got[0.08] >= 0.99 and got[0.09] >= 0.98 and got[0.1] >= 0.95 and even >= 0.9


def test_sketches_rule_no_pair_out():
    rng = random.Random(12)
    for _ in range(300):
        t = "".join(rng.choice("abcdefg西坪") for _ in range(rng.randint(40, 300)))
        d = rng.randint(0, 12)
        a, b = (int(x) for x in count_sketches([t, edited(t, d, rng)]))
        apart = sum(min((x - y) % 16, (y - x) % 16) for x, y in (((a >> i) & 15, (b >> i) & 15) for i in range(0, 64, 4)))
        assert apart <= 2 * d


def test_report_counts_classes(spark):
    text = "the same sentence is in both splits and is long enough"
    rows = [record(f"t{i}", "train", text, cut="c1") for i in range(3)] + [record(f"e{i}", "eval", text + "s", cut="C1_sp0.9" if i else None) for i in range(2)] + [record("t0", "train", text, cut="c1")]
    reports = spark.createDataFrame([("r1", "alias-a", "1", True, ("raw", "x"), None), ("r2", "aa", "1", False, ("old", "x"), None)], "report_id string, dataset_id string, version string, passed boolean, inputs struct<source_data: string, source_data_sha256: string>, created_at timestamp")
    got = [r.asDict() for r in O.overlap_report(spark.createDataFrame(rows, REC), catalog(spark), reports).collect()]
    assert len(got) == 1 and got[0]["source_data"] == "raw" and 0.9 < got[0]["least_jaccard"] < 1
    assert [got[0][c] for c in ("eval_records", "train_records", "text_pairs", "audio_pairs")] == [2, 3, 6, 3]
    assert O.overlap_report(spark.createDataFrame([], REC), catalog(spark), reports.limit(0)).count() == 0


def test_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(O, "CELL_TEXTS", 3)
    test_text_at_the_limit(spark)


def test_copies_and_empties(spark):
    text = "the same sentence is in both splits and is long enough"
    rows = [record(f"t{i}", "train", text) for i in range(3)] + [record(f"e{i}", "eval", text + ".") for i in range(2)] + [record("t0", "train", text)]
    assert len(pairs(spark, rows)) == 6
    assert pairs(spark, []) == set()
    assert O.comparable("ＡＢ c_d-é1！") == "abcdé1" and O.comparable(None) == ""


def test_band_keys():
    k = band_keys(["abcdefgh" * 9, "abcdefgh" * 9, "zyxwvuts" * 9, "a", ""])
    assert (k[0] == k[1]).all() and not (k[0] == k[2]).any() and k.shape == (5, 64) and band_keys([]).shape == (0, 64)
