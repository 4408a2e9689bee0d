"""Sampling, scenes, clusters, components, streams and files."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.operators import sampling as S
from lakeloom.operators import scenes as C
from lakeloom.operators import similarity as Y
from lakeloom.operators import timeline as L
from lakeloom.operators import versioning as V
from lakeloom.operators.components import connected_components
from lakeloom.sources import files as R
from lakeloom.sources import sinks as K
from lakeloom.streaming import tail as Z


def test_rotation_visits_everything(spark):
    rows = S.numbered(spark.range(8).select(F.col("id"), F.lit("a").alias("src")), "src", ["id"])
    seen = [sorted(r["id"] for r in S.rotated(rows, F.lit(3), F.lit(2), e).collect()) for e in range(3)]
    assert all(len(s) == 6 for s in seen) and {x for s in seen for x in s} == set(range(8))


def test_replay_without_replacement(spark):
    q = spark.createDataFrame([("a", 3, 5), ("b", 2, 40)], "source string, quota int, n long")
    pos = S.replay_positions(q, 5, 0).collect()
    a = [(r["cycle"], r["offset"]) for r in pos if r["source"] == "a"]
    assert sorted(a) == [(c, o) for c in range(3) for o in range(5)]
    full = S.replay_positions(q, 2, 3, full=True).where("source = 'a'").collect()
    assert min(r["cycle"] for r in full) == 6


def test_batches(spark):
    costs = [0.2, 0.8, 1.8] * 8
    rows = spark.createDataFrame([(f"r{i:02d}", i / 100, 1 + i % 2, c) for i, c in enumerate(costs)], "id string, at double, slots int, cost double")
    for df, padded in ((S.sorted_batches(rows, 100, 4.1, 5), True), (S.bucket_batches(rows, 100, 3, 4.1, 5), False)):
        got = df.toPandas()
        assert sorted(got["id"]) == sorted(f"r{i:02d}" for i in range(24))
        for _, g in got.groupby(["slots", "buffer", "bin", "batch"]):
            assert len(g) <= 5 and (g["cost"].max() * len(g) if padded else g["cost"].sum()) <= 4.1 + 1e-9


def test_tail_and_ranks(spark):
    b = spark.range(5).select(F.col("id").alias("position"), F.col("id").alias("x"))
    got = {r["position"]: r["x"] for r in S.with_tail(b, 4, False).collect()}
    assert got == {**{i: i for i in range(5)}, 5: 0, 6: 1, 7: 2}
    assert S.with_tail(b, 4, True).count() == 4
    assert {r["position"]: r["x"] for r in S.with_tail(b.limit(1), 4, False).collect()} == {0: 0, 1: 0, 2: 0, 3: 0}
    assert S.migrated_cursor(30, 4, 8) == 15 and S.advance_cursor(2, 5, 5, "s", "s") == (3, 0)
    with pytest.raises(ValueError):
        S.migrated_cursor(30, 4, 7)


def test_scene_functions():
    assert C.whole_conversations([3, 2, 4], 5) == [0, 1] and C.whole_conversations([6, 7], 5) == [0] and C.whole_conversations([1], 5) == []
    assert C.quiet_cuts(np.array([5, 4, 3, 1, 4, 5, 0, 5, 5, 5, 9.0]), 3, 1) == [3, 6, 8]
    plan = C.fill_template([(0.0, 4.0, 20), (6.0, 6.5, 1)], np.array([2.0, 2.1, 0.4]), np.array([10, 9, 1]), 10.0)
    assert [(k, i) for k, i, _ in plan] == [(0, 1), (0, 0), (1, 2)]
    assert C.error_components([("a", 0, 10)], [("x", 0, 6), ("y", 8, 12)]) == (2, 2, 2, 10)
    assert C.error_components([], [("x", 0, 5)]) == (0, 5, 0, 0)


def test_gap_windows(spark):
    t = spark.createDataFrame([("w", i, s, e) for i, (s, e) in enumerate([(0, 10), (5, 20), (30, 40), (50, 300), (310, 320)])], "window_id string, turn_id long, s long, e long")
    got = [(r["s"], r["e"], r["periods"]) for r in C.gap_windows(t, 45).orderBy("s").collect()]
    assert got == [(0, 40, 2), (50, 300, 1), (310, 320, 1)]
    got = [(r["s"], r["e"], r["periods"]) for r in C.gap_windows(t, 45, anchor=20).orderBy("s").collect()]
    assert got == [(0, 20, 1), (30, 40, 1), (50, 300, 1), (310, 320, 1)]


def test_clusters():
    s = np.array([[1, 0.9, 0.1, 0.2], [0.9, 1, 0.2, 0.1], [0.1, 0.2, 1, 0.8], [0.2, 0.1, 0.8, 1]])
    assert Y.link_clusters(s, 0.5) == [0, 0, 1, 1]
    cannot = np.zeros((4, 4), bool)
    cannot[0, 1] = cannot[1, 0] = True
    assert Y.link_clusters(s, 0.5, cannot) == [0, 1, 2, 2]
    assert Y.two_stage_clusters(s, np.array([9, 9, 9, 0.1]), 0.85, 0.5, 0.1) == [0, 0, 1, 1]


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 8)).astype("float32")
    rows = [(i, x[i].tolist() if i else None, i % 4) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v array<float>, label int")
    got = {(r["id"], r["rank"]): r["neighbour"] for r in Y.cosine_top_k(df, df, 3, 0.6, blocks=4).collect()}
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = np.round(y.astype(float) @ y.astype(float).T, 6)
    for i in range(1, 60):
        ok = sorted((-c[i, j], j) for j in range(1, 60) if j % 4 != i % 4 and c[i, j] < 0.6)[:3]
        assert [got.get((i, k + 1)) for k in range(len(ok))] == [j for _, j in ok]
    assert all(k[0] for k in got)


def test_components(spark):
    edges = [("b", "a"), ("b", "c"), ("x", "y"), ("y", "x"), ("q", "q"), (None, "a")] + [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("hub", f"h{i}") for i in range(80)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got["c"] == got["b"] == got["a"] == "a" and got["y"] == "x" and "q" not in got
    assert {got[f"n{i:03d}"] for i in range(61)} == {"n000"} and {got[f"h{i}"] for i in range(80)} == {"h0"}
    assert connected_components(spark.createDataFrame([], "u string, v string")).count() == 0


def test_layers(spark):
    parent = spark.createDataFrame([("1", "en", "x"), ("2", "de", "y")], "id string, language string, target string")
    layer = spark.createDataFrame([("1", "keep", {"language": "zh", "target": None}), ("2", "delete", {})], "id string, status string, changes map<string,string>")
    layer = layer.withColumn("patch_hash", V.patch_hash(F.col("id"), F.col("status"), F.col("changes")))
    assert V.layer_errors(layer, parent).count() == 0
    assert [tuple(r) for r in V.apply_layer(parent, layer, ["language", "target"]).collect()] == [("1", "zh", None)]
    bad = layer.withColumn("patch_hash", F.lit("0"))
    assert {r["error"] for r in V.layer_errors(bad, parent).collect()} == {"hash"}


def test_files_round_trip(spark, tmp_path):
    rec = {"schema_version": "1", "id": "a", "task": "asr", "audio_slots": [{"name": "primary", "purpose": None, "ref": {"cut_id": "c", "start": 0.0, "duration": 1.0}}], "target": "hi", "language": "en", "hotwords": ["x"]}
    p = tmp_path / "r.jsonl.gz"
    with gzip.open(p, "wt") as f:
        f.write(json.dumps(rec) + "\n\n" + json.dumps(rec | {"id": "b"}) + "\n")
    rows = R.read_records(spark, str(p))
    assert rows.count() == 2
    K.write_jsonl(rows, str(tmp_path / "out"))
    assert rows.exceptAll(R.read_records(spark, str(tmp_path / "out"))).count() == 0
    m = K.import_jsonl(spark, str(p), str(tmp_path / "v" / "1"), R.RECORD_SCHEMA)
    assert m["rows"] == 2 and K.open_version(spark, str(tmp_path / "v" / "1"), m["schema"]).count() == 2
    with pytest.raises(ValueError):
        K.open_version(spark, str(tmp_path / "v" / "1"), "0")
    with pytest.raises(ValueError):
        K.publish(rows.unionByName(rows), str(tmp_path / "v" / "x"))
    assert K.compact(spark, str(tmp_path / "v" / "1"), str(tmp_path / "v" / "2"), 1)["total"] == m["total"]
    assert K.mirror(spark, str(tmp_path / "v" / "1"), str(tmp_path / "m")) and not K.mirror(spark, str(tmp_path / "v" / "1"), str(tmp_path / "m"))
    assert K.cleanup(spark, str(tmp_path / "v"), {"2"}) == ["1"]
    assert K.export_cuts(rows, str(tmp_path / "cuts")) == 2
    K.write_report(rows.select("id"), str(tmp_path / "report"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "report" / "markdown")).collect()][0] == "2 findings"
    K.write_status(spark, str(tmp_path / "s.json"), {"a": 1})
    K.write_status(spark, str(tmp_path / "s.json"), {"a": 2})
    assert K.copy_confirmed(spark, str(tmp_path), str(tmp_path / "c"), ["s.json"]) == 1 == K.copy_confirmed(spark, str(tmp_path), str(tmp_path / "c"), ["s.json"])
    assert (tmp_path / "c" / "s.json").read_text() == '{"a": 2}'
    (tmp_path / "bad.jsonl").write_text("{bad\n")
    with pytest.raises(Exception):
        R.read_records(spark, str(tmp_path / "bad.jsonl")).collect()


def test_declarations_and_logs(spark, tmp_path):
    d = tmp_path / "decl"
    d.mkdir()
    (d / "b.jsonl").write_text('# note\n\n{"dataset_id": "x", "version": "1"}\n')
    (d / "a.txt").write_text("no")
    assert [r["line"] for r in R.load_catalog(spark, str(d), "dataset_id string, version string").collect()] == [3]
    (d / "c.jsonl").write_text("{\n")
    with pytest.raises(Exception, match="c.jsonl:1"):
        R.load_catalog(spark, str(d), "dataset_id string").collect()
    log = tmp_path / "log"
    log.write_text('{"k": 1}\n{"k": 2}\n{"k": ')
    assert sorted(r["k"] for r in R.read_log(spark, str(log), "k int").collect()) == [1, 2]
    assert Z.whole_lines("a\nb\nc") == ["a", "b"]
    (tmp_path / "rooms").write_text("# id t60\nr1 0.4\nbad\nr2 0.5 x\n")
    assert [tuple(r) for r in R.read_spaced(spark, str(tmp_path / "rooms"), ["id", "t60"]).collect()] == [("r1", "0.4"), ("r2", "0.5")]
    (tmp_path / "k.jsonl").write_text('{"k": 1}\n{"k": 1}\n')
    with pytest.raises(ValueError):
        R.read_unique(spark, str(tmp_path / "k.jsonl"), "k int", ["k"])
    assert R.folder_nodes(spark, str(d)).count() == 3 and R.file_digests(spark, str(d)).where("length(sha256) = 64").count() == 3


def test_preview_schedule(spark, tmp_path):
    spark.createDataFrame([(1, 0.0), (1, 1.0), (1, 1.6), (1, 1.7), (1, 3.2), (2, 5.0)], "session long, at double").coalesce(1).write.parquet(str(tmp_path / "s"))
    got = sorted(tuple(r)[:2] for r in Z.drain(Z.preview_schedule(Z.stream(spark, str(tmp_path / "s")))).collect())
    assert got == [(1, 0.0), (1, 1.6), (1, 3.2), (2, 5.0)]


def test_batches_are_written_once(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        Z.consumed_batches(Z.stream(spark, str(tmp_path / "in")), F.floor(F.col("id") / 4), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_ordered_positions(spark):
    from lakeloom.operators.ordering import ordered_positions

    rows = [("a" if i % 3 else None if i % 2 else "b", (i * 37) % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, v int, id long").repartition(8)
    got = {r["id"]: r["ix"] for r in ordered_positions(df, ["g"], ["v", "id"]).collect()}
    for g in ("a", "b", None):
        order = [i for x, v, i in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))]
        assert [got[i] for i in order] == list(range(len(order)))
    assert sorted(r["ix"] for r in ordered_positions(df, [], ["id"]).collect()) == list(range(1000))
    assert ordered_positions(df.limit(0), ["g"], ["id"]).count() == 0


def test_named_functions(spark):
    from lakeloom.functions import alignment, registry

    registry.register(spark)
    assert spark.sql("select unit_accuracy('a b', 'a c') as x, token_edits('a b', 'b') as y").first() == (0.5, 1)
    rows = spark.sql("select * from parse_turns('[S1][0.00-2.50] hi\nbad\n[S12][3-4] yo')").collect()
    assert [tuple(r) for r in rows] == [(1, 0.0, 2.5, "hi"), (12, 3.0, 4.0, "yo")]
    assert alignment.sounds_like("ab", "xcb", {"c": "a"}) == 1.0 and alignment.sounds_like("abc", "a", {}) == 0.0


def test_declared_sources():
    from lakeloom.operators import config

    assert config.checked([{"name": "a"}])[0]["reps"] == 1
    for bad in ([], [{"name": "a", "odd": 1}], [{"name": "a"}, {"name": "a"}], [{"name": "a", "weight": 1}, {"name": "b"}], [{"name": "a", "weight": 0}], [{"name": "a", "weight": 1, "samples": 2}]):
        with pytest.raises(ValueError):
            config.checked(bad)


def test_command_line(spark, tmp_path, capsys):
    from lakeloom import cli

    assert cli.main(["list"]) == 0 and "p2_found" in capsys.readouterr().out
    spark.createDataFrame([("a", 1)], "id string, x int").write.parquet(str(tmp_path / "t" / "1"))
    assert cli.main(["compact", str(tmp_path / "t" / "1"), str(tmp_path / "t" / "2"), "--files", "1"]) == 0
    assert cli.main(["cleanup", str(tmp_path / "t"), "--keep", "2"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"deleted": ["1"]}


def test_integrity(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x").write_text("abc")
    d = R.file_digests(spark, str(tmp_path / "f")).cache()
    path, n, sha = d.first()
    want = spark.createDataFrame([(path, 3, sha), (path + "y", 1, "0")], "path string, expected_bytes long, sha256 string")
    assert [tuple(r) for r in R.integrity_errors(d, want).collect()] == [(path + "y", "missing")] and R.tree_digest(d).first()["files"] == 1


def test_char_error_rate_of_any_script(spark):
    from lakeloom.functions import text as X
    from lakeloom.functions.alignment import edit_distance

    rows = [("阿布", "阿卡啊"), ("", ""), ("x", ""), ("", "äö"), ("😀a", "😀b"), (None, "a"), ("a" * 500, "a" * 499 + "b")]
    df = spark.createDataFrame(rows, "hyp string, ref string").select("hyp", "ref", X.char_error_rate(F.col("hyp"), F.col("ref")).alias("c"))
    for r in df.collect():
        want = None if r["hyp"] is None else edit_distance(list(r["ref"]), list(r["hyp"])) / len(r["ref"]) if r["ref"] else float(bool(r["hyp"]))
        assert r["c"] == want


def test_similar_starts(spark):
    """The most similar turn wins over the nearest; short turns, low similarity and far starts have none."""
    a, b = "the lantern from baregate", "the lantern from baregata"
    ref = [(1, "w", 1000, a), (2, "w", 1000, "short one"), (3, "w", 9000, a), (4, "v", 1000, a), (5, "w", 1000, "zzzzqqqqxxxxjjjj"), (6, "w", 5000, None), (7, "w", 2499, a)]
    hyp = [(11, "w", 1010, "something else entirely"), (12, "w", 2400, b), (13, "w", -400, a), (14, "w", 7500, a), (15, "w", 1005, None), (16, "w", 1005, "short one"), (17, "w", 2450, b)]
    cols = "turn_id long, window_id string, s long, text string"
    found = {(r["turn_id"], r["match"], r["off"]) for r in L.similar_starts(spark.createDataFrame(ref, cols), spark.createDataFrame(hyp, cols)).collect()}
    assert found == {(1, 13, -1400), (7, 12, -99)}


def test_source_draws_cover_every_record(spark):
    from lakeloom.plans import sampling, views

    sf = "/root/testdata/sf0.001"
    drawn = {r["id"]: r["source"] for r in sampling.source_draws(spark, sf).collect()}
    assert set(drawn) == {r["id"] for r in views.records(spark, sf).select("id").collect()}


def test_names_are_the_catalogues(spark):
    from lakeloom.plans import sampling, views

    sf = "/root/testdata/sf0.01"
    known = {r[0] for r in spark.read.parquet(f"{sf}/dataset_catalog.parquet").select("dataset_id").collect()}
    assert {r[0] for r in views.records(spark, sf).select("dataset_id").distinct().collect()} <= known | {None}
    assert sampling.weighted_mux(spark, sf).count() == views.records(spark, sf).count()


def test_checked_lookup(spark):
    from lakeloom.operators.relations import checked_lookup

    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, x int")
    ask = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    assert [tuple(r) for r in checked_lookup(ask("b", "b"), rows, "id").collect()] == [("b", 2)]
    with pytest.raises(KeyError, match="gone"):
        checked_lookup(ask("a", "gone"), rows, "id")


def test_cohort_decisions_against_the_definition(spark):
    rng = np.random.default_rng(4)
    rows, want = [(900, None, 0), (901, None, 7)], {}
    for label, n in enumerate([2, 3, 4, 8, 9, 7]):
        x = np.array([1.0, 0, 0, 0]) + rng.normal(0, 0.25 + 0.1 * label, (n, 4))
        x[: n // 4] = rng.normal(0, 1, (n // 4, 4))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        sim = np.rint(x @ x.T * 10_000) / 10_000
        rows += [(100 * label + i, x[i].tolist(), label) for i in range(n)]
        cohort = []
        if n >= 3:
            scores = sim.copy()
            np.fill_diagonal(scores, np.nan)
            medoid = int(np.nanargmax(np.nanmedian(scores, axis=1)))
            cohort = [i for i in range(n) if sim[medoid, i] >= 0.65]
        for i in range(n):
            refs = [j for j in cohort if j != i]
            ok = len(cohort) >= 3 and len(cohort) >= 0.6 * n and len(refs) >= 2 and np.median(sim[i, refs]) >= 0.65 and (sim[i, refs] >= 0.65).sum() >= 2
            want[label, 100 * label + i] = (i in cohort, bool(ok))
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    found = Y.cohort_decisions(df, df, df).collect()
    assert {(r["label"], r["id"]): (r["in_cohort"], r["passed"]) for r in found} == want
    assert len({ok for _, ok in want.values()}) == 2


def test_timelines_across_shards(spark, monkeypatch):
    """Islands, activity, gaps and overlaps with shards far shorter than the spans, against sweeps over all units."""
    from lakeloom.operators import timeline as L

    rng = np.random.default_rng(9)
    rows = [(w, f"S{rng.integers(1, 3)}", i, int(s), int(s + n)) for w in ("a", "b") for i, (s, n) in enumerate(zip(rng.integers(-30, 400, 60), rng.choice([1, 2, 5, 40, 90], 60)))]
    t = spark.createDataFrame(rows, "window_id string, speaker string, turn_id int, s long, e long")
    monkeypatch.setattr(L, "SHARD", 16)
    on = {w: {x for v, _, _, s, e in rows if v == w for x in range(s, e)} for w in ("a", "b")}
    for shard in (16, None):
        got = [(r["window_id"], r["s"], r["e"]) for r in L.islands(t, ["window_id"], shard).collect()]
        assert {w: {x for v, s, e in got if v == w for x in range(s, e)} for w in on} == on
        assert all(s - 1 not in on[w] and e not in on[w] for w, s, e in got)
    active = {(r["window_id"], r["s"]): (r["e"], r["active"]) for r in L.active_spans(t, ["window_id"]).collect()}
    for (w, s), (e, n) in active.items():
        assert all(sum(a <= x < b for v, _, _, a, b in rows if v == w) == n for x in range(s, e))
    assert sum(e - s for (w, s), (e, n) in active.items() if n) == sum(map(len, on.values()))
    order = {w: sorted((s, e, i, who) for v, who, i, s, e in rows if v == w) for w in on}
    assert sorted((r["window_id"], r["gap"]) for r in L.speaker_change_gaps(t).collect()) == sorted((w, y[0] - x[1]) for w, o in order.items() for x, y in zip(o, o[1:]) if x[3] != y[3])
    late = {(w, i) for w, o in order.items() for k, (s, e, i, who) in enumerate(o) if any(b > s for a, b, _, p in o[:k] if p == who)}
    assert {(r["window_id"], r["turn_id"]) for r in L.self_overlaps(t).collect()} == late
    total = L.running_total(t, ["window_id"], F.floor(F.col("turn_id") / 7), F.col("turn_id"), F.col("e") - F.col("s"), "before")
    assert {(r["window_id"], r["turn_id"]): r["before"] for r in total.collect()} == {(w, i): sum(e - s for v, _, j, s, e in rows if v == w and j < i) for w, _, i, _, _ in rows}


def test_diarization_across_shards(spark):
    rng = np.random.default_rng(10)
    spans = lambda: [(f"S{rng.integers(1, 4)}", int(s), int(s + n)) for s, n in zip(rng.integers(0, 900, 25), rng.integers(1, 120, 25))]
    ref, hyp = spans(), spans()
    rows = [("ref", "w", *x) for x in ref] + [("hyp", "w", *x) for x in hyp] + [("hyp", "v", "S1", 0, 10)]
    df = spark.createDataFrame(rows, "side string, window_id string, speaker string, s long, e long")
    for collar in (0, 7):
        got = {r["window_id"]: tuple(r)[1:] for r in C.diarization(df, collar, shard=50).collect()}
        assert got == {"w": C.error_components(ref, hyp, collar), "v": (0, 10, 0, 0)}


def test_meeting_plans(spark):
    """Each template is filled in its own time with material of its group, none twice in one template."""
    t = spark.createDataFrame([(f"w{i}", f"S{k}", j * 1000, j * 1000 + 600, 10) for i in range(30) for k in (1, 2) for j in range(5)], "window_id string, speaker string, s long, e long, chars int")
    m = spark.createDataFrame([(1 + i % 2, i, 1.0 + i % 7, 9) for i in range(200)], "grp int, utt long, duration double, chars int")
    got = C.meeting_plans(t, m, shard=40, templates=5).toPandas()
    assert got.groupby(["window_id", "speaker"]).ngroups == 60 and not got.duplicated(["window_id", "speaker", "utt"]).any()
    assert ((got["utt"] % 2 + 1) == got["speaker"].str[1:].astype(int)).all() and (got["start"] >= got["turn"] * 10).all()
    assert C.meeting_plans(t, m.limit(0)).count() == 0


def test_quantiles_and_bootstrap(spark):
    from lakeloom.operators import inference as I
    from lakeloom.operators.ordering import quantiles

    rows = spark.createDataFrame([("a", float(x)) for x in [5, 1, 4, 4, 9]] + [("b", None), ("c", 7.0), (None, 1.0), (None, 2.0)], "g string, v double")
    assert {r["g"]: (r["q0"], r["q1"]) for r in quantiles(rows, ["g"], "v", [0.5, 0.9]).collect()} == {"a": (4.0, 7.4), "c": (7.0, 7.0), None: (1.5, 1.9)}
    assert quantiles(rows.limit(0), [], "v", [0.5]).first()["q0"] is None
    rng = np.random.default_rng(3)
    diff = rng.normal(0.1, 1, 400)
    k = spark.createDataFrame([(i, float(x), 1.0) for i, x in enumerate(diff)], "key int, diff double, n double")
    r = I.paired_bootstrap(k, 300, 5).first()
    half = 1.96 * diff.std() / 20
    assert abs(r["difference"] - diff.mean()) < 1e-9 and abs(r["low"] - (diff.mean() - half)) < 0.03 and abs(r["high"] - (diff.mean() + half)) < 0.03


def test_record_sources_reach_the_end(spark, tmp_path):
    from lakeloom.plans.timeline import record_sources

    rows = spark.range(4500).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") < 3200, "a").when(F.col("id") < 4000, "b").otherwise("c").alias("dataset_id"))
    rows.write.parquet(f"{tmp_path}/audio_records.parquet")
    spark.read.parquet("/root/testdata/sf0.001/dataset_catalog.parquet").write.parquet(f"{tmp_path}/dataset_catalog.parquet")
    assert sorted(map(tuple, record_sources(spark, str(tmp_path)).collect())) == [(0, "a", 0), (1000, "a", 1000), (2000, "a", 2000), (3000, "a", 3000), (4000, "c", 0)]


def test_voice_ranks_of_all_datasets(spark):
    from lakeloom.plans import relations, views

    sf = "/root/testdata/sf0.01"
    rows = relations.dataset_voice_ranks(spark, sf).collect()
    assert {r["dataset_id"] for r in rows} == {r[0] for r in views.turns(spark, sf).where("speaker is not null").select("dataset_id").distinct().collect()}
    assert len({(r["dataset_id"], r["g"], r["k"]) for r in rows}) == len(rows)


def test_attribution_kinds():
    """Where each turn's text went, on hand-made outputs."""
    from lakeloom.operators import attribution as T

    def turn(k, who, at, text):
        return T.Turn(k, who, float(at), at + 3.0, list(text))

    ref = [turn(1, "S1", 0, "abcdefghij" + "0123456"), turn(2, "S2", 5, "klmnopqrst"), turn(3, "S1", 10, "uvwxyzabcd"), turn(4, "S3", 15, "efghijklmn")]
    same = T.attributed(ref, [t._replace(speaker={"S1": "A", "S2": "B", "S3": "C"}[t.speaker]) for t in ref])
    assert all(x.text_edits == x.speaker_edits == 0 and x.kind is None and not x.overlapped for x in same)
    hyp = [turn(1, "A", 0, "abcdefghij" + "0123456"), turn(2, "B", 5, "klmnopqrst"), turn(3, "D", 10, "uvwxyzabcd"), turn(4, "B", 15, "efghijklmn")]
    got = {x.key: x for x in T.attributed(ref[:3], hyp[:3])}
    assert got[3].kind == "split" and got[3].speaker_edits == 10 and got[3].text_edits == 0
    got = {x.key: x for x in T.attributed(ref, [hyp[0], hyp[1], hyp[2]._replace(speaker="A"), hyp[3]])}
    assert got[4].kind == "merged" and got[4].speaker_edits == 10 and got[3].kind is None
    swapped = [turn(1, "A", 0, "abcdefghij" + "0123456"), turn(2, "B", 5, "klmnopqrst"), turn(3, "B", 10, "uvwxyzabcd"), turn(4, "C", 15, "efghijklmn")]
    assert {x.key: x.kind for x in T.attributed(ref, swapped)}[3] == "swap"
    assert {x.key: (x.kind, x.text_edits) for x in T.attributed(ref, swapped[:3])}[4] == (None, 10)
    assert T.attributed([], swapped) == [] and T.attributed(ref[:1], [])[0].text_edits == 17
    over = T.attributed([turn(1, "S1", 0, "abcd"), turn(2, "S2", 1, "efgh")], [])
    assert all(x.overlapped for x in over)


def test_output_categories():
    from lakeloom.operators.attribution import output_category as kind

    assert kind("嗯嗯", "嗯嗯", "", "嗯啊") == "filler" and kind("abcdef", "xxabcdefxx", "abc", "") == "words of others"
    assert kind("abcdef", "ab", "abcd", "") == "words from elsewhere" and kind("abcd", "", "", "") == "short" and kind("abcdefgh", "zz", "yy", "") == "unrelated"


def test_attribution_and_wrong_speakers(spark):
    from lakeloom.operators import attribution as T

    schema = "turn_id long, window_id string, speaker string, s long, e long, text string"
    ref = spark.createDataFrame([(1, "w", "S1", 0, 300, "ab cd ef gh"), (2, "w", "S2", 100, 400, "ij kl mn op"), (3, "w", "S1", 90_000, 90_300, "qr st uv wx"), (4, "w", None, 0, 9, "x"), (5, "w", "S1", 0, 9, None)], schema)
    hyp = spark.createDataFrame([(1, "w", "S1", 0, 300, "ij kl mn op"), (2, "w", "S2", 100, 400, "ij kl mn op"), (3, "w", "S1", 90_000, 90_300, "")], schema)
    got = {r["turn_id"]: r for r in T.attribution(ref, hyp).collect()}
    assert set(got) == {1, 2, 3} and got[2]["speaker_edits"] == 0 and got[3]["text_edits"] == 4 and got[1]["overlapped"] and not got[3]["overlapped"]
    wrong = {r["turn_id"]: r["other"] < r["own"] for r in T.wrong_speakers(ref, hyp).collect()}
    assert wrong == {1: True, 2: False}
    assert T.attribution(ref.limit(0), hyp).count() == 0


def test_alphabetic_hotwords():
    from lakeloom.functions import alignment as A

    assert A.alphabetic_hotwords(["Nagashino", "Verdun", "go", "of"], "the battle of nagasheno began") == ["of", "Nagashino"]
    assert A.alphabetic_hotwords(["go"], "a gho appeared") == [] and A.alphabetic_hotwords(["a", "b"], " ") == ["a", "b"]
    flat = [f"xy{c}zw" for c in "abcdefghijk"]
    assert A.alphabetic_hotwords(flat, "xylzw there") == []
    assert A.partial_similarity("abcd", "xxabcdyy") == 1.0 and A.partial_similarity("", "a") == 0.0
    assert A.content_share("the of", "the of it") == 1.0 and A.content_share("the end", "an end") == 1.0
    assert A.context_score(["gold", "alt", "other", "gold"]) == 0.25 and A.context_score([]) is None
    assert A.target_outcome(list("abcd"), list("abxd"), 2, 3, ["x"]) == "alt" and A.target_outcome(list("abcd"), list("abd"), 2, 3, ["x"]) == "other"


def test_text_rules(spark):
    """Presence, hotword reward, units and loops by their rules, empty and missing cases among them."""
    from lakeloom.functions import alignment as A
    from lakeloom.functions import text as X

    df = spark.createDataFrame([("", ""), ("a", ""), ("", "b"), ("a", "b"), ("...", "!")], "h string, r string")
    assert [r[0] for r in df.select(X.presence(X.units(F.col("h")), X.units(F.col("r")))).collect()] == [1, -1, -1, 0, 1]
    rows = [("don't stop", "don't stop", ["don't"], 1.0), ("hello", "hello", ["world"], 1.0), ("hello world", "hello", ["world"], 0.0), ("cats", "cats", ["cat"], 1.0), ("x", "new york", ["york", "x"], -1.0), ("x", "y", [], None), ("x", "y", ["N/A"], None), ("x", "y", None, None), ("我爱北京", "我爱北京", ["北京", "上海"], 1.0)]
    df = spark.createDataFrame([r[:3] for r in rows], "h string, r string, w array<string>")
    assert [r[0] for r in df.select(X.hotword_reward(F.col("h"), F.col("r"), F.col("w"))).collect()] == [r[3] for r in rows]
    assert A.units("Don't do 北京 it's") == ["don't", "do", "北", "京", "it's"]
    loops = spark.createDataFrame([("\n" * 40,), ("ab" * 25,), ("ok",)], "t string")
    assert [r[0] for r in loops.select(F.col("t").rlike(X.DEGENERATE)).collect()] == [True, True, False]


def test_merged_batches(spark):
    b = spark.createDataFrame([(i, float(i * 7 % 10), f"{i:03d}") for i in range(21)], "k int, longest double, o string")
    got = {r["k"]: (r["step"], r["place"]) for r in S.merged_batches(b, "k", F.col("longest"), F.col("o"), 2, 8).collect()}
    assert len(got) == 21 and {got[k][0] // 4 for k in range(8)} == {0}
    steps = [sorted(i * 7 % 10 for i in range(8))[j : j + 2] for j in range(0, 8, 2)]
    assert [sorted(k * 7 % 10 for k in range(8) if got[k][0] == s) for s in range(4)] == steps
    with pytest.raises(ValueError):
        S.merged_batches(b, "k", F.col("longest"), F.col("o"), 3, 8)


def test_enrolment_signals():
    from lakeloom.operators import waveform as G

    x = np.sin(np.arange(100.0))
    assert len(G.cropped(x, 0.0, 30)) == 30 and (G.cropped(x, 0.999, 30) == x[70:]).all() and G.cropped(x, 0.5, 200) is x
    dirty = G.contaminated(x, np.ones(400), 0.25, 0.0)
    scale = dirty[1] / x[1]
    assert np.allclose(dirty[:75], scale * x[:75]) and not np.allclose(dirty[75:], scale * x[75:]) and G.contaminated(x, np.ones(3), 0.0, 0.0) is x
    assert G.reflected(np.array([1.0, 2.0, 3.0]), 6).tolist() == [1, 2, 3, 2, 1, 2] and G.reflected(np.zeros(0), 2).tolist() == [0, 0] and G.reflected(np.array([4.0]), 3).tolist() == [4, 4, 4]
    m = G.placed_in_rooms([x, x], [np.r_[1.0], np.r_[1.0]], [-6.0, -12.0], [0, 200], 60.0, 1)
    assert len(m) == 300 and abs(20 * np.log10(np.sqrt((m[:100] ** 2).mean()) / np.sqrt((m[200:] ** 2).mean())) - 6) < 0.1
    assert len(G.placed_in_rooms([], [], [], [], 20.0, 1)) == 0 and np.abs(G.placed_in_rooms([x], [np.r_[1.0]], [40.0], [0], 20.0, 1)).max() <= 0.99 + 1e-9


def test_sessions_in_two_stages_and_parts(spark):
    v = [[1.0, 0.0], [0.99, 0.1], [0.0, 1.0], [0.1, 0.99], [0.7, 0.7]]
    rows = spark.createDataFrame([(1, i, x, 1.0 if i == 4 else 10.0, i % 2) for i, x in enumerate(v)] + [(1, 9, None, 1.0, 7)], "session long, id long, v array<double>, speech double, cut long")
    got = {r["id"]: r["cluster"] for r in Y.session_clusters(rows, 0.9, low=0.5, small=0.1).collect()}
    assert got[0] == got[1] and got[2] == got[3] and got[0] != got[2] and got[9] not in (got[0], got[2])
    parts = Y.session_clusters(rows, 0.9, stretch=2).collect()
    assert len(parts) == 6 and len({r["id"] for r in parts}) == 6


def test_task_levels_and_states(spark):
    from lakeloom.operators import operations as O

    tasks = spark.createDataFrame([(t,) for t in "abcd"], "task string")
    needs = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("d", "gone"), (None, "a")], "task string, needed string")
    levels = O.task_levels(tasks, needs)
    assert {r["task"]: (r["level"], r["missing"]) for r in levels.collect()} == {"a": (0, 0), "b": (1, 0), "c": (2, 0), "d": (0, 1)}
    done = spark.createDataFrame([("a",)], "task string")
    assert {r["task"]: r["state"] for r in O.runnable(levels, needs, done).collect()} == {"a": "done", "b": "ready", "c": "blocked", "d": "blocked"}
    with pytest.raises(ValueError):
        O.task_levels(tasks, spark.createDataFrame([("a", "b"), ("b", "a")], "task string, needed string"), most=5)
    assert O.task_levels(tasks.limit(0), needs).count() == 0


def test_overviews_arms_and_terminal_states(spark):
    from lakeloom.operators import operations as O

    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "k string, d string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("e", "1")], "k string, d string")
    assert {r["k"]: r["state"] for r in O.overview_changes(old, new, "k", "d").collect()} == {"a": "current", "b": "stale", "c": "gone", "e": "new"}
    w = spark.createDataFrame([("x", 1.0, True), ("y", 1.0, False), ("z", 3.0, False)], "source string, weight double, trained boolean")
    got = {(r["arm"], r["source"]): r["quota"] for r in O.recipe_arms(w, 10, {"control": 0.0, "replay": 0.5}).collect()}
    assert got == {("control", "x"): 0, ("control", "y"): 3, ("control", "z"): 7, ("replay", "x"): 5, ("replay", "y"): 1, ("replay", "z"): 4}
    log = spark.createDataFrame([("k1", "run", 1), ("k1", "done", 2), ("k2", "run", 1), ("k3", "done", 1), ("k4", "done", 1)], "key string, state string, at int")
    remote = spark.createDataFrame([("k1", "done", 2), ("k2", "run", 1), ("k3", "failed", 5)], "key string, state string, at int")
    assert {r["key"]: r["error"] for r in O.terminal_check(log, remote, ["done"]).collect()} == {"k2": "open", "k3": "differs", "k4": "missing"}


def test_next_few_and_sums_before(spark, monkeypatch):
    from lakeloom.operators import timeline as L
    from lakeloom.operators.ordering import sums_before

    monkeypatch.setattr(L, "SHARD", 16)
    rng = np.random.default_rng(5)
    rows = [(w, i, int(s), int(s) + 5) for w in "ab" for i, s in enumerate(rng.integers(-40, 200, 40))]
    t = spark.createDataFrame(rows, "window_id string, turn_id int, s long, e long")
    order = {w: [i for _, i, *_ in sorted((r for r in rows if r[0] == w), key=lambda r: (r[2], r[3], r[1]))] for w in "ab"}
    got = {(r["window_id"], r["turn_id"]): [x["turn_id"] for x in r["few"]] for r in L.next_few(t, [], 3).collect()}
    assert got == {(w, i): o[k + 1 : k + 4] for w, o in order.items() for k, i in enumerate(o)}
    nxt = {(r["window_id"], r["turn_id"]): r["next"]["turn_id"] if r["next"] else None for r in L.followed(t, []).collect()}
    assert nxt == {(w, i): (o[k + 1 : k + 2] or [None])[0] for w, o in order.items() for k, i in enumerate(o)}
    v = spark.createDataFrame([("g" if i % 3 else "h", i, i % 7) for i in range(100)], "g string, o int, v int")
    assert all(r["b"] == sum(j % 7 for j in range(r["o"]) if (j % 3 == 0) == (r["o"] % 3 == 0)) for r in sums_before(v, ["g"], "o", "v", "b").collect())


def test_paired_systems(spark):
    from lakeloom.operators.relations import paired

    a = spark.createDataFrame([(1, 0.5, True), (2, 0.1, False), (3, 0.2, True)], "k int, v double, ok boolean")
    b = spark.createDataFrame([(1, 0.7, True), (2, 0.1, True), (3, 0.2, True)], "k int, v double, ok boolean")
    assert sorted(tuple(r) for r in paired(a, b, "k", "v", "ok", same_keys=True).collect()) == [(1, 0.5, 0.7), (3, 0.2, 0.2)]
    assert paired(a, b.limit(0), "k", "v", "ok").count() == 0
    with pytest.raises(ValueError, match="3"):
        paired(a, b.where("k < 3"), "k", "v", "ok", same_keys=True)


def test_npz_and_scenes(spark, tmp_path):
    rows = spark.createDataFrame([(1, [2, 3], 0.5), (2, [], None)], "id long, n array<bigint>, x double")
    assert K.write_npz(rows, str(tmp_path / "t.npz")) == 2
    back = {r["id"]: list(r["n"]) for r in R.read_npz(spark, str(tmp_path / "t.npz"), "id long, n array<bigint>").collect()}
    assert back == {1: [2, 3], 2: [-1, -1]}
    with pytest.raises(ValueError):
        K.write_npz(rows, str(tmp_path / "u.npz"), most=1)
    t = spark.createDataFrame([(w, i, "AB"[i % 2], 100 * i, 100 * i + (30 if i < 4 else 300)) for w in ("alternate", "burst", "short", "full") for i in range(6)] + [("full", 9, None, 0, 5)], "window_id string, turn_id int, speaker string, s long, e long")
    got = {}
    for r in C.scene_starts(t, F.col("window_id"), 10).collect():
        got.setdefault(r["window_id"], {})[r["turn_id"]] = r["start"]
    assert got["full"] == {i: 100 * i for i in range(6)} and got["burst"] == {0: 0, 2: 40, 4: 80, 1: 0, 3: 40, 5: 80}
    assert got["alternate"] == {0: 0, 1: 40, 2: 80, 3: 120, 4: 160, 5: 470} and got["short"] == {0: 0, 2: 40, 1: 0, 3: 40}
