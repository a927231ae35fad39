"""Core operators on small data: literal cases, edge cases and agreement with brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesift.functions import text as T
from framesift.functions import vectors as V
from framesift.functions.location import location
from framesift.operators import bm25, dedup, dense, dialogue, filters, fusion, ordering, sessions, temporal, tools
from framesift.operators import metrics as M
from framesift.sources import keyframes
from framesift.streaming import ingest


def one(spark, column, **values):
    df = spark.range(1).select(*(v.alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).head()["x"]


def test_text_functions(spark):
    q = spark.createDataFrame([("Người đàn ông cởi mũ trước khi vào nhà",), ("A sau khi B",), ("trước khi đi",), (None,)], "q string")
    assert [r[0] for r in q.select(T.temporal_order(F.col("q"))).collect()] == [["cởi mũ", "vào nhà"], ["b", "a"], None, None]
    s = spark.createDataFrame([("8/10",), ("7.5",), ("x",), ("95",), (None,)], "q string")
    assert [r[0] for r in s.select(T.parse_score(F.col("q"))).collect()][:4] == [0.8, 0.75, 0.0, 1.0]
    w = spark.createDataFrame([("NASA logo",), ("a red car",), ("OK",), ("xe ĐỎ",)], "q string")
    assert [r[0] for r in w.select(T.adaptive_weight(F.col("q"))).collect()] == [3.0, 1.0, 3.0, 1.0]
    assert one(spark, T.lexicon_scan(F.lit("áo sơ mi và bánh sinh nhật"), T.OBJECTS)) == ["bánh sinh nhật", "áo sơ mi"]
    assert one(spark, T.expand(F.lit("tìm video"), 3)) == ["tìm video", "truy tìm video", "tìm đoạn phim"]
    with pytest.raises(ValueError):
        T.expand(F.lit("x"), 0)
    assert one(spark, T.tags_to_attributes(F.array(F.lit("a:b:c"), F.lit("plain")))) == {"a": "b:c"}
    assert one(spark, T.json_part(F.lit('x {"a": {"b": 1}} y'))) == '{"a": {"b": 1}}'
    places = {"Cô ấy ngồi ở Quán cà phê tuần trước, một mình": "Quán cà phê", "trong video có bao nhiêu người": None, None: None, "": None, "Ai đi ở công viên có hoa?": "công viên", "ở a b c d e f g rồi trên đường": "đường"}
    q = spark.createDataFrame([(x,) for x in places], "q string")
    assert {r.q: r.l for r in q.select("q", location(F.col("q")).alias("l")).collect()} == places


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, b array<float>")
    r = df.select(V.l2_normalize(F.col("a")).alias("u"), V.l2_normalize(F.col("b")).alias("z"), V.cosine(F.col("a"), F.col("b")).alias("c"), dialogue.multimodal(F.col("a"), F.lit(None).cast("array<float>")).alias("m")).head()
    assert r.u == pytest.approx([0.6, 0.8]) and r.z == [0, 0] and r.c == 0 and r.m == pytest.approx([0.6, 0.8])


def test_filters(spark):
    df = spark.createDataFrame([("a", "v", ["x", "y"], 1.0), ("b", "v", None, 2.0), ("c", "w", [], 3.0)], "id string, video_id string, objects array<string>, timestamp double")
    ids = lambda **b: sorted(r.id for r in filters.apply(df, **b).collect())
    assert ids() == ["a", "b", "c"] and ids(videos=[]) == ["a", "b", "c"]
    assert ids(objects_all=["x", "y"]) == ["a"] and ids(objects_any=["y", "z"]) == ["a"]
    assert ids(time_range=(1.0, 2.0)) == ["a", "b"] and ids(videos=["w"], objects_any=["x"]) == []


def test_knn_and_ann(spark):
    x = np.random.default_rng(0).standard_normal((300, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<float>").repartition(5)
    q = df.where("id % 50 = 0").select(F.col("id").alias("q"), F.col("vec").alias("qv"))
    got = {(r.q, r["rank"]): r.id for r in dense.batch_knn(df, q, "id", "vec", "q", "qv", 4, 8, block=3).collect()}
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    assert got == {(i, n + 1): j for i in range(0, 300, 50) for n, j in enumerate(sorted(range(300), key=lambda j: (-s[i, j], j))[:4])}
    exact = dense.batch_knn(df, q, "id", "vec", "q", "qv", 4, 8)
    for found in (dense.ivf_knn(df, q, "id", "vec", "q", "qv", 4, 8, lists=8, probes=5), dense.lsh_knn(df, q, "id", "vec", "q", "qv", 4, 8, tables=24, bits=4)):
        assert dense.recall(found, exact, "q", "id").head().recall >= 0.8
    assert dense.batch_knn(df, q.limit(0), "id", "vec", "q", "qv", 4, 8).collect() == []


def test_rrf(spark):
    lists = {"a": [2, 1, 3], "b": [2, 3, 1]}
    dfs = {n: spark.createDataFrame([(0, x, i) for i, x in enumerate(xs, 1)], "q int, id int, rank int") for n, xs in lists.items()}
    rows = fusion.rrf(dfs, "q", "id").orderBy("rank").collect()
    assert [r.id for r in rows] == [2, 1, 3]
    assert rows[0].score == pytest.approx(2 / 61) and rows[1].sources == "a:2,b:3"


def test_bm25_small(spark):
    docs = spark.createDataFrame([(1, "red car red"), (2, "blue car"), (3, ""), (4, None)], "id int, text string")
    qs = spark.createDataFrame([(7, "red car"), (8, ""), (9, None)], "q int, t string")
    got = {(r.q, r.id) for r in bm25.scores(docs, qs, "id", "text", "q", "t").collect()}
    assert got >= {(7, 1)} and all(q == 7 for q, _ in got)


def test_dedup(spark):
    rows = [("v", float(i), f"{i:02d}", [math.cos(math.radians(10 * i)), math.sin(math.radians(10 * i))]) for i in range(10)] + [("w", 0.0, "x", [1.0, 0.0])]
    df = spark.createDataFrame(rows, "video_id string, timestamp double, id string, vec array<float>")
    c = dedup.anchor_clusters(df, "vec", 0.97)
    assert c.where("video_id = 'v'").select("anchor").distinct().count() == 5  # anchored, so a slow drift doesn't chain
    assert dedup.reduction(c).head().representatives == 6
    assert dedup.reduction(c.limit(0)).head().ratio == 0.0
    with pytest.raises(ValueError):
        dedup.anchor_clusters(df, "vec", 0.0)


@pytest.mark.parametrize("rows", [3, 40, 10_000])
def test_folds_over_chunks(spark, rows):
    """Clusters and places don't depend on how a long video is cut; a slow drift hands anchors on over many chunks."""
    rng = np.random.default_rng(3)
    frames, want, place = [], {}, {}
    for v, n in (("a", 90), ("b", 1), ("c", 40), ("d", 2)):
        anchor = vec = None
        angle = 0.0
        for t in range(n):
            angle += rng.choice([0.0, 0.02, 0.4]) if v == "a" else 0.01
            x = np.array([math.cos(angle), math.sin(angle)])
            if vec is None or round(float(x @ vec), 9) < 0.97:
                anchor, vec = f"{v}{t:03d}", x
            want[f"{v}{t:03d}"], place[f"{v}{t:03d}"] = anchor, t
            frames.append((v, float(t), f"{v}{t:03d}", x.tolist()))
    df = spark.createDataFrame(frames, "video_id string, timestamp double, id string, vec array<double>").orderBy(F.rand(1))
    assert {r.id: r.anchor for r in dedup.anchor_clusters(df, "vec", 0.97, rows=rows).collect()} == want
    assert {r.id: r.n for r in ordering.positions(df, rows).collect()} == place
    assert ordering.positions(df.limit(0), rows).collect() == []


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for v in "abc":
        x = np.array([1.0, 0.0, 0.0])
        for t in range(30):
            if rng.random() < 0.2:
                x = np.random.default_rng(rng.randint(0, 999)).standard_normal(3)
            rows.append((v, float(t), f"{v}{t:02d}", (x + 0.001 * rng.random()).tolist()))
    schema = "video_id string, timestamp double, id string, vec array<double>"
    for n, lo in enumerate((0, 10, 20)):
        spark.createDataFrame([r for r in rows if lo <= r[1] < lo + 10], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        __import__("time").sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = ingest.collapse_stream(stream, "vec", 0.97).writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    batch = dedup.anchor_clusters(spark.createDataFrame(rows, schema), "vec", 0.97).where("anchor = id")
    assert sorted(r.id for r in spark.table("kept").collect()) == sorted(r.id for r in batch.collect())


def test_chains(spark):
    e = lambda rows: spark.createDataFrame([(f"{v}{t}", v, t, 1.0) for v, t in rows], "id string, video_id string, t double, score double")
    got = temporal.event_chains([e([("v", 10.0), ("v", 40.0), ("w", 1.0)]), e([("v", 30.0), ("v", 50.0), ("v", 10.0)])])
    assert {(r.t_1, r.t_2) for r in got.collect()} == {(10, 30), (10, 50), (40, 50)}


def test_segments(spark):
    f = spark.createDataFrame([("a", "v", 5.0), ("b", "v", 11.5), ("c", "v", 20.0), ("d", "v", None), ("e", "v", 10.0)], "id string, video_id string, timestamp double")
    s = spark.createDataFrame([(1, "v", 0.0, 10.0, "x"), (2, "v", 4.0, 6.0, "y"), (3, "v", None, 3.0, "z"), (4, "v", 9.0, 8.0, "w")], "segment_id long, video_id string, start_sec double, end_sec double, transcript string")
    assert {(r.id, r.segment_id) for r in temporal.segment_asof(f, s, bucket=7.0).collect()} == {("a", 1), ("b", 1), ("e", 1)}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 20])
def test_samples(spark, n):
    f = spark.createDataFrame([(f"{v}{i:02d}", v, float(i)) for v, m in (("a", 11), ("b", 1), ("c", 4)) for i in range(m)], "id string, video_id string, timestamp double")
    for v, m in (("a", 11), ("b", 1), ("c", 4)):
        k = min(n, m)
        want = {round(i * (m - 1) / (k - 1)) for i in range(k)} if k > 1 else {0}
        assert {int(r.timestamp) for r in temporal.explore(f, n).where(f"video_id = '{v}'").collect()} == want
        sub = {int(r.timestamp) for r in temporal.uniform_subsample(f, n).where(f"video_id = '{v}'").collect()}
        assert sub == ({i * m // n for i in range(n)} if m > n else set(range(m)))


def test_metrics(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "q int")
    runs = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (1, "d", 4), (2, "a", 1), (2, "b", 2)], "q int, id string, rank int")
    rel = spark.createDataFrame([(1, "a"), (1, "c"), (2, "b")], "q int, id string")
    got = {r.q: r for r in M.per_query(q, runs, rel, "q", "id", 2).collect()}
    assert got[1].ap == pytest.approx(0.833333) and got[1].recall == 0.5 and got[2].rr == 0.5
    assert got[2].ndcg == pytest.approx(1 / math.log2(3), abs=1e-6)
    assert tuple(got[3])[1:] == (0, 0, 0, 0, 0)
    assert one(spark, M.token_f1(F.lit("a b c d e"), F.lit("a b c"))) == pytest.approx(0.75)
    assert one(spark, M.exact_match(F.lit("5."), F.lit("5"))) == 1
    p = lambda a, b: M.mcnemar(spark.createDataFrame(list(zip(a, b, strict=True)), "a int, b int"), "a", "b").head().p
    assert p([1] * 10, [0] * 10) < 0.05 and p([1, 1] + [0] * 49, [0] * 51) > 0.05 and p([1], [1]) == 1
    lo, hi = spark.range(1).select(*M.wilson(F.lit(0), F.lit(0))).head()
    assert (lo, hi) == (0, 0)


def test_dialogue(spark):
    df = spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "1"), (None, "1")], "a string, b string")
    e = {r.attribute: r.entropy for r in dialogue.entropy(df, ["a", "b"]).collect()}
    assert e["a"] == pytest.approx(0.918296) and e["b"] == pytest.approx(0.811278)
    assert dialogue.best_attribute(dialogue.entropy(df, ["a", "b"]), ["a"]).head().attribute == "b"
    rows = [(7, n, i, v) for n, (i, v) in enumerate([("a", [0.0, 0.0]), ("b", [0.0, 1.0]), ("x", None), ("c", [5.0, 0.0]), ("d", [5.0, 0.0])])] + [(8, 0, "z", [1.0, 1.0]), (9, 0, "y", None)]
    picked = dialogue.diverse_pick(spark.createDataFrame(rows, "q int, rank int, id string, vec array<double>"), "q", "rank", "id", "vec", 3)
    assert sorted((r.q, r.pick, r.id) for r in picked.collect()) == [(7, 1, "a"), (7, 2, "c"), (7, 3, "b"), (8, 1, "z")]
    ranked = spark.createDataFrame([(1, 0.9), (1, 0.9), (1, 0.1), (2, 0.5), (3, 0.7), (3, 0.2), (3, None), (3, float("nan"))], "q int, s double")
    assert sorted((r.q, r.n, r.gap, r.confident) for r in dialogue.confidence(ranked, "q", "s", 0, 0.15).collect()) == [(1, 3, 0.0, False), (2, 1, None, True), (3, 2, 0.5, True)]
    m = sessions.Memory()
    m.add("q", positive=["a", "b"], negative=["b"])
    m.add("r", positive=["b"])
    assert m.positive() == ["a", "b"] and m.recent(0) == []
    d = sessions.Dialogue(max_turns=3)
    # both speakers' turns count, so the turns have the numbers 0, 2, 4
    assert [d.decide(n, False, "x")[0] for n in (0, 9, 9)] == ["rephrase", "ask", "finish"] and d.finished


def test_route():
    assert tools.route("x") == "search" and tools.route("", image=True) == "search_by_image" and tools.route("x", feedback=True) == "search_with_feedback"
    assert tools.route("x", image=True) == "search_multimodal" and tools.route("x", ordered=True) == "search_temporal"


def test_index_round_trip(spark, tmp_path):
    rec = spark.createDataFrame([("a", "v", [1.0], None, b"x"), ("b", "v", None, [2.0], b"y")], "id string, video_id string, clip_embedding array<float>, siglip_embedding array<float>, image_bytes binary")
    keyframes.save_index(rec, f"{tmp_path}/i")
    back = keyframes.load_index(spark, f"{tmp_path}/i").orderBy("id")
    assert [tuple(r) for r in back.select("id", "video_id", "clip_embedding", "siglip_embedding").collect()] == [("a", "v", [1.0], None), ("b", "v", None, [2.0])]
    np.save(f"{tmp_path}/n.npy", np.ones((2, 3)))
    assert sorted(r.id for r in keyframes.read_vectors(spark, str(tmp_path)).collect()) == ["n/0", "n/1"]
    v = keyframes.enrich(rec.select("id"), {"clip": keyframes.mock_vectors(4, "clip")}).collect()
    assert all(abs(sum(x * x for x in r.clip) - 1) < 1e-5 for r in v)
