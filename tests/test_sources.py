"""Frames of videos, made-up tables, records, reports, stored indexes and streams."""

import datetime as dt
import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesift import session
from framesift.functions import text as T
from framesift.operators import bm25, ingest, reports
from framesift.sources import keyframes, synthetic, video
from framesift.streaming import ingest as stream


def test_frames_of_videos(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    scenes = [(200, 30, 30)] * 50 + [(30, 200, 30)] * 50 + [(30, 30, 200)] * 26
    x = np.zeros((len(scenes), 8, 8, 3), np.uint8)
    x[:] = np.array(scenes, np.uint8)[:, None, None, :]
    x[:, 0, 0] = np.random.default_rng(0).integers(0, 255, (len(scenes), 3))  # noise that hardly counts
    np.save(tmp_path / "deep" / "a.npy", x)
    np.save(tmp_path / "b.npy", x[:1])
    (tmp_path / "notes.txt").write_text("no video")
    read = lambda **k: sorted((r.id, r.timestamp, r.frame_idx) for r in video.read_frames(spark, str(tmp_path), suffixes=("npy",), **k).collect())
    assert read() == [("a/0", 0.0, 0), ("a/1", 2.0, 50), ("a/2", 4.0, 100), ("b/0", 0.0, 0)]
    assert len(read(threshold=None)) == 7 and len(read(threshold=None, every_s=0.001)) == 127
    assert len(read(threshold=None, max_frames=2)) == 3
    assert [video.step_of(f, s) for f, s in ((None, 1.0), (30.0, 0.5), (10.0, 0.0))] == [25, 15, 1]
    red = video.hsv_histogram(np.full((4, 4, 3), (255, 0, 0), np.uint8))
    assert red.shape == (3000,) and red.max() == 1 and not video.differs(red, red, 0.985)
    assert video.hsv_histogram(np.zeros((2, 2, 3), np.uint8)).max() == 1


def test_made_up_tables(spark):
    v = synthetic.sample_video(spark, "v", 12).orderBy("timestamp").collect()
    assert len(v) == 12 and v[3].id == "v/3" and v[3].timestamp == 6.0 and v[0].objects == v[2].objects != v[3].objects
    for df in (synthetic.unit_vectors(spark, 50, 8), synthetic.clustered_vectors(spark, 50, 8)):
        assert all(abs(sum(x * x for x in r.vec) - 1) < 1e-4 for r in df.collect())
    near = synthetic.clustered_vectors(spark, 200, 16, spread=0.1, clusters=2).collect()
    s = np.array([r.vec for r in near]) @ np.array([r.vec for r in near]).T
    assert ((s > 0.9).mean(1) > 0.2).all()
    life = synthetic.lifelog(spark, 40, target={"gender": "male"}).orderBy("timestamp").collect()
    assert life[0].objects == ["gender:male"] and life[0].llm_caption == "người đàn ông" and len(life[5].objects) == len(T.ATTRIBUTES)


def test_labelled_items_are_found(spark):
    docs, queries = synthetic.labelled_items(spark)
    top = bm25.top_k(bm25.scores(docs, queries, "id", "text", "query_id", "text"), "query_id", "score", "id", 1)
    assert top.join(queries, "query_id").where("id = target").count() == 30


def test_captions_on_survivors_only(spark):
    rows = [("v", float(n), f"{n}", [1.0, 0.001 * n] if n < 4 else [0.0, 1.0], b"x") for n in range(6)] + [("v", None, "none", None, b"x")]
    f = spark.createDataFrame(rows, "video_id string, timestamp double, id string, vec array<double>, image_bytes binary")
    got = {r.id: r for r in ingest.caption_survivors(f, "vec", lambda df: F.concat(F.lit("c"), df["id"])).collect()}
    assert {i for i, r in got.items() if r.is_cluster_representative} == {"0", "4", "none"}
    assert all((r.llm_caption == f"c{i}") == r.is_cluster_representative and (r.image_bytes is None) != r.is_cluster_representative for i, r in got.items())
    assert tuple(got["0"].cluster_span) == (0.0, 3.0) and got["none"].cluster_span is None and got["1"].llm_caption is None
    texts = {"ocr_text": spark.createDataFrame([("1", "sign")], "id string, text string")}
    r = ingest.records(f.where("timestamp < 3"), texts).collect()
    assert [x.id for x in r] == ["0", "1", "2"] and [x.ocr_text for x in r] == [None, "sign", None]
    assert [x.id for x in ingest.rows_of(f, ["4", "none", "0", "zz"], "vec").collect()] == ["4", "0"]


def test_reports(spark, tmp_path):
    t = spark.createDataFrame([(float(x),) for x in range(1, 101)] + [(None,)], "ms double")
    assert tuple(reports.percentiles(t, "ms").head()) == (50.0, 95.0)
    assert tuple(reports.percentiles(t.limit(0), "ms").head()) == (None, None)
    p = spark.createDataFrame([(100, 2.0, 5.0), (200, 4.0, 9.0)], "n long, s double, mb double")
    assert [tuple(r) for r in reports.extrapolate(p, "n", "s", "mb", to=[1000]).collect()] == [(1000, 20.0, 45.0)]
    reports.write_report(spark, f"{tmp_path}/r.json", {"points": p, "k": 10})
    assert json.loads((tmp_path / "r.json").read_text())["points"][1] == {"n": 200, "s": 4.0, "mb": 9.0}


def test_older_and_several_indexes(spark, tmp_path):
    old = spark.createDataFrame([("a", "v", [1.0])], "id string, video_id string, clip_embedding array<float>")
    paths = keyframes.save_all({"x y": old, "z": old}, str(tmp_path))
    assert paths == [f"{tmp_path}/x_y", f"{tmp_path}/z"]
    back = keyframes.load_index(spark, paths[0]).head()
    assert back.llm_caption is None and back.objects is None and back.clip_embedding == [1.0] and back.siglip_embedding is None
    with pytest.raises(ValueError):
        keyframes.save_all({"a b": old, "a_b": old}, str(tmp_path))


def test_labels_videos_and_ids_by_line(spark, tmp_path):
    (tmp_path / "l.json").write_text('[{"query": "q", "video_id": "v", "time_window": [1, 2], "more": 3}, {"query": null, "video_id": "v", "time_window": null}]')
    assert [tuple(r) for r in keyframes.read_labels(spark, f"{tmp_path}/l.json").collect()] == [("q", "v", [1.0, 2.0]), (None, "v", None)]
    (tmp_path / "d").mkdir()
    for name in ("d/a.MP4", "b.webm", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r.path.rsplit("/", 1)[1] for r in keyframes.list_videos(spark, str(tmp_path)).collect()) == ["a.MP4", "b.webm"]
    np.save(tmp_path / "m.npy", np.ones((2, 3)))
    (tmp_path / "m.txt").write_text("first id\nsecond\n")
    assert sorted(r.id for r in keyframes.read_vectors(spark, str(tmp_path)).collect()) == ["first id", "second"]
    hits = spark.createDataFrame([([("A", 0.9), (" ", 0.9), ("b", 0.1)],), (None,)], "h array<struct<text:string,conf:double>>")
    assert [r[0] for r in hits.select(keyframes.ocr_text(F.col("h"))).collect()] == ["A", None]


def test_mock_vectors_repeat_and_may_be_noisy(spark):
    df = spark.createDataFrame([("a",), ("b",)], "id string")
    v = lambda **k: [r.v for r in keyframes.enrich(df, {"v": keyframes.mock_vectors(8, "clip", **k)}).orderBy("id").collect()]
    assert v() == v() and v()[0] != v()[1]
    s = float(np.dot(v()[0], v(noise=0.2)[0]))
    assert 0.9 < s < 0.9999


def test_text_helpers(spark):
    row = lambda *c: tuple(spark.range(1).select(*c).head())
    assert row(T.media_type(F.lit("a/b.PNG")), T.media_type(F.lit("x.tiff")), T.safe_name(F.lit("a b/ü?.mp4"))) == ("image/png", "image/jpeg", "a_b_ü_.mp4")
    assert row(T.question(F.lit("gender")), T.question(F.lit("mood"))) == (T.QUESTIONS["gender"], "Bạn có thể cho biết thêm thông tin về 'mood' không?")
    assert row(T.attributes_to_caption(F.create_map(F.lit("gender"), F.lit("male"), F.lit("time_period"), F.lit("yesterday"), F.lit("other"), F.lit("x")))) == ("hôm qua người đàn ông",)
    assert row(T.subject_of(F.lit("Người đàn ông mặc áo xanh đang tặng hoa"), "tặng"), T.subject_of(F.lit("tặng hoa"), "tặng"), T.subject_of(F.lit("không có gì"), "tặng")) == ("Người đàn ông mặc áo xanh", None, None)
    assert row(T.number_before(F.lit("ba người bên 5 cây nến và hai nến"), F.lit("nến")), T.target_noun(F.lit("Có bao nhiêu cây nến?")), T.asked_action(F.lit("Ai tặng hoa?"))) == (5, "cây", "tặng")
    a = F.array(F.lit("x"), F.lit("y"))
    assert row(T.mock_caption(a, F.lit("v"), F.lit(1.0)), T.mock_caption(F.lit(None).cast("array<string>"), F.lit("v"), F.lit(2.5))) == ("Cảnh có x, y tại video v (mô tả mock).", "Cảnh trong video v lúc 2s (mô tả mock).")


def test_shared_folder(spark, tmp_path, monkeypatch):
    path = session.shared_path(spark, "x")
    spark.range(3).write.parquet(path)
    session.clear(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    assert session.shared_fs("/tmp/x")[1] == "/tmp/x" and session.shared_fs(f"file://{tmp_path}")[1] == str(tmp_path)


class Elsewhere:
    """A session on a cluster without a shared folder."""

    class sparkContext:  # noqa: N801
        master = "spark://host:7077"

        @staticmethod
        def getConf():  # noqa: N802
            return {}

    class conf:  # noqa: N801
        get = staticmethod(lambda k, d=None: d)


def test_cluster_without_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Elsewhere)


def run(df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name).collect()


def test_repeated_and_late_events(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h, minutes=m)
    for rows in ([("a", at(0)), ("a", at(0, 5)), ("b", at(1))], [("a", at(1)), ("c", at(30))], [("f", at(31))], [("d", at(2)), ("e", at(60))]):
        spark.createDataFrame(rows, "id string, ingested_at timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
    read = stream.read_bounded(spark, f"{tmp_path}/in", "id string, ingested_at timestamp", files=1)
    assert sorted(r.id for r in run(stream.deliver_once(read, delay="2 hours"), "once", tmp_path)) == ["a", "b", "c", "e", "f"]  # d is later than the delay
    seen = []
    spark.streams.addListener(listener := stream.Progress(lambda q, n: seen.append(n)))
    events = stream.read_bounded(spark, f"{tmp_path}/in", "id string, ingested_at timestamp", files=1).select(F.col("ingested_at").alias("ts"), F.lit("k").alias("event_type"))
    counts = {r.start: r.n for r in run(stream.activity(events), "activity", tmp_path)}
    assert counts[at(0)] == 2 and counts[at(1)] == 2 and at(2) not in counts  # b and the second a; d came too late
    time.sleep(0.5)
    spark.streams.removeListener(listener)
    assert seen and max(seen) == 8
