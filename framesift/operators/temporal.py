"""Order and nearness in time: event chains, intervals, neighbours and samples of a video's frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framesift.operators import ordering


def event_chains(events: list[DataFrame], per_video: int | None = None) -> DataFrame:
    """`video_id`, `id_1`, `t_1`, ..., `total`: candidates of each event in one video at strictly increasing times.

    events: rows with `id`, `video_id`, `t`, `score`. per_video bounds the candidates of an event in a video, best first, as
    the number of chains grows with its power; None takes all."""
    parts = []
    for n, e in enumerate(events, 1):
        if per_video is not None:
            w = Window.partitionBy("video_id").orderBy(F.col("score").desc(), "id")
            e = e.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_video).drop("r")
        parts.append(e.select("video_id", F.col("id").alias(f"id_{n}"), F.col("t").alias(f"t_{n}"), F.col("score").alias(f"s_{n}")))
    # videos that lack an event drop out before the joins that multiply
    common = reduce(lambda a, b: a.intersect(b), [p.select("video_id") for p in parts])
    out = parts[0].join(common, "video_id", "left_semi")
    for n, p in enumerate(parts[1:], 2):
        p = p.withColumnRenamed("video_id", "v")
        out = out.join(p, (F.col("video_id") == F.col("v")) & (F.col(f"t_{n - 1}") < F.col(f"t_{n}"))).drop("v")
    total = reduce(lambda a, b: a + b, [F.col(f"s_{n}") for n in range(1, len(parts) + 1)])
    return out.withColumn("total", total).drop(*(f"s_{n}" for n in range(1, len(parts) + 1)))


def has_chain(events: list[DataFrame], videos: DataFrame) -> DataFrame:
    """`video_id`, `valid`: whether each of videos has a chain of the events at strictly increasing times.

    The first time of each event after that of the event before decides, so chains aren't listed."""
    at = events[0].groupBy("video_id").agg(F.min("t").alias("t"))
    for e in events[1:]:
        later = e.select(F.col("video_id").alias("v"), F.col("t").alias("u"))
        at = at.join(later, (F.col("video_id") == F.col("v")) & (F.col("u") > F.col("t"))).groupBy("video_id").agg(F.min("u").alias("t"))
    return videos.join(at, "video_id", "left").select("video_id", F.col("t").isNotNull().alias("valid"))


def segment_asof(frames: DataFrame, segments: DataFrame, tolerance: float = 2.0, bucket: float = 60.0) -> DataFrame:
    """`id`, `segment_id`, `transcript`, `gap`: the first segment that covers a frame's time ([start, end)), else the one with the nearest
    end within tolerance; frames without one are left out.

    Segments are laid out over buckets of time, widened by the tolerance, so the join is on video and bucket."""
    at = lambda t: F.floor(t / bucket).cast("long")
    s = segments.where("video_id is not null and start_sec is not null and end_sec is not null and transcript is not null and start_sec <= end_sec")
    s = s.select("segment_id", F.col("video_id").alias("v"), "start_sec", "end_sec", "transcript", F.explode(F.sequence(at(F.col("start_sec") - tolerance), at(F.col("end_sec") + tolerance))).alias("b"))
    f = frames.where("video_id is not null and timestamp is not null").select("id", "video_id", "timestamp", at(F.col("timestamp")).alias("fb"))
    t = F.col("timestamp")
    covers = (t >= F.col("start_sec")) & (t < F.col("end_sec"))
    gap = F.when(covers, 0.0).otherwise(F.least(F.abs(t - F.col("start_sec")), F.abs(t - F.col("end_sec"))))
    pairs = f.join(s, (F.col("video_id") == F.col("v")) & (F.col("fb") == F.col("b"))).withColumn("gap", F.round(gap, 6)).where(F.col("gap") <= tolerance)
    w = Window.partitionBy("id").orderBy(covers.desc(), "gap", "start_sec", "segment_id")
    return pairs.withColumn("r", F.row_number().over(w)).where("r = 1").select("id", "segment_id", "transcript", "gap")


def relevant(frames: DataFrame, labels: DataFrame, bucket: float = 60.0) -> DataFrame:
    """`label_id`, `id`: frames of the label's video with lo <= timestamp < hi. A reversed window has none."""
    q = labels.where("label_id is not null and video_id is not null and time_window[0] < time_window[1]").select("label_id", F.col("video_id").alias("v"), F.expr("time_window[0]").alias("lo"), F.expr("time_window[1]").alias("hi"))
    q = q.withColumn("b", F.explode(F.sequence(F.floor(F.col("lo") / bucket), F.floor(F.col("hi") / bucket))))
    f = frames.where("timestamp is not null").select("id", "video_id", "timestamp", F.floor(F.col("timestamp") / bucket).alias("fb"))
    return f.join(q, (F.col("video_id") == F.col("v")) & (F.col("fb") == F.col("b")) & (F.col("timestamp") >= F.col("lo")) & (F.col("timestamp") < F.col("hi"))).select("label_id", "id")


def neighbors(frames: DataFrame, chosen: DataFrame, before: int = 2, after: int = 2) -> DataFrame:
    """`center`, `id`, `offset`: the frames around each chosen `id` in its video by time; unknown ids have none."""
    n = ordering.positions(frames)
    c = n.join(chosen.select("id").distinct(), "id").select(F.col("id").alias("center"), F.col("video_id").alias("v"), F.explode(F.sequence(F.col("n") - before, F.col("n") + after)).alias("m"), F.col("n").alias("at"))
    return n.join(c, (F.col("video_id") == F.col("v")) & (F.col("n") == F.col("m"))).select("center", "id", (F.col("n") - F.col("at")).alias("offset"))


def _at(n: DataFrame, spots: DataFrame) -> DataFrame:
    """The frames at places `spot` of their videos."""
    s = spots.select(F.col("video_id").alias("v"), "spot").distinct()
    return n.join(s, (F.col("video_id") == F.col("v")) & (F.col("n") == F.col("spot"))).drop("v", "spot")


def explore(frames: DataFrame, per_video: int = 3) -> DataFrame:
    """`video_id`, `id`, `timestamp`: evenly spaced frames of each video, first and last included; half a step goes to the even one."""
    n = ordering.positions(frames)
    length = n.groupBy("video_id").agg(F.count("*").alias("len"))
    take = F.least(F.lit(per_video), F.col("len"))
    spots = F.when(take == 1, F.array(F.lit(0).cast("bigint"))).otherwise(F.transform(F.sequence(F.lit(0), take.cast("int") - 1), lambda i: F.bround(i * (F.col("len") - 1) / (take - 1)).cast("bigint")))
    return _at(n, length.select("video_id", F.explode(spots).alias("spot"))).select("video_id", "id", "timestamp")


def systematic_sample(frames: DataFrame, step: int) -> DataFrame:
    """`video_id`, `id`, `timestamp` of every step-th frame of each video by time, beginning with the first."""
    return ordering.positions(frames).where(F.col("n") % step == 0).drop("n")


def uniform_subsample(frames: DataFrame, n: int) -> DataFrame:
    """`video_id`, `id`, `timestamp` of at most n frames of each video, at the places int(i * len / n)."""
    placed = ordering.positions(frames)
    length = placed.groupBy("video_id").agg(F.count("*").alias("len"))
    take = F.least(F.lit(n), F.col("len")).cast("int")
    spots = F.transform(F.sequence(F.lit(0), take - 1), lambda i: F.floor(i * F.col("len") / take).cast("bigint"))
    return _at(placed, length.select("video_id", F.explode(spots).alias("spot"))).drop("n")
