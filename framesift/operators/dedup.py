"""Collapse of near-duplicate frames: sequential folds against an anchor over chunks of a video's frames in order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.operators.ordering import ROWS, chunks, fixed_point

AHEAD = 64  # frames compared with an anchor at once
METRICS = ("cosine", "pearson")


class Anchors:
    """The fold over batches sorted by video, time and id; carries the last video and its anchor only."""

    def __init__(self, threshold: float, metric: str, state: tuple | None = None):
        self.threshold, self.metric = threshold, metric
        self.video, self.anchor, vec = state or (None, None, None)
        self.vec = None if vec is None else np.asarray(vec, np.float64)

    def add(self, b: pa.RecordBatch) -> list:
        """The anchor of each frame of a batch with the columns video_id, t, id, vec."""
        videos, ids = b.column("video_id").to_pylist(), b.column("id").to_pylist()
        col = b.column("vec")
        x = col.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
        x = x - x.mean(1, keepdims=True) if self.metric == "pearson" else x
        sq = np.einsum("ij,ij->i", x, x)
        out: list = []
        i = 0
        while i < len(ids):
            if videos[i] != self.video:
                self.video, self.anchor, self.vec = videos[i], ids[i], x[i]
                out.append(self.anchor)
                i += 1
                continue
            j = min(len(ids), i + AHEAD)
            n = np.sqrt(sq[i:j] * (self.vec @ self.vec))
            sim = np.divide(x[i:j] @ self.vec, n, out=np.zeros(j - i), where=n > 0)
            apart = np.round(sim, 9) < self.threshold
            apart |= np.fromiter((v != self.video for v in videos[i:j]), bool, j - i)
            stop = i + int(np.argmax(apart)) if apart.any() else j
            out += [self.anchor] * (stop - i)
            i = stop
            if i < j and videos[i] == self.video:
                self.anchor, self.vec = ids[i], x[i]
                out.append(self.anchor)
                i += 1
        return out


def anchor_clusters(frames: DataFrame, vector: str, threshold: float = 0.97, metric: str = "cosine", video: str = "video_id", time: str = "timestamp", key: str = "id", rows: int = ROWS) -> DataFrame:
    """`video_id`, `t`, `id`, `anchor`: a frame joins the cluster of its video's last anchor if similar enough, else it is the next anchor.

    Raises ValueError for a threshold outside (0, 1] or another metric than METRICS. Frames need a vector and a time; clusters never cross
    videos. Vectors have one length. A long video goes over chunks of about `rows` frames, which are folded at once: see fixed_point."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    all_ = frames.select(F.col(video).alias("video_id"), F.col(time).alias("t"), F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vec")).where("video_id is not null and t is not null and vec is not null")
    kinds = {n: t for n, t in all_.dtypes}
    ordered = chunks(all_, ["video_id", "t", "id"], rows)

    def last(entering: dict[int, tuple]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chunk = TaskContext.get().partitionId()
            fold, types = Anchors(threshold, metric, entering.get(chunk)), None
            for b in batches:
                if b.num_rows:
                    types = b.schema.field("video_id").type, b.schema.field("id").type
                    fold.add(b)
            if types:
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([fold.video], types[0]), pa.array([fold.anchor], types[1]), pa.array([fold.vec.tolist()], pa.list_(pa.float64()))], names=["chunk", "video_id", "anchor", "vec"])

        return run

    entering = fixed_point(ordered, last, f"chunk bigint, video_id {kinds['video_id']}, anchor {kinds['id']}, vec array<double>")
    shared = frames.sparkSession.sparkContext.broadcast(entering)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = Anchors(threshold, metric, shared.value.get(TaskContext.get().partitionId()))
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("video_id"), b.column("t"), b.column("id"), pa.array(fold.add(b), b.column("id").type)], names=["video_id", "t", "id", "anchor"])

    return ordered.mapInArrow(mark, f"video_id {kinds['video_id']}, t {kinds['t']}, id {kinds['id']}, anchor {kinds['id']}")


def representatives(clusters: DataFrame) -> DataFrame:
    """One row per cluster: `video_id`, `id` of the anchor, `members`, and `t_start`, `t_end` where there is more than one member."""
    many = F.col("members") > 1
    return clusters.groupBy("video_id", F.col("anchor").alias("id")).agg(F.count("*").alias("members"), F.min("t").alias("a"), F.max("t").alias("b")).select("video_id", "id", "members", F.when(many, F.col("a")).alias("t_start"), F.when(many, F.col("b")).alias("t_end"))


def reduction(clusters: DataFrame) -> DataFrame:
    """`frames`, `representatives`, `ratio` = 1 - representatives / frames, 0 for no frames."""
    n = clusters.agg(F.count("*").alias("frames"), F.count(F.when(F.col("anchor") == F.col("id"), 1)).alias("representatives"))
    return n.withColumn("ratio", F.when(F.col("frames") > 0, F.round(1 - F.col("representatives") / F.col("frames"), 6)).otherwise(0.0))
