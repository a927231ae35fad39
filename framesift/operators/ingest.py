"""From raw frames to records: captions on the frames that remain, texts joined to frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.operators import dedup


def caption_survivors(frames: DataFrame, vector: str, caption: Callable[[DataFrame], Column], threshold: float = 0.97) -> DataFrame:
    """frames with `is_cluster_representative`, `cluster_span` (null for a single frame) and `llm_caption`, after the collapse of near-duplicates.

    Only representatives get a caption; all others lose `image_bytes`, if there is such a column. Frames without vector, video or time are
    their own representatives. caption makes a column of the representatives, so an expensive one runs on these only."""
    clusters = dedup.anchor_clusters(frames, vector, threshold)
    spans = dedup.representatives(clusters).select("id", F.when(F.col("t_start").isNotNull(), F.struct("t_start", "t_end")).alias("cluster_span"))
    marked = frames.drop("is_cluster_representative", "cluster_span", "llm_caption").join(clusters.select("id", "anchor"), "id", "left").join(spans, "id", "left")
    first = F.col("anchor").isNull() | (F.col("anchor") == F.col("id"))
    marked = marked.withColumn("is_cluster_representative", first).drop("anchor")
    kept = marked.where("is_cluster_representative")
    kept = kept.withColumn("llm_caption", caption(kept))
    dropped = marked.where("not is_cluster_representative").withColumn("llm_caption", F.lit(None).cast(kept.schema["llm_caption"].dataType))
    if "image_bytes" in frames.columns:
        dropped = dropped.withColumn("image_bytes", F.lit(None).cast("binary"))
    return kept.unionByName(dropped)


def records(frames: DataFrame, texts: dict[str, DataFrame]) -> DataFrame:
    """frames with a column of each of texts (name -> rows `id`, `text`, one per id), null where there is none; by video and time."""
    out = frames
    for name, t in texts.items():
        out = out.drop(name).join(t.select("id", F.col("text").alias(name)), "id", "left")
    return out.orderBy("video_id", "timestamp", "id")


def rows_of(frames: DataFrame, ids: list[str], vector: str) -> DataFrame:
    """`id`, `vec` of the frames with these ids that have a vector, in the order given."""
    asked = frames.sparkSession.createDataFrame([(n, i) for n, i in enumerate(ids)], "n int, id string")
    return F.broadcast(asked).join(frames.select("id", F.col(vector).alias("vec")).where("vec is not null"), "id").orderBy("n").select("id", "vec")
