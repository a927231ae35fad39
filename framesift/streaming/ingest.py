"""Streaming ingest: collapse of near-duplicates with an anchor per video kept as state, late and repeated frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from framesift.operators.dedup import Anchors

KEPT = "video_id string, id string, timestamp double"
STATE = "anchor string, vec array<double>, last double"


def collapse_stream(frames: DataFrame, vector: str, threshold: float = 0.97, idle: int | None = None) -> DataFrame:
    """Of a stream of frames those that start a cluster: `video_id`, `id`, `timestamp`.

    Frames of a video are taken by time within a micro-batch; one that is older than the last one taken is late and left out. The state of
    a video is its anchor; if `idle` is given, it is dropped once nothing came for so many ms (such a query wakes up without new rows). On ordered input the result is that of
    operators.dedup.anchor_clusters. A video's frames of one micro-batch are sorted in one task, so bound the source's trigger
    (maxFilesPerTrigger, maxBytesPerTrigger), as read_bounded does."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        anchor, vec, last = state.get if state.exists else (None, None, float("-inf"))
        fold = Anchors(threshold, "cosine", None if anchor is None else (key[0], anchor, vec))
        rows = pd.concat(list(batches)).sort_values(["timestamp", "id"], kind="stable")
        rows = rows[rows["timestamp"] >= last]
        if len(rows):
            b = pa.RecordBatch.from_arrays([pa.array([key[0]] * len(rows)), pa.array(rows["timestamp"]), pa.array(rows["id"]), pa.array(list(rows["vec"]), pa.list_(pa.float64()))], names=["video_id", "t", "id", "vec"])
            own = np.array(fold.add(b), object) == rows["id"].to_numpy()
            own &= ~rows["id"].duplicated().to_numpy() & (rows["id"].to_numpy() != anchor)  # an anchor delivered again opens nothing
            state.update((fold.anchor, fold.vec.tolist(), float(rows["timestamp"].iloc[-1])))
            rows = rows[own]
        if idle is not None:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame({"video_id": [key[0]] * len(rows), "id": rows["id"].to_numpy(), "timestamp": rows["timestamp"].to_numpy()})

    rows = frames.where(F.col("video_id").isNotNull() & F.col("timestamp").isNotNull() & F.col(vector).isNotNull())
    rows = rows.select("video_id", "id", "timestamp", F.col(vector).cast("array<double>").alias("vec"))
    return rows.groupBy("video_id").applyInPandasWithState(step, KEPT, STATE, "append", GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout)


def read_bounded(spark: SparkSession, path: str, schema: str | StructType, files: int = 4) -> DataFrame:
    """A stream of a folder's Parquet files, oldest first, of which a micro-batch takes at most `files`: what isn't worked off yet waits there."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("latestFirst", False).parquet(path)


class Progress(StreamingQueryListener):
    """Calls back with the rows taken in so far, query by query, and with the error that ends one."""

    def __init__(self, told: Callable[[str, int], None], failed: Callable[[str, str], None] | None = None):
        self.told, self.failed, self.rows = told, failed, {}

    def onQueryStarted(self, event) -> None:  # noqa: N802 - Spark's name
        self.rows[str(event.id)] = 0

    def onQueryProgress(self, event) -> None:  # noqa: N802
        key = str(event.progress.id)
        self.rows[key] = self.rows.get(key, 0) + event.progress.numInputRows
        self.told(key, self.rows[key])

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.exception and self.failed:
            self.failed(str(event.id), event.exception)


def deliver_once(frames: DataFrame, key: str = "id", arrival: str = "ingested_at", delay: str = "7 days") -> DataFrame:
    """A stream without repeated keys, as long as a repetition arrives within the delay; the state is dropped after it."""
    return frames.withWatermark(arrival, delay).dropDuplicatesWithinWatermark([key])


def activity(events: DataFrame, window: str = "10 minutes", slide: str = "5 minutes", delay: str = "1 hour") -> DataFrame:
    """Counts of events by type in sliding windows; rows later than the delay are left out."""
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", window, slide), "event_type")
    return w.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
