"""Rows in order, in chunks of bounded size: one long sequence goes over many tasks, and what must be known across chunks is a row for each."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.session import cut

ROWS = 500_000


def chunks(df: DataFrame, keys: list[str], rows: int = ROWS) -> DataFrame:
    """df range-sorted by the keys, read from a checkpoint; its partitions are chunks in order, of about `rows` rows or fewer."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() / rows))
    return cut(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys))


def positions(frames: DataFrame, rows: int = ROWS) -> DataFrame:
    """`video_id`, `id`, `timestamp`, `n`: the place of each frame in its video by time, then id, from 0. Frames need a video and a time."""
    kinds = dict(frames.dtypes)
    names = ["video_id", "id", "timestamp"]
    ordered = chunks(frames.where("video_id is not null and timestamp is not null").select(*names), ["video_id", "timestamp", "id"], rows)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        n = 0
        for b in batches:
            if b.num_rows:
                v = b.column(0)
                first = v[0] if first is None else first
                here = pc.sum(pc.equal(v, v[-1])).as_py()
                n = n + here if last is not None and last == v[-1] else here
                last = v[-1]
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([first.as_py()], first.type), pa.array([last.as_py()], last.type), pa.array([n])], names=["chunk", "first", "last", "n"])

    offsets: dict[int, int] = {}
    open_, held = None, 0
    for r in sorted(ordered.mapInArrow(ends, f"chunk bigint, first {kinds['video_id']}, last {kinds['video_id']}, n bigint").collect()):  # a row per chunk
        before = held if r["first"] == open_ else 0
        offsets[r["chunk"]] = before
        open_, held = r["last"], r["n"] + (before if r["first"] == r["last"] else 0)
    shared = frames.sparkSession.sparkContext.broadcast(offsets)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        video, next_ = None, shared.value.get(TaskContext.get().partitionId(), 0)
        for b in batches:
            if not b.num_rows:
                continue
            code = b.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            n = np.arange(b.num_rows) - np.repeat(start, np.diff(np.r_[start, b.num_rows]))
            if video is None or video == b.column(0)[0]:
                n[: start[1] if len(start) > 1 else b.num_rows] += next_
            video, next_ = b.column(0)[-1], int(n[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n)], names=[*names, "n"])

    return ordered.mapInArrow(number, ", ".join(f"{c} {kinds[c]}" for c in names) + ", n bigint")


def fixed_point(ordered: DataFrame, step: Callable[[dict[int, tuple]], Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]], ddl: str) -> dict[int, tuple]:
    """The state with which each chunk is entered, of a fold that hands one on from chunk to chunk.

    step(entering) makes a function of a chunk's batches to one row (chunk, state ...): the state it ends with if entered with entering[chunk].
    All chunks are folded at once from the states known so far, again and again until none changes, which is when they are those of a fold
    from the first to the last. A fold that soon forgets how it was entered is done after two rounds. States are a row per chunk."""
    entering: dict[int, tuple] = {}
    while True:
        left = sorted(ordered.mapInArrow(step(entering), ddl).collect(), key=lambda r: r[0])
        then = {}
        for r, following in zip(left, left[1:], strict=False):
            then[following[0]] = tuple(r)[1:]
        if then == entering:
            return entering
        entering = then
