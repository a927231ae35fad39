"""Predicates on keyframe records. An empty or null condition sets no bound; all together are a conjunction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def condition(videos: list[str] | None = None, objects_all: list[str] | None = None, objects_any: list[str] | None = None, time_range: tuple[float, float] | None = None) -> Column | None:
    """The conjunction of the given bounds, or None. Times are inclusive at both ends."""
    parts = []
    if videos:
        parts.append(F.col("video_id").isin(videos))
    if objects_all:
        parts.append(F.size(F.array_except(F.array(*map(F.lit, objects_all)), "objects")) == 0)
    if objects_any:
        parts.append(F.arrays_overlap("objects", F.array(*map(F.lit, objects_any))))
    if time_range:
        parts.append(F.col("timestamp").between(*time_range))
    return reduce(lambda a, b: a & b, parts) if parts else None


def apply(df: DataFrame, **bounds) -> DataFrame:
    c = condition(**bounds)
    return df if c is None else df.where(c)


def attribute_filter(df: DataFrame, attributes: str, wanted: dict[str, str | None]) -> DataFrame:
    """Rows whose attribute map has the wanted values; None sets no bound."""
    for k, v in wanted.items():
        if v is not None:
            df = df.where(F.col(attributes)[k] == v)
    return df


def temporal_window(df: DataFrame, video: str, center: float | None, width: float) -> DataFrame:
    """Rows of a video at most width from center; all of them without one."""
    df = df.where(F.col("video_id") == video)
    return df if center is None else df.where(F.abs(F.col("timestamp") - center) <= width)
