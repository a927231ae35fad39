"""Frames of videos by a decoder that is given, thinned to one every so many seconds and freed of those that hardly differ."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.sources.keyframes import VIDEO_SUFFIXES

FRAMES = "id string, video_id string, timestamp double, frame_idx bigint, source_video string, histogram array<float>"
FPS = 25.0  # where a video doesn't say
BINS = (50, 60)  # of hue and saturation

#: (content, step) -> frames a second (None: unknown), and each step-th frame with its number, as height x width x 3 bytes of red, green, blue
Decoder = Callable[[bytes, Callable[[float], int]], tuple[float | None, Iterator[tuple[int, np.ndarray]]]]


def step_of(fps: float | None, every_s: float) -> int:
    """How many frames apart samples are: at least one."""
    return max(1, round((fps or FPS) * every_s))


def npy_decoder(content: bytes, step: Callable[[float | None], int]) -> tuple[float | None, Iterator[tuple[int, np.ndarray]]]:
    """Frames from an array file of n x height x width x 3 bytes; it stands for a codec and doesn't know a rate."""
    x = np.load(io.BytesIO(content), allow_pickle=False)
    return None, ((i, x[i]) for i in range(0, len(x), step(None)))


def hsv_histogram(rgb: np.ndarray) -> np.ndarray:
    """Shares of hue (0 to 180) and saturation (0 to 256) of the pixels, BINS of each, scaled to a range of 0 to 1."""
    x = rgb.reshape(-1, 3).astype(np.float64)
    high, low = x.max(1), x.min(1)
    span = high - low
    safe = np.where(span == 0, 1, span)
    r, g, b = x.T
    hue = np.where(high == r, (g - b) / safe, np.where(high == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) * 30 % 180
    hue = np.where(span == 0, 0, hue)
    saturation = np.where(high == 0, 0, span / np.where(high == 0, 1, high)) * 255
    h, _, _ = np.histogram2d(hue, saturation, bins=BINS, range=((0, 180), (0, 256)))
    h -= h.min()
    return (h / h.max() if h.max() else h).ravel().astype(np.float32)


def differs(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether the correlation of two histograms is below the threshold; constant ones are alike."""
    a, b = a - a.mean(), b - b.mean()
    n = np.sqrt((a @ a) * (b @ b))
    return bool(n) and float(a @ b / n) < threshold


def read_frames(spark: SparkSession, folder: str, decoder: Decoder = npy_decoder, suffixes: tuple[str, ...] = VIDEO_SUFFIXES, every_s: float = 1.0, threshold: float | None = 0.985, max_frames: int | None = None) -> DataFrame:
    """The frames kept of each video of a folder and those below it (columns FRAMES): one every `every_s` seconds, without those whose
    histogram correlates with that of the last one kept by the threshold or more (None keeps all), at most max_frames.

    ids are VIDEO/number of the frame kept. A task decodes whole videos, frame by frame; a file that can't be decoded raises there."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = files.where(F.lower(F.substring_index("path", ".", -1)).isin(*suffixes)).select("path", "content")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                fps, frames = decoder(r["content"], lambda f: step_of(f, every_s))
                name = PurePosixPath(r["path"]).stem
                rows, last = [], None
                for i, rgb in frames:
                    if max_frames is not None and len(rows) >= max_frames:
                        break
                    h = hsv_histogram(rgb)
                    if threshold is not None and last is not None and not differs(last, h, threshold):
                        continue
                    last = h
                    rows.append((f"{name}/{len(rows)}", name, i / (fps or FPS), i, r["path"], h))
                cols = list(zip(*rows, strict=True)) or [()] * 6
                types = (pa.string(), pa.string(), pa.float64(), pa.int64(), pa.string(), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["id", "video_id", "timestamp", "frame_idx", "source_video", "histogram"])

    return files.mapInArrow(decode, FRAMES)
