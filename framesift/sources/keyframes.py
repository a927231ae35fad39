"""Reading and writing of keyframes, labels and precomputed vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.functions.text import safe_name

RAW = "id string, video_id string, timestamp double, image_path string, image_bytes binary, audio_path string, objects array<string>, source_video string, frame_idx bigint"
RECORD = "id string, video_id string, timestamp double, clip_embedding array<float>, siglip_embedding array<float>, objects array<string>, ocr_text string, asr_text string, llm_caption string, is_cluster_representative boolean, cluster_span struct<t_start:double,t_end:double>"
LABEL = "query string, video_id string, time_window array<double>"
VIDEO_SUFFIXES = ("mp4", "mkv", "avi", "mov", "webm", "m4v", "mpg", "mpeg")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of labels; further fields are left out."""
    return spark.read.option("multiLine", True).schema(LABEL).json(path)


def list_videos(spark: SparkSession, folder: str) -> DataFrame:
    """`path`, `length` of the video files in a folder and those below it. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    return files.where(F.lower(F.substring_index("path", ".", -1)).isin(*VIDEO_SUFFIXES))


def read_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """`id`, `video_id`, `vec` from files NAME.npy (a matrix) with NAME.txt (an id per line) beside some; else ids are NAME/row.

    Raises ValueError in the task if ids and rows differ in number."""
    npy = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy").load(folder).select(F.regexp_replace("path", r"\.npy$", "").alias("stem"), "content")
    ids = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(folder).select(F.regexp_replace("path", r"\.txt$", "").alias("stem"), F.decode("content", "UTF-8").alias("ids"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        for b in batches:
            for r in b.to_pylist():
                m = np.load(io.BytesIO(r["content"]), allow_pickle=False).astype(np.float32)
                name = PurePosixPath(r["stem"]).name
                keys = [f"{name}/{i}" for i in range(len(m))] if r["ids"] is None else [x.strip() for x in r["ids"].splitlines() if x.strip()]
                if len(keys) != len(m):
                    raise ValueError(f"{name}: {len(keys)} ids for {len(m)} rows")
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([name] * len(m)), pa.array(m.tolist(), pa.list_(pa.float32()))], names=["id", "video_id", "vec"])

    return npy.join(ids, "stem", "left").select("content", "ids", "stem").mapInArrow(rows, "id string, video_id string, vec array<float>")


def save_index(records: DataFrame, folder: str) -> None:
    """Records without image bytes, and the vectors of each encoder as a partition of their own."""
    columns = [c for c in records.columns if c != "image_bytes"]
    records.select(*[c for c in columns if not c.endswith("_embedding")]).write.mode("overwrite").parquet(f"{folder}/records")
    encoders = [c for c in columns if c.endswith("_embedding")]
    if encoders:
        pairs = F.explode(F.array(*(F.struct(F.lit(c.removesuffix("_embedding")).alias("encoder"), F.col(c).cast("array<float>").alias("vec")) for c in encoders)))
        records.select("id", pairs.alias("x")).select("id", "x.*").where("vec is not null").write.mode("overwrite").partitionBy("encoder").parquet(f"{folder}/vectors")


def load_index(spark: SparkSession, folder: str, encoders: tuple[str, ...] = ("clip", "siglip")) -> DataFrame:
    """The records with a column for each encoder; null where there is no vector. Columns that older files lack are null, further ones stay."""
    out = spark.read.parquet(f"{folder}/records")
    for field in spark.createDataFrame([], RECORD).schema:
        if field.name not in out.columns and not field.name.endswith("_embedding"):
            out = out.withColumn(field.name, F.lit(None).cast(field.dataType))
    vectors = spark.read.parquet(f"{folder}/vectors")
    for e in encoders:
        out = out.join(vectors.where(F.col("encoder") == e).select("id", F.col("vec").alias(f"{e}_embedding")), "id", "left")
    return out


def save_all(indexes: dict[str, DataFrame], folder: str) -> list[str]:
    """Each index below the folder under its name, made safe for a path; the paths. Raises ValueError if two names come to one."""
    spark = next(iter(indexes.values())).sparkSession if indexes else None
    paths = []
    for name, records in indexes.items():
        path = f"{folder}/{spark.range(1).select(safe_name(F.lit(name)).alias('x')).head()['x']}"
        if path in paths:
            raise ValueError(f"two indexes would be written to {path}")
        save_index(records, path)
        paths.append(path)
    return paths


def enrich(raw: DataFrame, providers: dict[str, Callable[[DataFrame], Column]]) -> DataFrame:
    """raw with a column from each provider (an expression or an Arrow UDF over raw's columns)."""
    return raw.withColumns({name: provider(raw) for name, provider in providers.items()})


def mock_vectors(dim: int, salt: str, noise: float = 0.0) -> Callable[[DataFrame], Column]:
    """A provider of unit vectors that depend on the id and salt only, in place of an encoder. noise: how far each is moved in a second
    direction of its own."""
    def provide(df: DataFrame) -> Column:
        def one(key: str) -> list[float]:
            import hashlib

            seed = int.from_bytes(hashlib.sha256(f"{salt}:{key}".encode()).digest()[:8], "little")
            rng = np.random.default_rng(seed)
            v = rng.standard_normal(dim)
            v = v / np.linalg.norm(v)
            if noise:
                v = v + noise * rng.standard_normal(dim) / np.sqrt(dim)
            return (v / np.linalg.norm(v)).astype(np.float32).tolist()

        def run(ids: pd.Series) -> pd.Series:
            return ids.map(one)

        return F.pandas_udf(run, "array<float>")(df["id"])

    return provide


def ocr_text(hits: Column, least: float = 0.3) -> Column:
    """The texts of hits (array of struct text, conf) with enough confidence, joined by a space; blank ones are left out."""
    kept = F.filter(hits, lambda h: (h["conf"] >= least) & (F.trim(h["text"]) != ""))
    return F.array_join(F.transform(kept, lambda h: h["text"]), " ")
