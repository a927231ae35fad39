"""Made-up tables for tests and benches; all are functions of the row number and a seed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.functions import text as T

# What the frames of a scene show, scene after scene.
SCENES = [["person", "hat"], ["car", "street"], ["cake", "candle"]]


def sample_video(spark: SparkSession, video: str, frames: int = 6, scene: int = 3, every_s: float = 2.0) -> DataFrame:
    """`id`, `video_id`, `timestamp`, `objects` of a video whose scenes of `scene` frames each show something else."""
    shown = F.array(*(F.array(*map(F.lit, s)) for s in SCENES))
    n = F.col("n")
    return spark.range(frames).withColumnRenamed("id", "n").select(F.concat(F.lit(f"{video}/"), n.cast("string")).alias("id"), F.lit(video).alias("video_id"), (n * every_s).alias("timestamp"), F.get(shown, (F.floor(n / scene) % len(SCENES)).cast("int")).alias("objects"))


def _unit(v: Column) -> Column:
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: (x / n).cast("float"))


def unit_vectors(spark: SparkSession, n: int, dim: int, seed: int = 0) -> DataFrame:
    """`row`, `vec`: directions spread evenly over the sphere."""
    return spark.range(n).select(F.col("id").alias("row"), F.array(*(F.randn(seed + i) for i in range(dim))).alias("v")).select("row", _unit(F.col("v")).alias("vec"))


def clustered_vectors(spark: SparkSession, n: int, dim: int, spread: float = 0.3, seed: int = 0, clusters: int | None = None) -> DataFrame:
    """`row`, `vec`: directions around `clusters` centres (by default one for 500 rows, ten at least), each element apart by spread / root of dim."""
    clusters = clusters or max(10, n // 500)
    centres = unit_vectors(spark, clusters, dim, seed + 10_000).select(F.col("row").alias("c"), F.col("vec").alias("m"))
    noise = F.array(*(F.randn(seed + i) * (spread / math.sqrt(dim)) for i in range(dim)))
    rows = spark.range(n).select(F.col("id").alias("row"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(clusters)).alias("c"), noise.alias("e"))
    return rows.join(F.broadcast(centres), "c").select("row", _unit(F.zip_with("m", "e", lambda x, y: x + y)).alias("vec"))  # clusters are few


def lifelog(spark: SparkSession, n: int = 200, seed: int = 42, target: dict[str, str] | None = None) -> DataFrame:
    """`id`, `video_id`, `timestamp`, `objects` (attribute tags), `llm_caption`: moments with a value of each attribute; row 0 is the target's."""
    pick = lambda a, i: F.get(F.array(*map(F.lit, T.VALUE_WORDS[a])), F.pmod(F.xxhash64("id", F.lit(seed + i)), F.lit(len(T.VALUE_WORDS[a]))).cast("int"))
    wanted = target or {a: next(iter(T.VALUE_WORDS[a])) for a in T.ATTRIBUTES}
    entries = [x for i, a in enumerate(T.ATTRIBUTES) for x in (F.lit(a), F.when(F.col("id") == 0, F.lit(wanted.get(a))).otherwise(pick(a, i)))]
    rows = spark.range(n).withColumn("a", F.create_map(*entries))
    return rows.select(F.format_string("life/%d", "id").alias("id"), F.lit("life").alias("video_id"), F.col("id").cast("double").alias("timestamp"), T.attributes_to_tags(F.col("a")).alias("objects"), T.attributes_to_caption(F.col("a")).alias("llm_caption"))


def labelled_items(spark: SparkSession, categories: int = 5, items: int = 6) -> tuple[DataFrame, DataFrame]:
    """(documents `id`, `text`; queries `query_id`, `text`, `target`): each item has a word of its own beside that of its category."""
    d = spark.range(categories * items).select(F.format_string("item%d", "id").alias("id"), F.concat(F.lit("category"), F.floor(F.col("id") / items).cast("string"), F.lit(" token"), F.col("id").cast("string")).alias("text"))
    return d, d.select(F.col("id").alias("query_id"), F.concat(F.lit("find "), F.element_at(F.split("text", " "), 2)).alias("text"), F.col("id").alias("target"))
