"""What the catalogue's queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.functions import vectors as V
from framesift.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CLIP, SIGLIP = 64, 48

# One row per id: a record delivered twice is one.
K = """k as (select id, any_value(video_id) video_id, any_value("timestamp") ts, any_value(clip_embedding)::double[] clip, any_value(siglip_embedding)::double[] sig, any_value(objects) objects,
  any_value(ocr_text) ocr_text, any_value(asr_text) asr_text, any_value(llm_caption) llm_caption from keyframes where id is not null group by id)"""
L = """l as (select label_id, any_value(query) query, any_value(video_id) video_id, any_value(time_window) w from moment_labels where label_id is not null group by label_id)"""
C = """c as (select cand_id, any_value(search_id) search_id, any_value(keyframe_id) keyframe_id, any_value(score) score, any_value(video_id) video_id, any_value("timestamp") ts from candidates where cand_id is not null group by cand_id)"""


def ok(v: str, dim: int) -> str:
    """A usable vector, for DuckDB."""
    return f"{v} is not null and len({v}) = {dim} and not list_bool_or(list_transform({v}, lambda x: isnan(x))) and list_bool_or(list_transform({v}, lambda x: x <> 0))"


def query(name: str, sql: str | None = None):
    """Register a query, with what DuckDB runs for it."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


_STORED: dict[tuple, object] = {}


def stored(spark: SparkSession, d: str, name: str, table_name: str, make: Callable[[], object]) -> object:
    """What make gives, made once per session for a table as it is: an index is kept as long as the table's files are the same."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{table_name}.parquet")
    files = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    key = (spark.sparkContext.applicationId, getattr(spark.sparkContext, "_framesift_cleared", 0), name, *((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files))
    if key not in _STORED:
        _STORED[key] = make()
    return _STORED[key]


def frames(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    k = table(spark, d, "keyframes").where("id is not null")
    return (k.select("id", *columns) if columns else k).dropDuplicates(["id"])


def labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "moment_labels").where("label_id is not null").dropDuplicates(["label_id"])


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates").where("cand_id is not null").dropDuplicates(["cand_id"])


def clips(spark: SparkSession, d: str, column: str = "clip_embedding", dim: int = CLIP) -> DataFrame:
    """`id`, `video_id`, `timestamp`, `vec` of frames with a usable vector."""
    return frames(spark, d, "video_id", "timestamp", column).where(V.usable(F.col(column), dim)).withColumnRenamed(column, "vec")
