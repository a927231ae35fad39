"""Reports of evaluations and benches: metrics, percentiles of times, and what a larger index would take."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def percentiles(times: DataFrame, column: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """`p50`, `p95`, ...: of n sorted values the one at place int(share * n), the last at most; null for none."""
    n = times.where(F.col(column).isNotNull()).agg(F.count("*").alias("n"), *(F.expr(f"percentile_disc({s}) within group (order by {column})").alias(f"p{round(100 * s)}") for s in shares))
    return n.drop("n")


def extrapolate(points: DataFrame, size: str, *measures: str, to: list[int]) -> DataFrame:
    """`size` and each measure at the sizes `to`, in proportion to those of the largest size measured."""
    top = points.agg(F.max_by(F.struct(F.col(size).alias("__n"), *measures), size).alias("x")).select("x.*")
    wanted = points.sparkSession.createDataFrame([(t,) for t in to], f"{size} bigint")
    return wanted.join(F.broadcast(top)).select(size, *(F.round(F.col(m) * F.col(size) / F.col("__n"), 6).alias(m) for m in measures))  # one row on the right


def write_report(spark: SparkSession, path: str, parts: dict[str, DataFrame | dict | float | str]) -> dict:
    """A JSON file of the named parts, tables as lists of rows, written to any file system of Hadoop's; the same as a dictionary. Tables
    are summaries: they are collected."""
    out = {k: [r.asDict(recursive=True) for r in v.collect()] if isinstance(v, DataFrame) else v for k, v in parts.items()}
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        stream.write(json.dumps(out, ensure_ascii=False, default=str).encode())
    finally:
        stream.close()
    return out
