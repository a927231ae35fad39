"""Weighted reciprocal-rank fusion of ranked lists, and hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rrf(lists: dict[str, DataFrame], query: str, key: str, k: int = 60, weights: dict[str, float] | None = None, depth: int | None = 1000) -> DataFrame:
    """`query`, `key`, `score`, `sources` (name:rank, ...), `rank`: sum of weight / (k + rank) over the lists that have the row.

    lists: name -> rows with `query`, `key` and `rank` from 1, in the order that decides ties; each is cut at depth, whatever number of
    results is wanted. Ties go by the first list that has the row, its rank there, then key."""
    parts = []
    for n, (name, df) in enumerate(lists.items()):
        df = df if depth is None else df.where(F.col("rank") <= depth)
        w = (weights or {}).get(name, 1.0)
        parts.append(df.select(query, key, F.lit(n).alias("list"), F.lit(name).alias("name"), F.col("rank").alias("r"), (F.lit(float(w)) / (k + F.col("rank"))).alias("s")))
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionAll(p)
    named = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("list", "name", "r"))), lambda x: F.concat(x["name"], F.lit(":"), x["r"].cast("string"))), ",")
    fused = all_.groupBy(query, key).agg(F.sum("s").alias("score"), F.min(F.struct("list", "r")).alias("first"), named.alias("sources"))
    w = Window.partitionBy(query).orderBy(F.round("score", 9).desc(), "first.list", "first.r", key)
    return fused.withColumn("rank", F.row_number().over(w)).drop("first")
