"""Retrieval metrics over ranked runs and relevance, answer metrics, and paired statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framesift.functions.text import normalize_answer


def per_query(queries: DataFrame, runs: DataFrame, qrels: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """`query`, `recall`, `hit`, `rr`, `ap`, `ndcg`: each within the first k but rr and ap, which take the whole run. 0 without relevant rows.

    runs: `query`, `key`, `rank` from 1; qrels: `query`, `key`. Queries without a run count as 0."""
    judged = runs.join(qrels.select(query, key, F.lit(1).alias("rel")), [query, key], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    w = Window.partitionBy(query).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    judged = judged.withColumn("hits", F.sum("rel").over(w))
    top = F.col("rank") <= k
    rel = F.col("rel") == 1
    got = judged.groupBy(query).agg(
        F.sum(F.when(top, F.col("rel")).otherwise(0)).alias("top"),
        F.min(F.when(rel, F.col("rank"))).alias("first"),
        F.sum(F.when(rel, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("precisions"),
        F.sum(F.when(top & rel, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    n = qrels.groupBy(query).agg(F.count("*").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    all_ = queries.select(query).distinct().join(n, query, "left").join(got, query, "left")
    some = F.col("n").isNotNull() & F.col("top").isNotNull()
    zero = lambda c: F.round(F.when(some, c).otherwise(0.0), 6)
    return all_.select(query, zero(F.col("top") / F.col("n")).alias("recall"), zero((F.col("top") > 0).cast("double")).alias("hit"), zero(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("rr"), zero(F.col("precisions") / F.col("n")).alias("ap"), zero(F.col("dcg") / ideal).alias("ndcg"))


def mean_of(per: DataFrame, metric: str) -> DataFrame:
    """`metric`: the mean over all queries, 0 for none."""
    return per.agg(F.round(F.coalesce(F.avg(metric), F.lit(0.0)), 6).alias(metric))


def exact_match(prediction: Column, gold: Column) -> Column:
    return (normalize_answer(prediction) == normalize_answer(gold)).cast("int")


def token_f1(prediction: Column, gold: Column) -> Column:
    """F1 of the words with their numbers; 1 if both are empty, 0 if one is."""
    words = lambda c: F.filter(F.split(normalize_answer(c), " "), lambda x: x != "")
    a, b = words(prediction), words(gold)
    count = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))
    same = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, w: s + F.least(count(a, w), count(b, w)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).when(same == 0, 0.0).otherwise(2 * same / (F.size(a) + F.size(b)))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The ends of the Wilson interval; 0, 0 for n <= 0."""
    p = hits / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), mid + half)).otherwise(0.0)


def mcnemar(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """`only_a`, `only_b`, `p`: exact two-sided binomial test over the discordant pairs of hits; p is 1 without any.

    A hit that lacks its partner (null on either side) is an error: the two runs aren't over the same queries."""
    whole = F.when(F.col(a).isNull() | F.col(b).isNull(), F.raise_error(F.lit("both runs need a hit or miss for every query")).cast("int")).otherwise(F.col(a))
    pairs = pairs.select(whole.cast("int").alias(a), F.col(b).cast("int").alias(b))
    n = pairs.agg(F.count(F.when((F.col(a) == 1) & (F.col(b) == 0), 1)).alias("only_a"), F.count(F.when((F.col(a) == 0) & (F.col(b) == 1), 1)).alias("only_b"))
    total, least = F.col("only_a") + F.col("only_b"), F.least("only_a", "only_b")
    fact = lambda x: F.aggregate(F.sequence(F.lit(0), x.cast("int")), F.lit(0.0), lambda s, i: s + F.log(F.greatest(i, F.lit(1))))
    tail = F.aggregate(F.sequence(F.lit(0), least.cast("int")), F.lit(0.0), lambda s, i: s + F.exp(fact(total) - fact(i) - fact(total - i) - total * F.log(F.lit(2.0))))
    return n.withColumn("p", F.round(F.when(total == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)), 6))
