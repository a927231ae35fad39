"""BM25 (Okapi): an inverted index in the shared folder, statistics of the corpus, and ranked search for a set of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framesift.functions.text import tokenize
from framesift.session import shared_path

K1, B, EPSILON = 1.5, 0.75, 0.25
SALTS = 16


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """`key`, `tok`, `tf`, `len`: counts of words in documents and the documents' lengths. An empty text has the one word `∅`.

    One shuffle, by word and a salt of the key, so that a word of most documents goes over several tasks; sorted by word."""
    toks = F.coalesce(tokenize(F.col(text)), F.array().cast("array<string>"))
    toks = F.when(F.size(toks) == 0, F.array(F.lit("∅"))).otherwise(toks)
    rows = docs.select(F.col(key), toks.alias("toks")).select(key, F.size("toks").alias("len"), F.explode("toks").alias("tok"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS))).repartition("tok", "salt")
    return rows.groupBy("tok", "salt", key, "len").agg(F.count("*").alias("tf")).drop("salt").sortWithinPartitions("tok")


def term_stats(post: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """`tok`, `df`, `idf`: a negative idf is replaced by EPSILON times the mean over all words. n: the documents, counted if not given."""
    df = post.groupBy("tok").agg(F.count("*").alias("df"))
    n = post.select(key).distinct().count() if n is None else n
    raw = df.withColumn("raw", F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select("tok", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


@dataclass(frozen=True)
class Index:
    """A stored inverted index: `postings` sorted by word within files, `stats` of words, the number and mean length of the documents."""

    key: str
    postings: DataFrame
    stats: DataFrame
    n: int
    avgdl: float


def build(docs: DataFrame, key: str, text: str, folder: str | None = None) -> Index:
    """The inverted index of docs (one row per non-null key), written to the folder, by default a new one in the shared folder."""
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "bm25")
    postings(docs, key, text).write.mode("overwrite").parquet(f"{folder}/postings")
    post = spark.read.parquet(f"{folder}/postings")
    n = docs.select(key).count()
    term_stats(post, key, n).write.mode("overwrite").parquet(f"{folder}/stats")
    words = post.agg(F.sum("tf").alias("t")).head()["t"] or 0
    return Index(key, post, spark.read.parquet(f"{folder}/stats"), n, words / n if n else 0.0)


def score(index: Index, queries: DataFrame, query: str, query_text: str, among: DataFrame | None = None) -> DataFrame:
    """`query`, `key`, `score` of all pairs with a positive score. Words repeated in a query count repeatedly; one without words gives no rows.

    Statistics are those of all documents. among: pairs of `query` and `key` that alone are scored. The queries' words with their
    weights are the small side of the join with the postings, which are read in place and never shuffled as long as they fit a broadcast."""
    terms = queries.select(F.col(query), F.explode(tokenize(F.col(query_text))).alias("tok")).groupBy(query, "tok").agg(F.count("*").alias("qn"))
    weights = terms.join(index.stats, "tok").select(query, "tok", (F.col("qn") * F.col("idf")).alias("w"))
    found = index.postings.join(weights, "tok")
    if among is not None:
        found = found.join(among.select(query, index.key), [query, index.key], "left_semi")
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(index.avgdl)))
    return found.groupBy(query, index.key).agg(F.sum(F.col("w") * tf).alias("score")).where("score > 0")


def scores(docs: DataFrame, queries: DataFrame, key: str, text: str, query: str, query_text: str) -> DataFrame:
    """As score, over an index of docs made for the purpose."""
    return score(build(docs, key, text), queries, query, query_text)


def top_k(scored: DataFrame, by: str, score: str, key: str, k: int) -> DataFrame:
    """The k best rows of each group with their `rank`, by score rounded to 6 places, then key."""
    w = Window.partitionBy(by).orderBy(F.round(score, 6).desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
