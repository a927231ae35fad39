"""Nearest neighbours: exact search for a set of queries, and approximate search by a stored index of inverted lists and by hashing.

Vectors are never shuffled: a block of queries goes to the tasks, each keeps the k best of all its rows for every query, and only these meet.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framesift.session import shared_path

SLICE = 512  # queries whose similarities to a batch are held at once
LISTS = 4096  # lists of an index at most


def _unit(col: pa.Array, dim: int) -> np.ndarray:
    m = col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(n == 0, 1, n)


class Best:
    """The k best (similarity descending, then key) of what was added for each query."""

    def __init__(self, k: int):
        self.k, self.rows, self.sims, self.keys, self.bar = k, np.zeros(0, np.int64), np.zeros(0), None, None

    def add(self, sim: np.ndarray, keys: np.ndarray) -> None:
        """sim: a row per query, a column per key; -inf for pairs that take no part."""
        m = min(self.k, sim.shape[1])
        bar = np.partition(sim, sim.shape[1] - m, axis=1)[:, sim.shape[1] - m]
        bar = bar if self.bar is None else np.maximum(bar, self.bar)
        r, c = np.nonzero((sim >= bar[:, None]) & (sim > -np.inf))
        rows, sims, found = np.r_[self.rows, r], np.r_[self.sims, sim[r, c]], keys[c] if self.keys is None else np.r_[self.keys, keys[c]]
        order = np.lexsort((found, -sims, rows))
        rows, sims, found = rows[order], sims[order], found[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = rank < self.k
        self.rows, self.sims, self.keys = rows[kept], sims[kept], found[kept]
        self.bar = np.full(len(sim), -np.inf)
        last = rank[kept] == self.k - 1
        self.bar[self.rows[last]] = self.sims[last]


def _search(vectors: DataFrame, queries: DataFrame, key: str, vector: str, query: str, query_vector: str, k: int, dim: int, block: int, meets: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """`query`, `key`, `similarity`, `rank`. meets: of the unit vectors of queries and of rows a matrix of those that are compared; None: all."""
    spark = queries.sparkSession
    slices = max(1, math.ceil(queries.count() / (0.8 * block)))
    kinds = vectors.schema[key].dataType.simpleString(), queries.schema[query].dataType.simpleString()
    found = []
    for s in range(slices):
        part = queries.where(F.pmod(F.xxhash64(query), F.lit(slices)) == s).select(query, query_vector).toArrow()
        if not part.num_rows:
            continue
        shared = spark.sparkContext.broadcast((part[query].combine_chunks(), _unit(part[query_vector].combine_chunks(), dim)))

        def near(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            best = [Best(k) for _ in range(0, len(q), SLICE)]
            kind = None
            for b in batches:
                if not b.num_rows:
                    continue
                kind = b.schema.field(0).type
                u, keys = _unit(b.column(1), dim), b.column(0).to_numpy(zero_copy_only=False)
                keys = keys.astype("U") if keys.dtype == object else keys
                for n, held in enumerate(best):
                    asks = q[n * SLICE : (n + 1) * SLICE]
                    if meets is None:
                        held.add(np.round(asks @ u.T, 6), keys)
                        continue
                    pairs = meets(asks, u)
                    some = np.flatnonzero(pairs.any(0))
                    if len(some):
                        held.add(np.where(pairs[:, some], np.round(asks @ u[some].T, 6), -np.inf), keys[some])
            for n, held in enumerate(best):
                if held.keys is not None and len(held.keys):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(held.rows + n * SLICE)), pa.array(held.keys).cast(kind), pa.array(held.sims)], names=["q", "id", "similarity"])

        found.append(vectors.select(key, vector).mapInArrow(near, f"q {kinds[1]}, id {kinds[0]}, similarity double"))
    if not found:
        return spark.createDataFrame([], f"{query} {kinds[1]}, {key} {kinds[0]}, similarity double, rank int")
    all_ = found[0]
    for f in found[1:]:
        all_ = all_.unionAll(f)
    w = Window.partitionBy("q").orderBy(F.col("similarity").desc(), "id")
    return all_.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("q").alias(query), F.col("id").alias(key), "similarity", "rank")


def batch_knn(vectors: DataFrame, queries: DataFrame, key: str, vector: str, query: str, query_vector: str, k: int, dim: int, block: int = 20_000) -> DataFrame:
    """`query`, `key`, `similarity`, `rank`: the k rows of vectors most similar to each query by cosine, itself not left out.

    The queries are taken in blocks of at most `block` by hash. Vectors must be usable (see functions.vectors.usable). Ties go by key."""
    return _search(vectors, queries, key, vector, query, query_vector, k, dim, block)


@dataclass(frozen=True)
class Ivf:
    """A stored index: rows of `key`, `vector` in folders by `list`, and the lists' centroids."""

    rows: DataFrame
    centroids: np.ndarray
    key: str
    vector: str


def ivf_build(vectors: DataFrame, key: str, vector: str, dim: int, lists: int | None = None, sample: int = 131_072, folder: str | None = None) -> Ivf:
    """The index of the vectors. lists: by default the root of their number, 32 at least and LISTS at most. The centroids come from at most
    `sample` rows, by lowest hash of the key; every row is indexed."""
    spark = vectors.sparkSession
    n = vectors.count()
    lists = lists or min(LISTS, max(32, round(math.sqrt(n))))
    part = min(1.0, min(sample, 32 * lists) / max(1, n))
    seen = vectors.where(F.pmod(F.xxhash64(key), F.lit(1_000_003)) <= math.ceil(1_000_003 * part)).select(vector).limit(2 * sample).toArrow()
    x = _unit(seen[vector].combine_chunks(), dim) if seen.num_rows else np.ones((1, dim))
    rng = np.random.default_rng(0)
    c = x[rng.permutation(len(x))[:lists]]
    for _ in range(10):
        own = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where((np.bincount(own, minlength=len(c)) > 0)[:, None], total, c)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    shared = spark.sparkContext.broadcast(c)
    kind = vectors.schema[key].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own = np.argmax(_unit(b.column(1), dim) @ shared.value.T, axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32))], names=[key, vector, "list"])

    folder = folder or shared_path(spark, "ivf")
    rows = vectors.select(key, F.col(vector).cast("array<float>")).mapInArrow(assign, f"`{key}` {kind}, `{vector}` array<float>, list int")
    # sorted by list and hash, so that a list is one run of rows, over several files if it is a large one
    rows.repartitionByRange(F.col("list"), F.xxhash64(key)).sortWithinPartitions("list").write.mode("overwrite").partitionBy("list").parquet(folder)
    return Ivf(spark.read.schema(f"`{key}` {kind}, `{vector}` array<float>, list int").parquet(folder), c, key, vector)


def ivf_search(index: Ivf, queries: DataFrame, query: str, query_vector: str, k: int, dim: int, probes: int | None = None, block: int = 20_000) -> DataFrame:
    """As batch_knn, but each query meets the rows of its `probes` nearest lists only; others aren't read. By default 70 % of the lists, which
    vectors that hardly cluster need for a recall of 0.9; few are enough where they do."""
    c = index.centroids
    probes = min(len(c), probes or math.ceil(0.7 * len(c)))
    nearest = lambda q: np.argpartition(-(q @ c.T), probes - 1, axis=1)[:, :probes]
    # a block of queries at a time: which lists any of them meets
    n = queries.count()
    rows = index.rows
    if n <= block and n:
        asked = queries.select(query_vector).toArrow()
        met = np.unique(nearest(_unit(asked[query_vector].combine_chunks(), dim))).tolist()
        rows = rows.where(F.col("list").isin(met)) if len(met) < len(c) else rows
    shared = queries.sparkSession.sparkContext.broadcast(c)

    def meets(q: np.ndarray, u: np.ndarray) -> np.ndarray:
        c = shared.value
        probed = np.zeros((len(q), len(c)), bool)
        np.put_along_axis(probed, np.argpartition(-(q @ c.T), probes - 1, axis=1)[:, :probes], True, axis=1)
        return probed[:, np.argmax(u @ c.T, axis=1)]

    return _search(rows, queries, index.key, index.vector, query, query_vector, k, dim, block, meets)


def ivf_knn(vectors: DataFrame, queries: DataFrame, key: str, vector: str, query: str, query_vector: str, k: int, dim: int, lists: int | None = None, probes: int | None = None) -> DataFrame:
    """ivf_search over an index of the vectors made for the purpose."""
    return ivf_search(ivf_build(vectors, key, vector, dim, lists), queries, query, query_vector, k, dim, probes)


def lsh_knn(vectors: DataFrame, queries: DataFrame, key: str, vector: str, query: str, query_vector: str, k: int, dim: int, tables: int = 24, bits: int = 4, seed: int = 5, block: int = 20_000) -> DataFrame:
    """As batch_knn, but a query meets the rows that share one of its `tables` hashes of `bits` hyperplanes."""
    planes = np.random.default_rng(seed).standard_normal((tables * bits, dim))

    def meets(q: np.ndarray, u: np.ndarray) -> np.ndarray:
        a, b = ((x @ planes.T > 0).reshape(len(x), tables, bits) @ (1 << np.arange(bits)) for x in (q, u))
        out = np.zeros((len(q), len(u)), bool)
        for t in range(tables):
            out |= a[:, t, None] == b[None, :, t]
        return out

    return _search(vectors, queries, key, vector, query, query_vector, k, dim, block, meets)


def recall(found: DataFrame, exact: DataFrame, query: str, key: str) -> DataFrame:
    """`recall`, `score_ratio`: the share of the exact pairs that were found, and the ratio of the sums of similarities."""
    both = exact.join(found.select(query, key, F.lit(1).alias("hit")), [query, key], "left")
    got = found.agg(F.sum("similarity").alias("got"))
    return both.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"), F.sum("similarity").alias("all")).join(F.broadcast(got)).select(F.round("recall", 6).alias("recall"), F.round(F.col("got") / F.col("all"), 6).alias("score_ratio"))
