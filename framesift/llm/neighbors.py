"""The k most similar vectors of every vector, by an inverted multi-index.

Both halves of the unit vectors are quantised on their own; a cell is a pair of centroids, its list holds the vectors next
to them. The entries lie in the shared folder sorted by cell, in files of bounded size, so a dense cell goes over many of them. Each
query traverses the centroid pairs by summed distance, each from its own distances, until it has met enough entries: the pairs that a
heap can pop early lie under a hyperbola of ranks and are sorted for many queries at once, the heap itself runs where those don't
do. The lists that the queries of one cell meet are ranked for all of these by exact cosine, in one product. Files on a local file system
are mapped, so that lists far apart aren't read again and again; from others, batches are read and some kept.

Equal vectors are one entry with its first ids; those beyond are answered from it by a join. The codebooks are learned from a
bounded sample (`sample` vectors, chosen by hash); all vectors are indexed and all are queries. A cell is always ranked whole, so a
dense group of different vectors costs its square, in blocks spread over tasks; nothing of it is left out.
"""

from __future__ import annotations

import bisect
import heapq
import math
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framesift.session import cut, shared_fs, shared_path

FILE, BATCH = 65_536, 2_048  # rows
QUERIES, BLOCK = 256, 4_096  # queries and entries of one product at most
CODES = 2_048  # centroids of a half at most, so that the counts of all cells take 16 MB


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k centroids of the rows of x; fewer if x has fewer different rows."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The row of c next to each row of x."""
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmin(half - x[i : i + 8192] @ c.T, axis=1) for i in range(0, len(x), 8192)]) if len(x) else np.zeros(0, np.int64)


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """The vectors as rows of unit length."""
    v = col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return (v / np.sqrt((v * v).sum(1, keepdims=True))).astype(np.float32)


class Lists:
    """The entries of the index by row number. Local files are mapped; of others, at most about `mb` of what was read are kept."""

    def __init__(self, files: list[str], starts: np.ndarray, dim: int, mb: int = 160):
        self.files, self.starts, self.dim, self.left = files, starts.tolist(), dim, mb << 20
        self.kept: OrderedDict[tuple[int, int], tuple] = OrderedDict()
        self.mapped: dict[int, pa.ipc.RecordBatchFileReader] = {}

    def batch(self, row: int) -> tuple[int, np.ndarray, pa.Array]:
        """The first row of the batch that holds a row, its vectors and ids."""
        f = bisect.bisect_right(self.starts, row) - 1
        at = f, (row - self.starts[f]) // BATCH
        got = self.kept.get(at)
        if got is None:
            b = self.read(f, at[1])
            got = self.starts[f] + at[1] * BATCH, b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, self.dim), b.column("ids")
            self.kept[at] = got
            if f in self.mapped:  # views, which take no memory
                return got
            self.left -= b.nbytes
            while self.left < 0 and len(self.kept) > 1:
                old = self.kept.popitem(last=False)[1]
                self.left += old[1].nbytes + old[2].nbytes
        else:
            self.kept.move_to_end(at)
        return got

    def read(self, f: int, number: int) -> pa.RecordBatch:
        if f not in self.mapped:
            fs, path = shared_fs(self.files[f])
            if not isinstance(fs, pafs.LocalFileSystem):
                with fs.open_input_file(path) as x:
                    return pa.ipc.open_file(x).get_batch(number)
            self.mapped[f] = pa.ipc.open_file(pa.memory_map(path))
        return self.mapped[f].get_batch(number)

    def vectors(self, lo: int, hi: int) -> np.ndarray:
        first, vec, _ = self.batch(lo)
        if hi <= first + len(vec):
            return vec[lo - first : hi - first]
        parts = []
        while lo < hi:
            first, vec, _ = self.batch(lo)
            parts.append(vec[lo - first : hi - first])
            lo += len(parts[-1])
        return np.concatenate(parts)

    def ids(self, rows: np.ndarray) -> dict[int, list[str]]:
        """The ids of each of the rows."""
        rows, out, i = np.unique(rows), {}, 0
        while i < len(rows):
            first, vec, ids = self.batch(int(rows[i]))
            j = int(np.searchsorted(rows, first + len(vec)))
            here = ids.take(pa.array(rows[i:j] - first))
            names, ends = here.flatten().to_pylist(), np.cumsum(here.value_lengths().to_numpy()).tolist()
            out.update((row, names[lo:hi]) for row, lo, hi in zip(rows[i:j].tolist(), [0, *ends[:-1]], ends, strict=True))
            i = j
        return out


def ascending(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the columns by value, and the values."""
    order = np.argsort(d, axis=1)
    return order, np.take_along_axis(d, order, 1)


def traverse(o1: list[int], a1: list[float], o2: list[int], a2: list[float], counts: np.ndarray, enough: int, least: int = 1) -> list[tuple[int, int]]:
    """Centroid pairs by summed distance (o: centroids of a half, a: their distances, ascending), until `least` lists were met that hold
    `enough` entries; empty ones are left out."""
    heap, found, n = [(a1[0] + a2[0], 0, 0)], [], 0
    while heap and (n < enough or len(found) < least):
        _, a, b = heapq.heappop(heap)
        if b + 1 < len(a2):
            heapq.heappush(heap, (a1[a] + a2[b + 1], a, b + 1))
        if b == 0 and a + 1 < len(a1):
            heapq.heappush(heap, (a1[a + 1] + a2[0], a + 1, 0))
        here = int(counts[o1[a], o2[b]])
        if here:
            found.append((o1[a], o2[b]))
            n += here
    return found


def traverse_all(o1: np.ndarray, a1: np.ndarray, o2: np.ndarray, a2: np.ndarray, counts: np.ndarray, enough: int, least: int = 1, pops: int = 64) -> np.ndarray:
    """The cells (row times columns of counts, plus column) that `traverse` finds for any of the queries, one a row of each array.

    When the heap pops (a, b), it has popped all (a', b') with a' <= a and b' <= b before. So its first `pops` pairs have
    (a + 1) (b + 1) <= pops: these are sorted for all queries at once. Queries that need more have four times as many, at last the heap."""
    found, width, left = np.zeros(counts.size, bool), counts.shape[1], np.arange(len(o1))
    while len(left) and pops <= 4096:
        ranks = [(a, b) for a in range(min(pops, a1.shape[1])) for b in range(min(pops // (a + 1), a2.shape[1]))]
        ra, rb = np.array(ranks).T
        step, again = max(1, 2_000_000 // len(ranks)), []
        for i in range(0, len(left), step):
            q = left[i : i + step]
            order = np.argsort(a1[q].take(ra, axis=1) + a2[q].take(rb, axis=1), axis=1)
            cell = np.take_along_axis(o1[q].take(ra, axis=1) * width + o2[q].take(rb, axis=1), order, 1)
            n = counts.take(cell)
            short = (np.cumsum(n, axis=1) < enough) | (np.cumsum(n > 0, axis=1) < least)
            popped = short.sum(1) + 1
            done = (popped <= pops) | (len(ranks) == counts.size)  # all pairs there are
            here = done[:, None] & (np.arange(len(ranks)) < popped[:, None]) & (n > 0)
            found[cell[here]] = True
            again.append(left[i : i + step][~done])
        left, pops = np.concatenate(again), 4 * pops
    for q in left.tolist():
        for i, j in traverse(o1[q].tolist(), a1[q].tolist(), o2[q].tolist(), a2[q].tolist(), counts, enough, least):
            found[i * width + j] = True
    return np.flatnonzero(found)


def best_of(sim: np.ndarray, m: int, low: float) -> tuple[np.ndarray, np.ndarray]:
    """(column, row) of the m highest elements of each column that are at least low, or of more of those."""
    at = np.flatnonzero(sim >= low)
    if len(at) <= 4 * m * sim.shape[1]:
        return np.divmod(at, sim.shape[1])[::-1]
    sim = np.ascontiguousarray(sim.T)
    best = np.argpartition(sim, sim.shape[1] - m, axis=1)[:, -m:]
    rows, cols = np.nonzero(np.take_along_axis(sim, best, 1) >= low)
    return rows, best[rows, cols]


class Search:
    """Answers queries that are entries of the index."""

    def __init__(self, books: tuple, files: list[str], starts: np.ndarray, counts: np.ndarray, dim: int, k: int, low: float, scan: int, cells: int):
        self.books, self.counts, self.k, self.low, self.scan, self.cells = books, counts, k, low, scan, cells
        self.flat = counts.ravel()
        self.first = np.cumsum(self.flat, dtype=np.int64) - self.flat  # the row with which a cell begins
        self.lists = Lists(files, starts, dim)
        self.cand, self.sim = np.empty((BLOCK, dim), np.float32), np.empty(QUERIES * BLOCK, np.float32)  # taken once, as new pages cost time
        self.full, self.total = np.flatnonzero(self.flat), int(self.flat.sum())
        self.pops = 1 << max(4, math.ceil(math.log2(1.5 * max(cells, scan / max(1.0, self.flat.mean())))))

    def near(self, q: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, similarity) of the best entries of each query, by query and similarity descending; own: the row of the first query."""
        half = self.books[0].shape[1]
        if self.scan >= self.total:
            met = self.full
        else:
            d1, d2 = (((b * b).sum(1) - 2 * x @ b.T) for b, x in zip(self.books, (q[:, :half], q[:, half:]), strict=True))
            met = traverse_all(*ascending(d1), *ascending(d2), self.counts, self.scan, self.cells, self.pops)
            met = np.union1d(met, [np.searchsorted(self.first, own, "right") - 1])
        m = 2 * self.k + 3  # the query itself may be among them
        found: list[tuple] = []
        for block in self.blocks(met):
            n = sum(hi - lo for lo, hi in block)
            cand = np.concatenate([self.lists.vectors(lo, hi) for lo, hi in block], out=self.cand[:n])
            r, c = best_of(np.matmul(cand, q.T, out=self.sim[: len(q) * n].reshape(n, len(q))), min(m, n), self.low - 1e-5)
            if len(r):
                ends = np.cumsum([hi - lo for lo, hi in block])
                part = np.searchsorted(ends, c, "right")
                where = c - ends[part] + np.array([hi for _, hi in block])[part]
                exact = np.einsum("ij,ij->i", q[r].astype(np.float64), cand[c].astype(np.float64))
                other = where != r + own
                found.append((r[other], where[other], np.round(exact[other], 9)))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        rows, where, exact = map(np.concatenate, zip(*found, strict=True))
        order = np.lexsort((-exact, rows))
        rows, where, exact = rows[order], where[order], exact[order]
        kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < m
        return rows[kept], where[kept], exact[kept]

    def blocks(self, cells: np.ndarray, most: int = BLOCK) -> Iterator[list[tuple[int, int]]]:
        """Ranges of rows that the cells (ascending, none of them empty) hold, in lists of `most` rows at most."""
        block, n = [], 0
        begin, end = self.first[cells], self.first[cells] + self.flat[cells]
        apart = np.flatnonzero(begin[1:] != end[:-1]) + 1  # lists that follow each other are one range
        for lo, hi in zip(begin[np.append(0, apart)].tolist(), end[np.append(apart - 1, -1)].tolist(), strict=True):
            while lo < hi:
                stop = min(hi, lo + most - n)
                block.append((lo, stop))
                n += stop - lo
                lo = stop
                if n == most:
                    yield block
                    block, n = [], 0
        if block:
            yield block

    def pairs(self, lo: int, hi: int) -> Iterator[tuple[str, str, float]]:
        """(id_a, id_b, similarity) of the k nearest of the entries lo to hi."""
        while lo < hi:
            cell = int(np.searchsorted(self.first, lo, "right")) - 1
            stop = min(hi, lo + QUERIES, int(self.first[cell] + self.flat[cell]))
            rows, where, exact = self.near(self.lists.vectors(lo, stop), lo)
            ids = self.lists.ids(np.append(where, np.arange(lo, stop)))
            near: dict[int, list[tuple[float, str]]] = {}
            for r, w, s in zip(rows.tolist(), where.tolist(), exact.tolist(), strict=True):
                near.setdefault(r, []).extend((-s, x) for x in ids[w])
            for r in range(stop - lo):
                own, others = ids[lo + r], near.get(r, [])
                if len(own) == 1 and not others:
                    continue
                for a in own[: self.k + 1]:
                    for s, x in sorted([*others, *((-1.0, y) for y in own if y != a)])[: self.k]:
                        if -s >= self.low:
                            yield min(a, x), max(a, x), -s
            lo = stop


def similar_pairs(df: DataFrame, key: str, vector: str, k: int = 5, least: float | None = None, scan: int | None = 900, cells: int = 20, sample: int = 32_768, cell: int = 40, dim: int | None = None) -> DataFrame:
    """`id_a`, `id_b` (id_a < id_b), `similarity`: one of the two is among the k most similar others of the other.

    Equal similarities go by smaller id; pairs below `least` are left out. scan: entries met by a query at least, in `cells` lists
    at least, times the fourth root of n / 200,000 if that is more than 1 (n: different vectors); None meets all, which is exact. cell: mean entries of a cell, up to CODES centroids of a half (170 million vectors); beyond, cells
    fill up and `cells` of them are ranked. sample: vectors for the codebooks, 32 for each centroid if that is more. Vectors that are null,
    of another length than `dim` (by default that of the first usable one), all zero, or that hold null, NaN or infinity take no
    part, nor do null keys; a repeated key counts once. Keys are strings or are compared as such. An empty table gives no rows.
    """
    spark = df.sparkSession
    v = df.select(F.col(key).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("vec"))
    # compiled, as lambdas aren't: NaN is the greatest value, and array_contains is null where an element is
    v = v.where("id is not null and size(vec) > 0 and array_max(vec) < float('inf') and array_min(vec) > float('-inf') and (array_max(vec) <> 0 or array_min(vec) <> 0) and not array_contains(vec, float('nan'))")
    if dim is None:
        first = v.select(F.size("vec").alias("d")).head()
        dim = first["d"] if first else 2
    v = v.where(F.size("vec") == dim).withColumns({"k1": F.xxhash64("vec"), "k2": F.hash("vec", F.lit(1))})
    n = v.agg(F.approx_count_distinct("k1", 0.02)).head()[0]  # entries; copies, however many, are one
    size = min(CODES, max(4, round(math.sqrt(n / cell))))
    sample = max(sample, 32 * size)
    chosen = v.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(max(1, math.ceil(df.count() / sample)))) == 0).select("vec").limit(2 * sample).toArrow()
    if not chosen.num_rows:
        chosen = v.select("vec").limit(sample).toArrow()
    if not chosen.num_rows:
        return spark.createDataFrame([], "id_a string, id_b string, similarity double")
    x = matrix(chosen["vec"].combine_chunks(), dim)
    half = dim // 2
    books = kmeans(x[:, :half], size), kmeans(x[:, half:], size)
    shape = len(books[0]), len(books[1])
    shared = spark.sparkContext.broadcast(books)
    folder = shared_path(spark, "lists")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b1, b2 = shared.value
        for b in batches:
            if b.num_rows:
                m = matrix(b.column("vec"), dim)
                c = nearest(m[:, :half], b1) * shape[1] + nearest(m[:, half:], b2)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(c.astype(np.int32))], names=[*b.schema.names, "cell"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by cell into files; gives of each its path, rows and the entries of each cell, with the partition and a number."""
        part, number = TaskContext.get().partitionId(), 0

        def save(t: pa.Table) -> pa.RecordBatch:
            vec = np.concatenate([matrix(c, dim) for c in t["vec"].chunks if len(c)])
            out = pa.table({"vec": pa.FixedSizeListArray.from_arrays(pa.array(vec.ravel()), dim), "ids": t["ids"].combine_chunks()})
            at = f"{folder}/{uuid.uuid4().hex}.arrow"  # a retried task writes files of its own
            fs, path = shared_fs(at)
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(path) as f, pa.ipc.new_file(f, out.schema) as w:
                w.write_table(out, max_chunksize=BATCH)
            here, counts = np.unique(t["cell"].to_numpy(), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([number]), pa.array([at]), pa.array([t.num_rows]), pa.array([here.tolist()], pa.list_(pa.int32())), pa.array([counts.tolist()], pa.list_(pa.int32()))], names=["part", "number", "file", "n", "cells", "counts"])

        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            while rows >= FILE:
                t = pa.Table.from_batches(held)
                yield save(t.slice(0, FILE))
                number += 1
                held = t.slice(FILE).to_batches()
                rows -= FILE
        if rows:
            yield save(pa.Table.from_batches(held))

    placed = v.mapInArrow(assign, "id string, vec array<float>, k1 bigint, k2 int, cell int")
    # of equal vectors the first k + 1 ids; the limit holds before the shuffle too, so copies of one vector don't gather
    equal = Window.partitionBy("k1", "k2").orderBy("id")
    entries = placed.withColumn("r", F.dense_rank().over(equal)).where(F.col("r") <= k + 1)
    entries = entries.groupBy("k1", "k2").agg(F.first("cell").alias("cell"), F.first("vec").alias("vec"), F.array_sort(F.collect_set("id")).alias("ids"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / (4 * FILE)))
    order = ("cell", "k1", "k2")
    files = cut(entries.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(write, "part bigint, number bigint, file string, n bigint, cells array<int>, counts array<int>"))
    manifest = sorted(files.collect(), key=lambda r: (r["part"], r["number"]))  # a row per file, each of at most FILE entries; CODES ** 2 cells
    counts = np.zeros(shape[0] * shape[1], np.int32)
    for r in manifest:
        counts[r["cells"]] += np.array(r["counts"], np.int32)
    starts = np.cumsum([0, *(r["n"] for r in manifest)])
    total = int(starts[-1])
    low = -2.0 if least is None else least
    enough = total if scan is None else round(scan * max(1.0, (n / 200_000) ** 0.25))
    plan = spark.sparkContext.broadcast(([r["file"] for r in manifest], starts[:-1], counts.reshape(shape)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Search(shared.value, *plan.value, dim, k, low, enough, cells)
        for batch in batches:
            for lo in batch.column(0).to_pylist():
                out = list(zip(*find.pairs(lo, min(total, lo + 1024)), strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.string(), pa.float64()), strict=True)], names=["id_a", "id_b", "similarity"])

    blocks = math.ceil(total / 1024)
    pairs = spark.range(0, total, 1024, max(1, min(blocks, max(24, blocks // 16)))).mapInArrow(search, "id_a string, id_b string, similarity double")
    # ids beyond the first k + 1 of equal vectors: their k nearest are the first k of these
    many = v.withColumn("r", F.dense_rank().over(equal)).where(F.col("r") <= k + 1).groupBy("k1", "k2").agg(F.array_sort(F.collect_set("id")).alias("ids")).where(F.size("ids") > k)
    rest = v.select("id", "k1", "k2").join(many, ["k1", "k2"]).where(F.col("id") > F.element_at("ids", k + 1))
    rest = rest.select(F.explode(F.slice("ids", 1, k)).alias("id_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("similarity"))
    return pairs.unionAll(rest).groupBy("id_a", "id_b").agg(F.max("similarity").alias("similarity"))
