"""Frequencies of all terms, counted out of core by recursive radix spilling.

RadixCounter holds a bounded number of rows. What exceeds it goes to files by hash bits of the term; a file that is still
too large is split by the next bits, and each part is then aggregated by DuckDB on its own. It runs on every input partition
(so that a hot term is added up before the shuffle) and again on the rows shuffled by hash.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.session import cut, shared_fs, shared_path

SCHEMA = pa.schema([("field", pa.string()), ("term", pa.string()), ("h", pa.int64()), ("occurrences", pa.int64()), ("records", pa.int64())])
DDL = "field string, term string, h bigint, occurrences bigint, records bigint"
SUM = "select field, term, h, sum(occurrences)::bigint as occurrences, sum(records)::bigint as records from t group by field, term, h"


class RadixCounter:
    """Adds up (field, term, h, occurrences, records); h is a 64-bit hash of field and term.

    folder: where spilled parts go, a URI of a file system that pyarrow knows, shared by the executors. rows: held in memory
    at most. bits: hash bits by which a part is split. Below the last bits, equal hashes are aggregated as they are."""

    def __init__(self, folder: str, rows: int = 400_000, bits: int = 4, depth: int = 0):
        self.folder, self.rows, self.bits, self.depth = folder, rows, bits, depth
        self.held: list[pa.Table] = []
        self.n = 0
        self.files: dict[int, pa.RecordBatchStreamWriter] = {}
        self.sinks: dict[int, pa.NativeFile] = {}
        self.spilled_rows: dict[int, int] = {}

    def _sum(self, t: pa.Table) -> pa.Table:
        import duckdb

        with duckdb.connect(config={"threads": 1, "memory_limit": "400MB"}) as c:
            c.register("t", t)
            return c.sql(SUM).to_arrow_table().cast(SCHEMA)

    def add(self, b: pa.RecordBatch) -> None:
        self.held.append(pa.Table.from_arrays(b.columns, schema=SCHEMA))
        self.n += b.num_rows
        if self.n > self.rows:
            t = self._sum(pa.concat_tables(self.held))
            self.held, self.n = [t], t.num_rows
            if self.n > self.rows // 2 and self.depth * self.bits < 60:
                self._spill(t)
                self.held, self.n = [], 0

    def _fs(self):
        return shared_fs(self.folder)

    def _path(self, k: int) -> str:
        return f"{self._fs()[1]}/{k}.arrow"

    def _spill(self, t: pa.Table) -> None:
        part = (t["h"].to_numpy() >> np.int64(self.depth * self.bits)) & np.int64((1 << self.bits) - 1)
        for k in np.unique(part).tolist():
            if k not in self.files:
                fs, at = self._fs()
                fs.create_dir(at, recursive=True)
                self.sinks[k] = fs.open_output_stream(self._path(k))
                self.files[k] = pa.ipc.new_stream(self.sinks[k], SCHEMA, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            x = t.filter(pa.array(part == k))
            self.files[k].write_table(x)
            self.spilled_rows[k] = self.spilled_rows.get(k, 0) + x.num_rows

    def finish(self) -> Iterator[pa.Table]:
        """The sums; parts come one after another."""
        rest = self._sum(pa.concat_tables(self.held)) if self.held else None
        if not self.files:
            if rest is not None:
                yield rest
            return
        if rest is not None:
            self._spill(rest)
        for k in self.files:
            self.files[k].close()
            self.sinks[k].close()
        fs, at = self._fs()
        for k, n in self.spilled_rows.items():
            deeper = RadixCounter(f"{self.folder}/{k}", self.rows, self.bits, self.depth + 1)
            with fs.open_input_stream(self._path(k)) as f:
                for b in pa.ipc.open_stream(f):
                    deeper.add(b)
            yield from deeper.finish()
            fs.delete_file(self._path(k))
        fs.delete_dir(at)


def count_partition(folder: str, rows: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A partition's rows added up. Each attempt of a task writes below a name of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = RadixCounter(f"{folder}/{uuid.uuid4().hex}", rows, bits)
        for b in batches:
            counter.add(b)
        for t in counter.finish():
            yield from t.to_batches()

    return run


STRIP = ".,;:!?\"'()[]"


def text_terms(text: Column) -> Column:
    """Lower case, split at U+0020 only, freed of STRIP at both ends, without empty terms."""
    return F.filter(F.transform(F.split(F.lower(text), " "), lambda x: F.trim(x, F.lit(STRIP))), lambda x: x != "")


def list_terms(xs: Column) -> Column:
    """The elements as stored, without null and empty ones."""
    return F.filter(xs, lambda x: x.isNotNull() & (x != ""))


def term_counts(records: DataFrame, fields: dict[str, Callable[[Column], Column]], held: int = 400_000, bits: int = 4) -> DataFrame:
    """`field`, `term`, `occurrences`, `records`: how often and in how many records each term occurs; a row with term null
    for each field holds in `records` the number of records whose field isn't null. fields: column -> its terms as an array.

    Records must be distinct. A record may repeat a term; null fields have no terms; an empty table gives no rows.
    """
    spark = records.sparkSession
    kind = "array<struct<field:string,term:string,occurrences:bigint,records:bigint>>"

    def rows(f: str, terms: Column) -> Column:
        one = lambda x, o, r: F.struct(F.lit(f).alias("field"), x.alias("term"), F.lit(o).cast("long").alias("occurrences"), F.lit(r).cast("long").alias("records"))
        each = F.concat(F.transform(terms, lambda x: one(x, 1, 0)), F.transform(F.array_distinct(terms), lambda x: one(x, 0, 1)), F.array(one(F.lit(None).cast("string"), 0, 1)))
        return F.when(F.col(f).isNotNull(), each).otherwise(F.expr(f"cast(array() as {kind})"))

    long = records.select(F.explode(F.concat(*(rows(f, terms(F.col(f))) for f, terms in fields.items()))).alias("x")).select("x.field", "x.term", F.xxhash64("x.field", "x.term").alias("h"), "x.occurrences", "x.records")
    folder = shared_path(spark, "radix")
    near = long.mapInArrow(count_partition(folder, held, bits), DDL)
    # the high bits choose the partition, so that the low ones still split what is in it
    spread = near.repartition(F.shiftrightunsigned("h", 40))
    return spread.mapInArrow(count_partition(folder, held, bits), DDL).select("field", "term", "occurrences", "records")


def mark_terms(counts: DataFrame, common: float = 0.1, rare: int = 3) -> DataFrame:
    """The counts with `mark`: 'common' if in more than that share of the records, else 'rare' if fewer occurrences, else null."""
    counts = cut(counts)  # read twice below
    totals = counts.where("term is null").select("field", F.col("records").alias("total"))  # a row per field
    marked = counts.where("term is not null").join(F.broadcast(totals), "field")
    return marked.withColumn("mark", F.when(F.col("records") > common * F.col("total"), "common").when(F.col("occurrences") < rare, "rare")).drop("total")


def distinct_records(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per non-null key with the columns."""
    return df.where(F.col(key).isNotNull()).select(key, *columns).dropDuplicates([key])
