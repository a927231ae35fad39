"""The N best items of every group, by a secondary sort.

Rows are sorted by group, score and identifier and streamed as Arrow batches; only the current group's key and a counter
are carried from batch to batch, so no group is ever held. It runs twice: once on each input partition, before any shuffle,
which leaves at most N rows of a group per partition (a hot group is thereby spread over all of them), then on the rows
hash-partitioned by group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _codes(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equal numbers for equal values."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return pc.dictionary_encode(col).indices.to_numpy(zero_copy_only=False)


def first_rows(n: int, group: str, item: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of batches sorted by group and rank: the first n different items of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_group = last_item = None
        seen = 0
        for b in batches:
            if not b.num_rows:
                continue
            g, i = b.column(group), b.column(item)
            gc, ic = _codes(g), _codes(i)
            new_group = np.r_[not (seen and g[0].as_py() == last_group), gc[1:] != gc[:-1]]
            new_item = new_group | np.r_[not (seen and i[0].as_py() == last_item), ic[1:] != ic[:-1]]
            count = np.cumsum(new_item)
            start = np.flatnonzero(new_group)
            base = np.zeros(b.num_rows, np.int64)
            base[start] = count[start] - 1
            base = np.maximum.accumulate(base)
            rank = count - base
            carried = ~np.maximum.accumulate(new_group)  # rows that continue the group of the last batch
            rank[carried] = count[carried] + seen
            yield b.filter(pa.array(new_item & (rank <= n)))
            last_group, last_item, seen = g[-1].as_py(), i[-1].as_py(), int(rank[-1])

    return run


def top_n(df: DataFrame, group: str, score: str, item: str, n: int) -> DataFrame:
    """The first n items of each group by score descending, then item ascending; all columns of df.

    A repeated item of a group with the same score counts once. Rows with null group or item, or a null or NaN score, take
    no part. Any type that Spark can order serves as score; an empty table gives no rows. Group and item must be of types
    that Arrow can dictionary-encode (numbers, strings, dates).
    """
    ok = F.col(group).isNotNull() & F.col(score).isNotNull() & F.col(item).isNotNull()
    if dict(df.dtypes)[score] in ("float", "double"):
        ok &= ~F.isnan(score)
    order = [F.col(group).asc(), F.col(score).desc(), F.col(item).asc()]
    near = df.where(ok).sortWithinPartitions(*order).mapInArrow(first_rows(n, group, item), df.schema)
    return near.repartition(F.col(group)).sortWithinPartitions(*order).mapInArrow(first_rows(n, group, item), df.schema)
