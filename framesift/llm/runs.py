"""Runs of consecutive events that agree, by associative run summaries.

Events are range-sorted by sequence, time and id, so one long sequence spreads over many chunks, whose number grows with the data. Each
chunk encodes its runs in one streaming pass; its summary is its first and its last run, or its only one. Summaries of neighbouring
chunks combine associatively: the last run of the left one joins the first of the right one if they agree, while first and last of one
summary never join, as others lie between or they don't agree. The prefix merge is a tree: groups of `fan` neighbouring summaries are
combined in parallel, then groups of their results, until one is left, so no task reads more than two rows of each of `fan` summaries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = pa.schema([("chunk", pa.int64()), ("edge", pa.int8()), ("seq", pa.string()), ("first_id", pa.string()), ("last_id", pa.string()), ("first_t", pa.float64()), ("last_t", pa.float64()), ("n", pa.int64()), ("a0", pa.float64()), ("a1", pa.float64()), ("z0", pa.float64()), ("z1", pa.float64())])
DDL = "chunk bigint, edge tinyint, seq string, first_id string, last_id string, first_t double, last_t double, n bigint, a0 double, a1 double, z0 double, z1 double"

BODY, FIRST, LAST, WHOLE = range(4)  # edge: which edges of its chunk a run touches
FAN = 64


def combine(left: dict, right: dict, tol: float) -> dict | None:
    """The run of two neighbouring runs, or None if they don't agree. a0, a1: span of the first event; z0, z1: of the last."""
    if left["seq"] != right["seq"] or not (abs(left["z0"] - right["a0"]) <= tol and abs(left["z1"] - right["a1"]) <= tol):
        return None
    return left | {k: right[k] for k in ("last_id", "last_t", "z0", "z1")} | {"n": left["n"] + right["n"]}


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=SCHEMA)


def encode_runs(tol: float):
    """Of batches sorted by seq, t, id with columns seq, id, t, s0, s1 (NaN: no span): runs; edge marks a chunk's first and last, or its only
    one. The chunk is the partition, as partitions are in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId()
        open_run, first = None, True
        last_key = None
        for b in batches:
            if not b.num_rows:
                continue
            seq, ids, t = (b.column(k) for k in ("seq", "id", "t"))
            code = seq.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            icode = ids.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            tt, s0, s1 = (b.column(k).to_numpy(zero_copy_only=False) for k in ("t", "s0", "s1"))
            fresh = np.r_[True, (icode[1:] != icode[:-1]) | (code[1:] != code[:-1]) | (tt[1:] != tt[:-1])]
            fresh[0] = last_key != (seq[0].as_py(), ids[0].as_py(), tt[0])  # an event delivered twice is next to itself
            last_key = (seq[-1].as_py(), ids[-1].as_py(), tt[-1])
            at = np.flatnonzero(fresh)
            if not len(at):
                continue
            code, tt, s0, s1 = code[at], tt[at], s0[at], s1[at]
            with np.errstate(invalid="ignore"):
                same = (code[1:] == code[:-1]) & (np.abs(s0[1:] - s0[:-1]) <= tol) & (np.abs(s1[1:] - s1[:-1]) <= tol)
            start = np.r_[0, np.flatnonzero(~same) + 1]
            end = np.r_[start[1:], len(at)] - 1
            fi, la = pa.array(at[start]), pa.array(at[end])
            out = pa.RecordBatch.from_arrays([pa.array(np.full(len(start), chunk)), pa.array(np.full(len(start), BODY, np.int8)), seq.take(fi), ids.take(fi), ids.take(la), pa.array(tt[start]), pa.array(tt[end]), pa.array(end - start + 1), *(pa.array(x) for x in (s0[start], s1[start], s0[end], s1[end]))], schema=SCHEMA)
            head = out.slice(0, 1).to_pylist()[0]
            joined = open_run and combine(open_run, head, tol)
            if joined:
                open_run = joined
                out = out.slice(1)
            if out.num_rows:
                if open_run:
                    yield _rows([open_run | {"edge": FIRST if first else BODY}])
                    first = False
                open_run = out.slice(out.num_rows - 1).to_pylist()[0]
                if out.num_rows > 1:
                    body = out.slice(0, out.num_rows - 1)
                    if first:
                        yield _rows([body.slice(0, 1).to_pylist()[0] | {"edge": FIRST}])
                        first, body = False, body.slice(1)
                    yield body
        if open_run:
            yield _rows([open_run | {"edge": WHOLE if first else LAST}])

    return run


def merge(left: list[dict], right: list[dict], tol: float) -> tuple[list[dict], list[dict]]:
    """The summary of two neighbouring summaries (one run, or a first and a last one), and the runs between its edges, which are done."""
    joined = combine(left[-1], right[0], tol)
    runs = [*left[:-1], joined, *right[1:]] if joined else [*left, *right]
    return (runs, []) if len(runs) == 1 else ([runs[0], runs[-1]], runs[1:-1])


def merge_groups(tol: float, fan: int):
    """Of the edge runs of chunks, sorted by chunk and edge: those of each group of `fan` chunks, under the group's number, and the runs done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: int | None = None
        left: list[dict] = []
        right: list[dict] = []
        done: list[dict] = []

        def fold() -> None:
            nonlocal left, right
            left, between = merge(left, right, tol) if left and right else (left or right, [])
            done.extend(between)
            right = []

        def close() -> list[dict]:
            fold()
            names = [WHOLE] if len(left) == 1 else [FIRST, LAST]
            return [r | {"edge": BODY} for r in done] + [r | {"chunk": group, "edge": e} for r, e in zip(left, names, strict=True)]

        for b in batches:
            out = []
            for row in b.to_pylist():
                if row["chunk"] // fan != group:
                    if group is not None:
                        out += close()
                    group, left, right = row["chunk"] // fan, [], []
                    done.clear()
                elif right and row["chunk"] != right[0]["chunk"]:
                    fold()
                right.append(row)
            yield _rows(out)
        if group is not None:
            yield _rows(close())

    return run


def collapse(events: DataFrame, seq: str, item: str, time: str, span: str, tol: float = 0.1, chunks: int | None = None, rows: int = 1_000_000, fan: int = FAN) -> DataFrame:
    """One row per run: `seq`, `first_id`, `last_id`, `n`, `t_first`, `t_last`, `duration`, `has_span`.

    Events are ordered by time, then id; consecutive ones agree if both ends of their spans (struct t_start, t_end) lie
    within tol. An event without a whole span is a run of its own with has_span false. Events with null sequence or id, or
    a null or NaN time, are left out beforehand; an event delivered twice counts once. An empty table gives no rows.
    chunks: by default spark.sql.shuffle.partitions, or as many as give `rows` events each if that is more; no number changes the result.
    """
    # 1e-9: decimals that are tol apart as written stay within it in binary
    tol += 1e-9
    from framesift.session import cut

    n = chunks or max(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(events.count() / rows))
    e = events.where(F.col(seq).isNotNull() & F.col(item).isNotNull() & F.col(time).isNotNull() & ~F.isnan(time))
    end = lambda k: F.coalesce(F.col(f"{span}.{k}"), F.lit(float("nan")))
    e = e.select(F.col(seq).alias("seq"), F.col(item).alias("id"), F.col(time).alias("t"), end("t_start").alias("s0"), end("t_end").alias("s1"))
    keys = ("seq", "t", "id")
    whole = cut(e.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(encode_runs(tol), DDL))  # run summaries only
    while True:
        n = math.ceil(n / fan)
        edges = whole.where(F.col("edge") != BODY)
        # a group's number is its partition's, by range; what a group comes to is a row or two, beside the runs done
        edges = edges.repartitionByRange(n, F.expr(f"chunk div {fan}")) if n > 1 else edges.repartition(1)
        edges = edges.sortWithinPartitions("chunk", "edge").mapInArrow(merge_groups(tol, fan), DDL)
        whole = whole.where(F.col("edge") == BODY).unionAll(edges if n == 1 else cut(edges))
        if n == 1:
            break
    return whole.select(F.col("seq").alias(seq), "first_id", "last_id", "n", F.col("first_t").alias("t_first"), F.col("last_t").alias("t_last"), (F.col("last_t") - F.col("first_t")).alias("duration"), (~F.isnan("a0") & ~F.isnan("a1")).alias("has_span"))
