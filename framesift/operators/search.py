"""Search over one catalogue of frames: text, image, both, feedback, similar frames and events in order.

Each method takes one request of a user and gives a DataFrame of at most top_k rows; the work is the DataFrame operators'. Encoders and the
scorer of the fine ranking are given, as models aren't part of this package.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from framesift.functions import text as T
from framesift.functions import vectors as V
from framesift.functions.location import location
from framesift.operators import answers, bm25, dense, dialogue, filters, fusion, temporal

TEXTS = ("llm_caption", "ocr_text", "asr_text")
FOUND = "keyframe_id string, video_id string, timestamp double, score double, sources string, rank int"


class Encoder(Protocol):
    """Puts texts and images into the space of a vector column."""

    column: str
    dim: int

    def text(self, text: str) -> Sequence[float]: ...

    def image(self, content: bytes) -> Sequence[float]: ...


@dataclass
class HashEncoder:
    """Stands for an encoder: a unit vector that depends on the salt and what is encoded only."""

    column: str
    dim: int
    salt: str = ""

    def _vector(self, content: bytes) -> np.ndarray:
        seed = int.from_bytes(hashlib.sha256(self.salt.encode() + b":" + content).digest()[:8], "little")
        v = np.random.default_rng(seed).standard_normal(self.dim)
        return v / np.linalg.norm(v)

    def text(self, text: str) -> np.ndarray:
        return self._vector(text.encode())

    def image(self, content: bytes) -> np.ndarray:
        return self._vector(content)


def unit(v: Sequence[float]) -> np.ndarray:
    v = np.asarray(v, np.float64)
    n = np.linalg.norm(v)
    return v / n if n else v


class FineRanker:
    """Scores the candidates of one query one after another with a slow scorer, as long as the time allows.

    score(query, candidate) -> about 0 to 1, cut to that. Stops before the time that the mean of the scores so far would take exceeds
    `seconds`, or, after `least` scores, once the two best differ by `margin`. What wasn't scored is left out."""

    def __init__(self, score: Callable[[str, Row], float], most: int = 50, seconds: float = 300.0, least: int = 5, margin: float = 0.2, keep: int = 10, clock: Callable[[], float] = time.monotonic):
        self.score, self.most, self.seconds, self.least, self.margin, self.keep, self.clock = score, most, seconds, least, margin, keep, clock

    def __call__(self, query: str, candidates: Sequence[Row]) -> list[tuple[Row, float]]:
        began, took, scored = self.clock(), [], []
        for c in candidates[: self.most]:
            now = self.clock()
            if took and now - began + sum(took) / len(took) > self.seconds:
                break
            scored.append((c, min(1.0, max(0.0, self.score(query, c)))))
            took.append(self.clock() - now)
            best = sorted((s for _, s in scored), reverse=True)
            if len(best) >= max(2, self.least) and round(best[0] - best[1], 9) >= self.margin:
                break
        return sorted(scored, key=lambda x: -x[1])[: self.keep]


class Catalogue:
    """Frames (one row per id) with what is needed to search them.

    frames: `id`, `video_id`, `timestamp`, `objects`, the columns of TEXTS and of the encoders; vectors that aren't usable take no part.
    depth: how far down each ranked list counts, whatever top_k is. weights of the text list: `low`, or `high` for a query with a word in
    capitals. approximate: requests without bounds use a stored index of inverted lists instead of all vectors."""

    def __init__(self, frames: DataFrame, encoders: dict[str, Encoder], depth: int = 1000, low: float = 1.0, high: float = 3.0, ranker: Callable[[str, Sequence[Row]], list[tuple[Row, float]]] | None = None, pool: int = 8, approximate: bool = False):
        self.frames, self.encoders, self.depth, self.low, self.high, self.ranker, self.pool, self.approximate = frames, encoders, depth, low, high, ranker, pool, approximate
        self.spark = frames.sparkSession
        self._lists: dict[str, dense.Ivf] = {}

    @cached_property
    def words(self) -> bm25.Index:
        f = self.frames
        text = T.searchable_text(f["objects"], f["ocr_text"], f["asr_text"], f["llm_caption"])
        return bm25.build(f.select("id", text.alias("text")), "id", "text")

    def vectors(self, name: str, rows: DataFrame | None = None) -> DataFrame:
        e = self.encoders[name]
        rows = self.frames if rows is None else rows
        return rows.where(V.usable(F.col(e.column), e.dim)).select("id", F.col(e.column).alias("vec"))

    # --- queries as vectors

    def encode(self, text: str) -> dict[str, np.ndarray]:
        """Of each encoder the mean over the prompts, at unit length."""
        return {n: unit(np.mean([unit(e.text(p.replace("{q}", text))) for p in T.PROMPTS], axis=0)) for n, e in self.encoders.items()}

    def encode_image(self, content: bytes) -> dict[str, np.ndarray]:
        return {n: unit(e.image(content)) for n, e in self.encoders.items()}

    def mean(self, ids: Sequence[str], name: str) -> np.ndarray | None:
        """The mean of the stored unit vectors; None if none of the ids has one."""
        if not ids:
            return None
        rows = self.vectors(name).where(F.col("id").isin(list(ids))).select(V.l2_normalize(F.col("vec")).alias("u"))
        got = V.mean_vector(rows, "u").head()
        return np.array(got["mean"]) if got and got["mean"] else None

    # --- ranked lists

    def coarse(self, vectors: dict[str, Sequence[float]] | None = None, text: str | None = None, bounds: dict | None = None, top_k: int = 8, weights: dict[str, float] | None = None) -> DataFrame:
        """The top_k frames by rank fusion of a dense list for each vector and one of the text: columns of FOUND.

        bounds: see filters.condition; without any all frames count. Raises ValueError without a vector and a text."""
        vectors = {n: v for n, v in (vectors or {}).items() if v is not None}
        if not vectors and text is None:
            raise ValueError("a search needs a vector or a text")
        bounded = filters.condition(**(bounds or {})) is not None
        rows = filters.apply(self.frames, **(bounds or {}))
        lists = {}
        for n, v in vectors.items():
            q = self.spark.createDataFrame([(0, [float(x) for x in v])], "q int, qv array<double>")
            if self.approximate and not bounded:
                index = self._lists.get(n) or self._lists.setdefault(n, dense.ivf_build(self.vectors(n), "id", "vec", self.encoders[n].dim))
                lists[n] = dense.ivf_search(index, q, "q", "qv", self.depth, self.encoders[n].dim)
            else:
                lists[n] = dense.batch_knn(self.vectors(n, rows), q, "id", "vec", "q", "qv", self.depth, self.encoders[n].dim)
        if text:
            q = self.spark.createDataFrame([(0, text)], "q int, text string")
            among = rows.select(F.lit(0).alias("q"), "id") if bounded else None
            lists["bm25"] = bm25.top_k(bm25.score(self.words, q, "q", "text", among), "q", "score", "id", self.depth)
        if not lists:
            return self.spark.createDataFrame([], FOUND)
        best = fusion.rrf(lists, "q", "id", weights=weights, depth=self.depth).where(F.col("rank") <= top_k)
        found = F.broadcast(best.drop("q")).join(self.frames.select("id", "video_id", "timestamp"), "id")  # top_k rows
        return found.select(F.col("id").alias("keyframe_id"), "video_id", "timestamp", "score", "sources", "rank").orderBy("rank")

    def _run(self, vectors: dict[str, np.ndarray], text: str, top_k: int, rerank: bool) -> DataFrame:
        capitals = any(w.isupper() for w in re.findall(r"[A-Za-z][A-Za-z\-]+", text))
        pool = max(top_k, self.pool) if rerank else top_k
        found = self.coarse(vectors, text or None, top_k=pool, weights={"bm25": self.high if capitals else self.low})
        if not rerank or self.ranker is None:
            return found.where(F.col("rank") <= top_k)
        rows = found.join(self.frames.select(F.col("id").alias("keyframe_id"), "objects", *TEXTS), "keyframe_id").orderBy("rank").collect()  # at most `pool`
        try:
            ranked = [(c, s) for c, s in self.ranker(text, rows)][:top_k]
        except Exception:  # noqa: BLE001 - whatever a model raises, the coarse order stands
            return found.where(F.col("rank") <= top_k)
        return self.spark.createDataFrame([(c["keyframe_id"], c["video_id"], c["timestamp"], float(s), c["sources"], n) for n, (c, s) in enumerate(ranked, 1)], FOUND)

    def search(self, query: str, top_k: int = 8, rerank: bool = False) -> DataFrame:
        return self._run(self.encode(query), query, top_k, rerank)

    def search_by_image(self, image: bytes, top_k: int = 8) -> DataFrame:
        """Dense lists only."""
        return self.coarse(self.encode_image(image), top_k=top_k)

    def search_multimodal(self, query: str | None, image: bytes | None, text_weight: float = 0.5, top_k: int = 8, rerank: bool = False) -> DataFrame:
        """By the blend of both vectors, or by the one there is. Raises ValueError for neither."""
        if not query and not image:
            raise ValueError("a search needs a text or an image")
        if not image:
            return self.search(query, top_k, rerank)
        seen = self.encode_image(image)
        if not query:
            return self._run(seen, "", top_k, False)
        said = self.encode(query)
        return self._run({n: unit(text_weight * said[n] + (1 - text_weight) * v) for n, v in seen.items()}, query, top_k, rerank)

    def search_with_feedback(self, query: str, positive: Sequence[str] = (), negative: Sequence[str] = (), top_k: int = 8, rerank: bool = False, alpha: float = 1.0, beta: float = 0.75, gamma: float = 0.15) -> DataFrame:
        """The vectors are moved to the mean of the frames liked and away from that of those disliked; unknown ids count for nothing."""
        moved = {}
        for n, v in self.encode(query).items():
            v = alpha * v
            for ids, w in ((positive, beta), (negative, -gamma)):
                m = self.mean(ids, n)
                v = v if m is None else v + w * m
            moved[n] = unit(v)
        return self._run(moved, query, top_k, rerank)

    def search_similar(self, keyframe_id: str, top_k: int = 8) -> DataFrame:
        """Frames like a stored one, itself aside; none for an unknown id or one without vectors."""
        vectors = {n: m for n in self.encoders if (m := self.mean([keyframe_id], n)) is not None}
        if not vectors:
            return self.spark.createDataFrame([], FOUND)
        return self.coarse({n: unit(v) for n, v in vectors.items()}, top_k=top_k + 1).where(F.col("keyframe_id") != keyframe_id).limit(top_k)

    def search_temporal(self, events: Sequence[str], per_event: int = 20, limit: int = 50) -> DataFrame:
        """Chains of frames of one video, one for each event, in strict order of time: `video_id`, `total`, `steps` (event, keyframe_id,
        timestamp); the best first. Raises ValueError for fewer than two events."""
        if len(events) < 2:
            raise ValueError("an order needs two events or more")
        parts = [self.search(e, per_event).where("video_id is not null and timestamp is not null").select(F.col("keyframe_id").alias("id"), "video_id", F.col("timestamp").alias("t"), "score") for e in events]
        n = range(1, len(events) + 1)
        steps = F.array(*(F.struct(F.lit(e).alias("event"), F.col(f"id_{i}").alias("keyframe_id"), F.col(f"t_{i}").alias("timestamp")) for i, e in zip(n, events, strict=True)))
        chains = temporal.event_chains(parts)
        return chains.orderBy(F.round("total", 9).desc(), *(f"t_{i}" for i in n), "video_id", *(f"id_{i}" for i in n)).limit(limit).select("video_id", "total", steps.alias("steps"))

    def ask(self, question: str, window: float = 8.0) -> dict | None:
        """The answer from the frames within `window` seconds of the best one found for the question, in its video; None if none is found."""
        best = self.search(question, 1).head()
        if best is None or best["video_id"] is None or best["timestamp"] is None:
            return None
        near = filters.temporal_window(self.frames, best["video_id"], best["timestamp"], window)
        row = answers.answer_windows(near.select(F.lit(0).alias("q"), F.lit(question).alias("question"), "id", "timestamp", "llm_caption", "objects")).head()
        return row.asDict() if row else None

    # --- around results

    def neighbors(self, frame_id: str, before: int = 4, after: int = 4) -> DataFrame:
        """Frames of the same video around one by time, itself included: `keyframe_id`, `video_id`, `timestamp`."""
        own = self.frames.where(F.col("id") == frame_id).select("id", "video_id")
        same = self.frames.join(F.broadcast(own.select("video_id")), "video_id", "left_semi").select("id", "video_id", "timestamp")  # one row
        near = temporal.neighbors(same, own, before, after).select("id", "offset")
        return same.join(F.broadcast(near), "id").orderBy("offset").select(F.col("id").alias("keyframe_id"), "video_id", "timestamp")  # before + after + 1 rows

    def explore(self, per_video: int = 3, limit: int = 30) -> DataFrame:
        """Evenly spaced frames of each video, `limit` at most, videos in the order of their names."""
        return temporal.explore(self.frames, per_video).orderBy("video_id", "timestamp", "id").limit(limit).select(F.col("id").alias("keyframe_id"), "video_id", "timestamp")

    def suggest_concepts(self, candidate_ids: Sequence[str], query: str, top_n: int = 8) -> list[str]:
        """Frequent words of the candidates' texts that aren't in the query; the first seen of equally frequent ones."""
        if not candidate_ids:
            return []
        order = self.spark.createDataFrame([(0, query, n, i) for n, i in enumerate(candidate_ids)], "q int, query string, pos int, id string")
        rows = F.broadcast(order).join(self.frames.select("id", *TEXTS), "id")
        return [r["tok"] for r in dialogue.suggest_concepts(rows, "q", "pos", "query", TEXTS, top_n).orderBy("rank").collect()]

    def disambiguation(self, candidates: Sequence[dict], k: int = 4, gap: float = 0.02) -> list[str] | None:
        """None if there are at most k candidates or the best is clear of the next; else k of them that differ most."""
        if len(candidates) <= k:
            return None
        top = sorted(candidates, key=lambda c: -(c.get("score") or 0.0))
        if round((top[0].get("score") or 0.0) - (top[1].get("score") or 0.0), 9) >= gap:
            return None
        order = self.spark.createDataFrame([(0, n, c["keyframe_id"]) for n, c in enumerate(top)], "q int, rank int, id string")
        picked = dialogue.diverse_pick(F.broadcast(order).join(self.vectors(next(iter(self.encoders))), "id"), "q", "rank", "id", "vec", k, most=len(top))
        return [r["id"] for r in picked.orderBy("pick").collect()]

    def understand(self, query: str) -> dict:
        """What a query names: kind, objects, actions, colours, place, time, and events in order."""
        q = F.col("q")
        row = self.spark.createDataFrame([(query,)], "q string").select(
            T.query_type(q).alias("kind"), T.lexicon_scan(q, T.OBJECTS).alias("objects"), T.lexicon_scan(q, T.ACTIONS).alias("actions"), T.lexicon_scan(q, T.COLORS).alias("colors"),
            location(q).alias("location"), F.get(T.lexicon_scan(q, T.TIMES), F.lit(0)).alias("time"), T.temporal_order(q).alias("events"))
        return row.head().asDict()

    def texts(self, ids: Sequence[str]) -> dict[str, str]:
        """Of each id its caption and texts, joined; '' where there is none."""
        if not ids:
            return {}
        rows = self.frames.where(F.col("id").isin(list(ids))).select("id", F.array_join(F.filter(F.array(*TEXTS), lambda x: x.isNotNull() & (x != "")), " · ").alias("t"))
        return {r["id"]: r["t"] for r in rows.collect()}


def overlap_score(query: str, candidate: Row) -> float:
    """The share of the query's different words that a candidate's objects and texts have; stands for a model."""
    words = lambda s: set(re.findall(r"\w+", s.lower()))
    has = words(" ".join([*(candidate["objects"] or []), *(candidate[t] or "" for t in TEXTS)]))
    q = words(query)
    return len(q & has) / len(q) if q else 0.0
