"""The named tools of a catalogue for a planner, and the route a request takes. A call gives plain rows and never raises."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.functions import text as T
from framesift.operators.search import Catalogue

S, I, N, B = ({"type": t} for t in ("string", "integer", "number", "boolean"))
IDS = {"type": "array", "items": S}


@dataclass(frozen=True)
class Tool:
    """parameters: names and their types as JSON Schema has them; those in `required` must be given."""

    name: str
    about: str
    parameters: dict[str, dict]
    required: tuple[str, ...]
    run: Callable[..., tuple[list[dict], dict]]

    def spec(self, style: str = "input_schema") -> dict:
        """What a model is told: style 'input_schema' (a flat tool) or 'function' (one wrapped as a function). Raises ValueError for others."""
        schema = {"type": "object", "properties": self.parameters, "required": list(self.required)}
        if style == "input_schema":
            return {"name": self.name, "description": self.about, "input_schema": schema}
        if style == "function":
            return {"type": "function", "function": {"name": self.name, "description": self.about, "parameters": schema}}
        raise ValueError(f"no such style: {style}")


@dataclass(frozen=True)
class Result:
    ok: bool
    tool: str
    items: list[dict] = field(default_factory=list)
    meta: dict = field(default_factory=dict)
    error: str | None = None


def plain(rows: DataFrame) -> list[dict]:
    """The few rows of a result as dictionaries, times to one and scores to four places."""
    out = [r.asDict(recursive=True) for r in rows.collect()]
    places = {"timestamp": 1, "score": 4, "total": 4}
    return [{k: round(v, places[k]) if k in places and v is not None else v for k, v in r.items()} for r in out]


def result_ids(items: list[dict]) -> list[str]:
    """The frames of flat results, and of the steps of chains."""
    ids = [[i["keyframe_id"]] if i.get("keyframe_id") else [s.get("keyframe_id") for s in i.get("steps") or []] for i in items]
    return [k for ks in ids for k in ks if k]


class Registry:
    """The ten tools over a catalogue. images: name -> content of the images a request may refer to; context: feedback of the session so far
    (`positive_ids`, `negative_ids`)."""

    def __init__(self, catalogue: Catalogue, images: dict[str, bytes] | None = None, context: dict | None = None):
        self.catalogue, self.images, self.context = catalogue, dict(images or {}), dict(context or {})
        self.tools: dict[str, Tool] = {}
        c = catalogue
        rows = lambda df, **meta: (plain(df), meta)

        def understand(query: str) -> tuple[list[dict], dict]:
            u = c.understand(query)
            return [u], {"has_temporal": u["events"] is not None, "events": u["events"], "kind": u["kind"]}

        def disambiguation(candidates: list[dict], k: int = 4, score_gap: float = 0.02) -> tuple[list[dict], dict]:
            picks = c.disambiguation(candidates, k, score_gap)
            return [{"keyframe_id": i} for i in picks or []], {"confident": picks is None}

        for tool in (
            Tool("search_with_feedback", "Frames for a text, moved towards those liked and away from those disliked", {"query": S, "positive_ids": IDS, "negative_ids": IDS, "top_k": I, "rerank": B}, ("query",), lambda query, positive_ids=(), negative_ids=(), top_k=8, rerank=False: rows(c.search_with_feedback(query, positive_ids, negative_ids, top_k, rerank), query=query, positive=len(positive_ids), negative=len(negative_ids))),
            Tool("search", "Frames for a text; rerank looks closer and takes longer", {"query": S, "top_k": I, "rerank": B}, ("query",), lambda query, top_k=8, rerank=False: rows(c.search(query, top_k, rerank), query=query, rerank=rerank)),
            Tool("search_temporal", "Chains of frames of one video for two or more scenes in their order of time", {"events": IDS, "per_event_k": I, "max_results": I}, ("events",), lambda events, per_event_k=20, max_results=50: rows(c.search_temporal(events, per_event_k, max_results), events=list(events))),
            Tool("search_by_image", "Frames like a given image", {"image_ref": S, "top_k": I}, ("image_ref",), lambda image_ref, top_k=8: rows(c.search_by_image(self.image(image_ref), top_k), image_ref=image_ref)),
            Tool("search_multimodal", "Frames for a text and an image together", {"query": S, "image_ref": S, "text_weight": N, "top_k": I, "rerank": B}, ("query", "image_ref"), lambda query, image_ref, text_weight=0.5, top_k=8, rerank=False: rows(c.search_multimodal(query, self.image(image_ref), text_weight, top_k, rerank), query=query, image_ref=image_ref, text_weight=text_weight)),
            Tool("understand", "What a text names, and whether it gives an order of events", {"query": S}, ("query",), understand),
            Tool("neighbors", "Frames before and after one in its video", {"frame_id": S, "before": I, "after": I}, ("frame_id",), lambda frame_id, before=4, after=4: rows(c.neighbors(frame_id, before, after), frame_id=frame_id)),
            Tool("search_similar", "Frames like one of the catalogue", {"keyframe_id": S, "top_k": I}, ("keyframe_id",), lambda keyframe_id, top_k=8: rows(c.search_similar(keyframe_id, top_k), keyframe_id=keyframe_id)),
            Tool("suggest_concepts", "Words of the results that could narrow the query", {"candidate_ids": IDS, "query": S, "top_n": I}, ("candidate_ids", "query"), lambda candidate_ids, query, top_n=8: ([{"concept": w} for w in c.suggest_concepts(candidate_ids, query, top_n)], {"query": query})),
            Tool("disambiguation", "If results are too alike to decide: some that differ most, to ask which is meant", {"candidates": {"type": "array", "items": {"type": "object", "properties": {"keyframe_id": S, "score": N}}}, "k": I, "score_gap": N}, ("candidates",), disambiguation),
        ):
            self.register(tool)

    def register(self, tool: Tool) -> None:
        self.tools[tool.name] = tool

    def specs(self, style: str = "input_schema") -> list[dict]:
        return [t.spec(style) for t in self.tools.values()]

    def image(self, ref: str) -> bytes:
        if ref not in self.images:
            raise KeyError(f"no image {ref!r}, only {sorted(self.images)}")
        return self.images[ref]

    def call(self, name: str, **arguments) -> Result:
        """The tool's rows, or what went wrong."""
        if name not in self.tools:
            return Result(False, name, error=f"no tool {name!r}, only {sorted(self.tools)}")
        try:
            items, meta = self.tools[name].run(**arguments)
        except Exception as e:  # noqa: BLE001 - a planner reads the error and goes on
            return Result(False, name, error=f"{type(e).__name__}: {e}")
        return Result(True, name, items, meta)


def route(text: str | None, image: bool = False, feedback: bool = False, ordered: bool = False) -> str:
    """The search a request goes to: order in time first, then text with image, image, feedback, text."""
    if ordered:
        return "search_temporal"
    if image:
        return "search_multimodal" if text and text.strip() else "search_by_image"
    return "search_with_feedback" if feedback else "search"


def route_column(text: Column, image: Column, feedback: Column) -> Column:
    """route over columns; whether events are ordered is read from the text."""
    some = F.coalesce(F.trim(text) != "", F.lit(False))
    return F.when(T.temporal_order(text).isNotNull(), "search_temporal").when(image & some, "search_multimodal").when(image, "search_by_image").when(feedback, "search_with_feedback").otherwise("search")
