"""An agent over a catalogue's tools: a planner by rules, a reader that cites, and requests with or without memory."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from framesift.operators.search import Catalogue
from framesift.operators.sessions import Memory
from framesift.operators.tools import Registry, Result, result_ids, route


@dataclass(frozen=True)
class Step:
    tool: str | None  # None: the planner is done
    arguments: dict
    why: str
    result: Result | None = None


@dataclass
class Run:
    query: str
    steps: list[Step] = field(default_factory=list)
    results: list[dict] = field(default_factory=list)
    answer: str | None = None
    meta: dict = field(default_factory=dict)

    def tools_used(self) -> list[str]:
        return [s.tool for s in self.steps if s.tool]


class Planner(Protocol):
    """Fills run.results and run.meta by calls of the registry, each taken down as a step; run.answer if it can."""

    def __call__(self, run: Run, registry: Registry, max_steps: int) -> None: ...


def call(run: Run, registry: Registry, tool: str, why: str, **arguments) -> Result:
    result = registry.call(tool, **arguments)
    run.steps.append(Step(tool, arguments, why, result))
    return result


def plan_by_rules(run: Run, registry: Registry, max_steps: int = 6) -> None:
    """Understands the text, takes the route it and the session give, and asks back if a search by text leaves it open."""
    seen = call(run, registry, "understand", "what does the text name", query=run.query)
    events = seen.meta.get("events") if seen.ok else None
    image = next(iter(registry.images), None)
    liked, disliked = (list(registry.context.get(k) or []) for k in ("positive_ids", "negative_ids"))
    to = route(run.query, image is not None, bool(liked or disliked), bool(events))
    arguments = {
        "search_temporal": {"events": events},
        "search_multimodal": {"query": run.query, "image_ref": image},
        "search_by_image": {"image_ref": image},
        "search_with_feedback": {"query": run.query, "positive_ids": liked, "negative_ids": disliked},
        "search": {"query": run.query, "rerank": False},
    }[to]
    found = call(run, registry, to, "the route of such a request", **arguments)
    run.results = found.items
    run.meta["route"] = to
    if run.results and to in ("search", "search_multimodal", "search_with_feedback"):
        asked = call(run, registry, "disambiguation", "is it clear which one is meant", candidates=[{"keyframe_id": i["keyframe_id"], "score": i.get("score") or 0.0} for i in run.results])
        if asked.ok and not asked.meta.get("confident", True):
            run.meta["need_clarification"] = result_ids(asked.items)
    run.steps.append(Step(None, {}, "results are there"))


@dataclass(frozen=True)
class Reading:
    answer: str
    cited: list[str]


def read_results(query: str, items: Sequence[dict], texts: Callable[[list[str]], dict[str, str]], top_k: int = 5) -> Reading:
    """An answer from the first results, flat ones or chains, that cites the frames it rests on.

    texts: ids -> their texts; a frame without any is given by its place alone."""
    top = list(items)[:top_k]
    if not top:
        return Reading(f'Không tìm thấy kết quả cho: "{query}".', [])
    cited = result_ids(top)
    at = lambda t: f"{float(t or 0):.1f}s"
    if any(i.get("steps") for i in top):
        lines = [f"video {i.get('video_id')}: " + " → ".join(f"[{s['keyframe_id']}] {at(s.get('timestamp'))} ({s.get('event')})" for s in i.get("steps") or []) for i in top]
        more = f" — {len(top)} chuỗi khớp nhất:" if len(items) > len(top) else ":"
        head = f'Tìm thấy {len(items)} chuỗi cảnh đúng thứ tự cho "{query}"{more}'
    else:
        said = texts(cited)
        lines = [f"[{i['keyframe_id']}] (video {i.get('video_id')} @ {at(i.get('timestamp'))})" + (f" — {t}" if (t := said.get(i["keyframe_id"])) else "") for i in top if i.get("keyframe_id")]
        head = f'Tìm thấy {len(items)} kết quả liên quan đến "{query}". {len(lines)} keyframe khớp nhất:'
    return Reading("\n".join([head, *lines]), cited)


class Agent:
    """Answers requests over a catalogue. reader: (query, items, texts) -> Reading, or None for no answer in words."""

    def __init__(self, catalogue: Catalogue, planner: Planner = plan_by_rules, reader: Callable[..., Reading] | None = read_results, memory: Memory | None = None):
        self.catalogue, self.planner, self.reader, self.memory = catalogue, planner, reader, memory or Memory()

    def run(self, query: str, images: dict[str, bytes] | None = None, context: dict | None = None, max_steps: int = 6) -> Run:
        """One request by itself. A planner's own answer stands; else the reader's does."""
        run = Run(query)
        self.planner(run, Registry(self.catalogue, images, context), max_steps)
        if self.reader and run.answer is None and run.results:
            reading = self.reader(query, run.results, self.catalogue.texts)
            run.answer, run.meta["cited"] = reading.answer, reading.cited
        return run

    def chat(self, query: str, images: dict[str, bytes] | None = None, positive: Sequence[str] = (), negative: Sequence[str] = (), max_steps: int = 6) -> Run:
        """One request of a session; positive and negative are about earlier results and last."""
        self.memory.note(positive, negative)
        run = self.run(query, images, {"positive_ids": self.memory.positive(), "negative_ids": self.memory.negative()}, max_steps)
        self.memory.add(query, result_ids(run.results), positive, negative, route=run.meta.get("route"), answer=run.answer)
        run.meta["memory"] = self.memory.summary()
        return run
