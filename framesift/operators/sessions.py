"""Sessions: memory, dialogues that ask for attributes and filters that narrow, for one user on the driver; dialogues of a whole table as a fold."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framesift.functions import text as T
from framesift.operators import bm25, dialogue, filters
from framesift.operators.search import Catalogue
from framesift.operators.tools import plain


@dataclass
class Memory:
    """Turns of a session with feedback: the latest wins, within one call the negative does."""

    turns: list[dict] = field(default_factory=list)
    labels: dict[str, int] = field(default_factory=dict)
    facts: dict[str, object] = field(default_factory=dict)

    def note(self, positive: Sequence[str] = (), negative: Sequence[str] = ()) -> None:
        for ids, label in ((positive, 1), (negative, -1)):
            for i in ids:
                if self.labels.get(i) != label:
                    self.labels.pop(i, None)  # what changes comes last
                self.labels[i] = label

    def add(self, query: str, results: Sequence[str] = (), positive: Sequence[str] = (), negative: Sequence[str] = (), **more) -> None:
        self.turns.append({"query": query, "results": list(results), "positive": list(positive), "negative": list(negative), **more})
        self.note(positive, negative)

    def recent(self, n: int = 3) -> list[dict]:
        return self.turns[-n:] if n > 0 else []

    def positive(self) -> list[str]:
        return [i for i, x in self.labels.items() if x > 0]

    def negative(self) -> list[str]:
        return [i for i, x in self.labels.items() if x < 0]

    def summary(self, n: int = 3) -> dict:
        return {"turns": len(self.turns), "recent_queries": [t["query"] for t in self.recent(n)], "positive_ids": self.positive(), "negative_ids": self.negative(), "facts": dict(self.facts)}


@dataclass
class Dialogue:
    """Filters gathered over turns, and the decision what to do next."""

    max_turns: int = 5
    filters: dict[str, str] = field(default_factory=dict)
    asked: list[str] = field(default_factory=list)
    turns: int = 0
    finished: bool = False

    def merge(self, values: dict[str, str | None]) -> dict[str, str]:
        """The filters after an answer; a later value wins, None says nothing."""
        self.filters |= {k: v for k, v in values.items() if v is not None}
        return self.filters

    def decide(self, hits: int, confident: bool, best: str | None) -> tuple[str, str | None]:
        """('rephrase' | 'finish' | 'ask', attribute). Both speakers' turns count; a turn's number begins with 0."""
        number = self.turns
        self.turns += 2
        if not hits:
            return "rephrase", None
        if confident or number >= self.max_turns or best is None:
            self.finished = True
            return "finish", None
        self.asked.append(best)
        return "ask", best


def tagged_search(frames: DataFrame, index: bm25.Index, text: str, attributes: dict[str, str], top_k: int = 200) -> DataFrame:
    """`id`, `video_id`, `timestamp`, `attributes`, `score`: frames with all attribute tags by BM25; if the text meets none of them, those with the
    tags, the number of tags as score. Ties by id. frames: `objects` holds the tags."""
    tags = [f"{k}:{v}" for k, v in attributes.items()]
    rows = filters.apply(frames, objects_all=tags)
    q = frames.sparkSession.createDataFrame([(0, text)], "q int, text string")
    found = bm25.top_k(bm25.score(index, q, "q", "text", rows.select(F.lit(0).alias("q"), "id") if tags else None), "q", "score", "id", top_k).select("id", "score")
    if tags and found.isEmpty():
        found = rows.select("id", F.lit(float(len(tags))).alias("score")).orderBy("id").limit(top_k)
    return F.broadcast(found).join(frames, "id").select("id", "video_id", "timestamp", T.tags_to_attributes(F.col("objects")).alias("attributes"), "score")  # top_k rows


class DialogueLoop:
    """Narrows candidates by questions. search(text, filters, top_k) -> rows with `id`, `video_id`, `timestamp`, `attributes` (a map), `score`."""

    def __init__(self, search: Callable[[str, dict[str, str], int], DataFrame], attributes: Sequence[str] = tuple(T.ATTRIBUTES), max_turns: int = 5, enough: int = 5, gap: float = 0.15):
        self.search, self.attributes, self.enough, self.gap = search, list(attributes), enough, gap
        self.state = Dialogue(max_turns)
        self.candidates: list[dict] = []
        self.max_turns = max_turns

    def start(self, text: str) -> tuple[str, str | None]:
        self.state = Dialogue(self.max_turns)
        return self.respond(text)

    def respond(self, text: str) -> tuple[str, str | None]:
        """('rephrase' | 'finish' | 'ask', the question or None). Raises RuntimeError once the dialogue is over."""
        if self.state.finished:
            raise RuntimeError("the dialogue is over; start another")
        q = F.lit(text)
        spark_row = self._row([T.slot(q, a).alias(a) for a in T.ATTRIBUTES])
        found = self.search(text, self.state.merge(spark_row), 200)
        self.candidates = plain(found.orderBy(F.col("score").desc(), "id"))  # 200 at most
        best = None
        if self.candidates:
            wide = found.select(*(F.col("attributes")[a].alias(a) for a in self.attributes))
            row = dialogue.best_attribute(dialogue.entropy(wide, self.attributes), self.state.asked).head()
            best = row["attribute"] if row else None
        scores = [c["score"] for c in self.candidates]
        sure = len(scores) <= self.enough or round(scores[0] - scores[1], 9) >= self.gap
        step, attribute = self.state.decide(len(scores), sure, best)
        return step, self._row([T.question(F.lit(attribute)).alias("question")])["question"] if attribute else None

    @staticmethod
    def _row(columns: list[Column]) -> dict:
        from pyspark.sql import SparkSession

        return SparkSession.active().range(1).select(*columns).head().asDict()

    def answer(self) -> list[dict]:
        """The best candidates as the dialogue stands."""
        return self.candidates[: self.enough]


class FilterSession:
    """A pool of results that each turn narrows by more text, likes and dislikes, or a choice among some that differ."""

    def __init__(self, catalogue: Catalogue, start: int = 60, share: float = 0.5, least: int = 3):
        self.catalogue, self.start_k, self.share, self.least = catalogue, start, share, least
        self.reset()

    def reset(self) -> None:
        self.memory, self.parts, self.pool = Memory(), [], []

    @property
    def query(self) -> str:
        return " ".join(self.parts)

    def _search(self, top_k: int) -> list[dict]:
        m = self.memory
        if m.labels:
            return plain(self.catalogue.search_with_feedback(self.query, m.positive(), m.negative(), top_k))
        return plain(self.catalogue.search(self.query, top_k))

    def _result(self, before: int) -> dict:
        picks = set(self.catalogue.disambiguation(self.pool) or [])
        said = self.catalogue.texts([c["keyframe_id"] for c in self.pool])
        return {"query": self.query, "results": [c | {"text": said.get(c["keyframe_id"], "")} for c in self.pool], "count": len(self.pool), "count_before": before, "disambiguation": [c["keyframe_id"] for c in self.pool if c["keyframe_id"] in picks], "turn": len(self.memory.turns), "finished": len(self.pool) <= 1, "memory": self.memory.summary()}

    def start(self, query: str, k: int | None = None) -> dict:
        """Raises ValueError for a blank query."""
        if not (query or "").strip():
            raise ValueError("a description is needed")
        self.reset()
        self.parts = [query.strip()]
        self.pool = self._search(k or self.start_k)
        self.memory.add(query.strip(), [c["keyframe_id"] for c in self.pool], route="filter_start")
        return self._result(0)

    def refine(self, text: str | None = None, positive: Sequence[str] = (), negative: Sequence[str] = (), pick: str | None = None, others: Sequence[str] = (), k: int | None = None) -> dict:
        """The best of the pool after a search five times as wide (50 at least); as they were if none of them is found. A pick counts as
        liked, the others offered with it as disliked. Raises RuntimeError without a pool."""
        if not self.pool:
            raise RuntimeError("nothing to refine; start first")
        before = len(self.pool)
        if (text or "").strip():
            self.parts.append(text.strip())
        liked = [*positive, *([pick] if pick else [])]
        disliked = [*negative, *(o for o in others if pick and o != pick)]
        self.memory.note(liked, disliked)
        members = {c["keyframe_id"] for c in self.pool}
        ranked = [c for c in self._search(max(5 * before, 50)) if c["keyframe_id"] in members] or self.pool
        keep = k or max(self.least, min(math.ceil(before * self.share), max(before - 1, 1)))
        self.pool = ranked[:keep]
        self.memory.add(text or "", [c["keyframe_id"] for c in self.pool], liked, disliked, route="filter_refine")
        return self._result(before)


def fold_dialogues(turns: DataFrame, items: DataFrame, conv: str, turn: str, attributes: Sequence[str], max_turns: int = 5, enough: int = 5) -> DataFrame:
    """`conv`, `turn`, `hits`, `step`, `asked`: what a dialogue does after each turn, until it finishes, for all dialogues of a table at once.

    turns: a column for each attribute with the value given in the turn, or null; items: the same columns. Filters gather, the latest value
    wins. No item left: 'rephrase'; at most `enough` left, the turn's number (two a turn, from 0) max_turns or more, or nothing to
    ask: 'finish'; else 'ask' for the attribute of the highest entropy among the items left that wasn't asked, the first of equal ones.
    Items count alike, so scores decide nothing. Counts of all sets of filters come from one cube of the items, not from a join with them;
    a dialogue's turns meet in one row."""
    n = len(attributes)
    a = [f"__{i}" for i in range(n)]  # names of their own, as attributes may be called anything
    w = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    state = turns.select(conv, turn, *(F.last(x, ignorenulls=True).over(w).alias(y) for x, y in zip(attributes, a, strict=True)))
    items = items.select(*(F.col(x).alias(y) for x, y in zip(attributes, a, strict=True)))
    # a bit set: the attribute isn't bound in this row of the cube; an item's null is a value of its own, which no filter meets
    cube = items.cube(*a).agg(F.count("*").alias("m"), F.grouping_id().alias("g"))
    value = lambda x, i: F.when(F.shiftright("g", n - 1 - i).bitwiseAND(1) == 0, F.col(x))
    cube = cube.select(*(value(x, i).alias(x) for i, x in enumerate(a)), "m", "g")
    free = lambda i: 1 << (n - 1 - i)
    some = F.lit(True)
    for i, x in enumerate(a):
        some = some & ((F.col("g").bitwiseAND(free(i)) != 0) | F.col(x).isNotNull())
    bound = cube.where(some)
    hits = bound.select(*a, F.col("m").alias("hits"))
    entropies = None
    for i, x in enumerate(a):  # rows of the cube with x bound, summed over x: the entropy of x under the other filters
        e = bound.where(F.col("g").bitwiseAND(free(i)) == 0).groupBy(*(y for y in a if y != x), F.col("g")).agg(F.sum("m").alias("t"), F.sum(F.col("m") * F.log2("m")).alias("s"))
        e = e.select(*(F.lit(None).cast(items.schema[y].dataType).alias(y) if y == x else F.col(y) for y in a), F.lit(i).alias("i"), F.round(F.log2("t") - F.col("s") / F.col("t"), 6).alias("h"))
        entropies = e if entropies is None else entropies.unionAll(e)
    ranked = entropies.where("h > 0").groupBy(*a).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("h")).alias("h"), "i"))), lambda x: x["i"]).alias("best"))
    same = lambda left, right: [left[x].eqNullSafe(right[x]) for x in a]
    sets = state.select(*a).distinct()
    known = sets.join(hits, same(sets, hits), "left").select(*(sets[x] for x in a), F.coalesce("hits", F.lit(0)).alias("hits"))
    known = known.join(ranked, same(known, ranked), "left").select(*(known[x] for x in a), "hits", F.coalesce("best", F.array().cast("array<int>")).alias("best"))
    each = state.join(known, same(state, known)).select(conv, F.struct(F.col(turn).alias("turn"), "hits", "best").alias("x"))
    rows = each.groupBy(conv).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    out = "array<struct<turn:{t},hits:bigint,step:string,asked:string>>".format(t=turns.schema[turn].dataType.simpleString())
    zero = F.struct(F.lit(0).alias("number"), F.lit(False).alias("over"), F.array().cast("array<int>").alias("asked"), F.array().cast(out).alias("out"))
    names = F.array(*map(F.lit, attributes))

    def step(s: Column, x: Column) -> Column:
        best = F.get(F.filter(x["best"], lambda i: ~F.array_contains(s["asked"], i)), F.lit(0))
        done = (x["hits"] <= enough) | (s["number"] >= max_turns) | best.isNull()
        what = F.when(x["hits"] == 0, "rephrase").when(done, "finish").otherwise("ask")
        asks = F.when(what == "ask", best)
        row = F.struct(x["turn"].alias("turn"), x["hits"].cast("bigint").alias("hits"), what.alias("step"), F.get(names, asks).alias("asked"))
        return F.when(s["over"], s).otherwise(F.struct((s["number"] + 2).alias("number"), (what == "finish").alias("over"), F.when(asks.isNull(), s["asked"]).otherwise(F.array_append(s["asked"], asks)).alias("asked"), F.array_append(s["out"], row).alias("out")))

    return rows.select(conv, F.explode(F.aggregate("xs", zero, step, lambda s: s["out"])).alias("y")).select(conv, F.col("y.turn").alias(turn), "y.hits", "y.step", "y.asked")
