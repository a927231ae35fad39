"""Operators of interactive search: uncertainty, questions, feedback and reranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framesift.functions import text as T
from framesift.functions import vectors as V


def entropy(rows: DataFrame, attributes: list[str]) -> DataFrame:
    """`attribute`, `ord`, `entropy`: Shannon entropy in bits of each column's values, nulls aside; 0 without values."""
    pairs = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for i, a in enumerate(attributes)))
    counts = rows.select(F.explode(pairs).alias("x")).select("x.*").groupBy("ord", "attribute", "value").agg(F.count("*").alias("n"))
    # sums only, so the values of an attribute never gather in one task: H = log2 N - sum(n log2 n) / N
    n = F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)
    s = counts.groupBy("ord", "attribute").agg(F.sum(n).alias("total"), F.sum(F.when(n > 0, n * F.log2(n)).otherwise(0.0)).alias("s"))
    return s.select("attribute", "ord", F.round(F.when(F.col("total") > 0, F.log2("total") - F.col("s") / F.col("total")).otherwise(0.0), 6).alias("entropy"))


def best_attribute(entropies: DataFrame, asked: list[str] = ()) -> DataFrame:
    """The attribute with the highest entropy above 0 that wasn't asked yet; the first of equal ones."""
    return entropies.where((F.col("entropy") > 0) & ~F.col("attribute").isin(list(asked))).orderBy(F.col("entropy").desc(), "ord").limit(1).select("attribute", "entropy")


def confidence(ranked: DataFrame, by: str, score: str, most: int, gap: float) -> DataFrame:
    """`by`, `n`, `gap`, `confident`: few candidates, or a clear distance between the two best scores."""
    some = ranked.where(F.col(score).isNotNull() & ~F.isnan(score))
    # scores are counted before they meet, so a group's many rows don't gather: a is the best, b the next, which may be equal
    counts = some.groupBy(by, F.col(score).alias("x")).agg(F.count("*").alias("m"))
    best = counts.groupBy(by).agg(F.sum("m").alias("n"), F.max(F.struct("x", "m")).alias("top"))
    next_ = counts.join(best.select(by, F.col("top.x").alias("t")), by).where("x < t").groupBy(by).agg(F.max("x").alias("second"))
    s = best.join(next_, by, "left").select(by, "n", F.col("top.x").alias("a"), F.when(F.col("top.m") > 1, F.col("top.x")).otherwise(F.col("second")).alias("b"))
    d = F.round(F.col("a") - F.col("b"), 6)
    return s.select(by, "n", d.alias("gap"), ((F.col("n") <= most) | F.coalesce(d >= gap, F.lit(True))).alias("confident"))


def latest_feedback(turns: DataFrame, by: str, turn: str, item: str, label: str) -> DataFrame:
    """`by`, `item`, `label`: the label (1 or -1) of the latest turn wins; within one turn -1 does."""
    return turns.groupBy(by, item).agg(F.max_by(label, F.struct(F.col(turn), -F.col(label))).alias(label))


def latest_values(turns: DataFrame, by: str, turn: str, attribute: str, value: str) -> DataFrame:
    """`by`, `attribute`, `value`: of the values given over the turns the latest that isn't null."""
    return turns.where(F.col(value).isNotNull()).groupBy(by, attribute).agg(F.max_by(value, turn).alias(value))


def recent(turns: DataFrame, by: str, turn: str, n: int) -> DataFrame:
    """The last n turns of each session."""
    w = Window.partitionBy(by).orderBy(F.col(turn).desc())
    return turns.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")


def rocchio(query: Column, positive: Column, negative: Column, alpha: float = 1.0, beta: float = 0.75, gamma: float = 0.15) -> Column:
    """The query moved to the mean of the positive and away from that of the negative vectors, at unit length; null means count as absent."""
    return V.l2_normalize(V.add(V.add(query, positive, alpha, beta), negative, 1.0, -gamma))


def multimodal(text: Column, image: Column, weight: float = 0.5) -> Column:
    """The blend of a text and an image vector at unit length; one of them, at unit length, if the other is null. An error for two nulls."""
    both = V.l2_normalize(V.add(text, image, weight, 1 - weight))
    one = F.when(image.isNull(), V.l2_normalize(text)).when(text.isNull(), V.l2_normalize(image)).otherwise(both)
    return F.when(text.isNull() & image.isNull(), F.raise_error(F.lit("a blend needs a text or an image"))).otherwise(one)


def early_stop(scored: DataFrame, by: str, order: str, score: str, least: int = 5, margin: float = 0.2, pool: int = 50) -> DataFrame:
    """Candidates in the order of scoring up to the one at which, after `least`, the two best scores so far differ by margin; pool at most."""
    w = Window.partitionBy(by).orderBy(order)
    sofar = w.rowsBetween(Window.unboundedPreceding, 0)
    # the two best so far: an array of at most two is carried by taking it from the last row's array
    c = scored.withColumn("n", F.row_number().over(w)).where(F.col("n") <= pool)
    c = c.withColumn("best", F.slice(F.sort_array(F.collect_list(score).over(sofar), asc=False), 1, 2))
    done = (F.col("n") >= least) & (F.size("best") > 1) & (F.round(F.element_at("best", 1) - F.element_at("best", 2), 9) >= margin)
    c = c.withColumn("stops", F.sum(done.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return c.where(F.coalesce("stops", F.lit(0)) == 0).drop("best", "stops")


def shrink_size(n: Column, share: float = 0.5, least: int = 3) -> Column:
    """How many candidates stay after a refinement of n."""
    return F.greatest(F.lit(least), F.least(F.ceil(n * share), F.greatest(n - 1, F.lit(1))))


def suggest_concepts(rows: DataFrame, by: str, order: str, query: str, texts: Sequence[str], top_n: int = 8, stop: Sequence[str] = tuple(T.STOP_WORDS)) -> DataFrame:
    """`by`, `tok`, `n`, `rank`: the most frequent words of each group's texts, of three letters or more, neither in the group's query nor
    among the stop words; of equally frequent ones the first seen, rows by `order`, texts as given."""
    words = T.tokenize(F.array_join(F.filter(F.array(*texts), lambda x: x.isNotNull() & (x != "")), " "))
    toks = rows.select(by, F.col(order).alias("o"), T.tokenize(F.col(query)).alias("asked"), F.posexplode(words).alias("p", "tok"))
    toks = toks.where((F.length("tok") >= 3) & ~F.coalesce(F.array_contains("asked", F.col("tok")), F.lit(False)) & ~F.col("tok").isin(list(stop)))
    n = toks.groupBy(by, "tok").agg(F.count("*").alias("n"), F.min(F.struct("o", "p")).alias("first"))
    w = Window.partitionBy(by).orderBy(F.col("n").desc(), "first")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n).select(by, "tok", "n", "rank")


def diverse_pick(rows: DataFrame, by: str, rank: str, key: str, vector: str, k: int = 4, most: int = 50) -> DataFrame:
    """`by`, `key`, `pick`: of each group's `most` first rows k that differ most: the first, then again and again the one farthest (Euclid)
    from all picked so far; of equally far ones the first. Rows without vector take no part; a group holds `most` rows at most."""
    first = rows.where(F.col(vector).isNotNull()).withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(rank, key))).where(F.col("r") <= most)
    item = F.struct((-F.col("r")).alias("r"), F.col(key).alias("key"), V.as_double(F.col(vector)).alias("v"))
    groups = first.groupBy(by).agg(F.sort_array(F.collect_list(item), asc=False).alias("items"))
    far = lambda a, b: F.round(F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)), 9)

    def step(picked: Column, _: Column) -> Column:
        rest = F.filter("items", lambda x: ~F.exists(picked, lambda p: p["r"] == x["r"]))
        by_distance = F.transform(rest, lambda x: F.struct(F.array_min(F.transform(picked, lambda p: far(x["v"], p["v"]))).alias("d"), x["r"].alias("r"), x["key"].alias("key"), x["v"].alias("v")))
        best = F.slice(F.sort_array(by_distance, asc=False), 1, 1)
        return F.concat(picked, F.transform(best, lambda b: F.struct(b["r"].alias("r"), b["key"].alias("key"), b["v"].alias("v"))))

    picked = F.aggregate(F.array(*map(F.lit, range(1, k))), F.slice("items", 1, 1), step) if k > 1 else F.slice("items", 1, 1)
    return groups.select(by, F.posexplode(picked).alias("pick", "x")).select(by, F.col("x.key").alias(key), (F.col("pick") + 1).alias("pick"))
