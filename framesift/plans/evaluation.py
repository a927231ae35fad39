"""Queries of retrieval metrics and paired statistics over the labels' searches.

The run judged is the first 100 of BM25, in SQL as well: rr is 0 if the first relevant frame comes later, and ap counts the
relevant frames within it over all there are, so a label with more than 100 can't reach 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.operators import bm25, temporal
from framesift.operators import metrics as M
from framesift.plans.base import frames, labels, query
from framesift.plans.retrieval import _BM25, _RANKED, _asked, _bm25

_RUN = f"""with {_BM25}, run as (select * from (select label_id, id, {_RANKED} from bm) where rank <= 100), rel as (select label_id, id from l join k using (video_id) where ts >= w[1] and ts < w[2]),
qs as (select label_id from l where label_id % 50 = 0 and query is not null), nr as (select label_id, count(*) n from rel group by label_id),
j as (select r.label_id, r.rank, case when rel.id is null then 0 else 1 end rel from run r left join rel using (label_id, id)), h as (select *, sum(rel) over (partition by label_id order by rank) hits from j),
g as (select label_id, sum(rel) filter (rank <= 10) top, min(rank) filter (rel = 1) f, sum(case when rel = 1 then hits / rank else 0 end) p, sum(case when rel = 1 and rank <= 10 then 1 / log2(rank + 1) else 0 end) dcg from h group by label_id),
m as (select qs.label_id, coalesce(top / nr.n, 0) recall, case when top > 0 and nr.n is not null then 1.0 else 0.0 end hit, case when nr.n is null then 0 else coalesce(1 / f, 0) end rr, coalesce(p / nr.n, 0) ap, coalesce(dcg / list_sum(list_transform(range(1, least(nr.n, 10) + 1), lambda i: 1 / log2(i + 1))), 0) ndcg from qs left join nr using (label_id) left join g using (label_id))"""


def _per(s: SparkSession, d: str, k: int = 10) -> DataFrame:
    runs = bm25.top_k(_bm25(s, d), "label_id", "score", "id", 100).select("label_id", "id", "rank")
    rel = temporal.relevant(frames(s, d, "video_id", "timestamp"), labels(s, d))
    asked = _asked(s, d)
    return M.per_query(asked, runs, rel.join(asked.select("label_id"), "label_id", "left_semi"), "label_id", "id", k)


for _name, _metric in (("recall_at_k", "recall"), ("hit_at_k", "hit"), ("mrr", "rr"), ("map", "ap"), ("ndcg_at_k", "ndcg")):
    query(_name, _RUN + f" select label_id, round({_metric}, 6)::double as {_metric} from m")(lambda s, d, m=_metric: _per(s, d).select("label_id", m))


@query("mean_metrics", _RUN + " select coalesce(round(avg(recall), 6), 0)::double as recall, coalesce(round(avg(rr), 6), 0)::double as rr, coalesce(round(avg(ap), 6), 0)::double as ap, coalesce(round(avg(ndcg), 6), 0)::double as ndcg from m")
def mean_metrics(s: SparkSession, d: str) -> DataFrame:
    return _per(s, d).agg(*(F.round(F.coalesce(F.avg(m), F.lit(0.0)), 6).alias(m) for m in ("recall", "rr", "ap", "ndcg")))


_HITS = "with u as (select user_id, count(*) n, count(*) filter (value > 80) a, count(*) filter (event_type = 'purchase') b from events group by user_id)"


def _hits(s: SparkSession, d: str) -> DataFrame:
    from framesift.session import table

    return table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("value") > 80, 1)).alias("a"), F.count(F.when(F.col("event_type") == "purchase", 1)).alias("b"))


@query("wilson", _HITS + """, p as (select user_id, n, a / n p from u) select user_id, round(greatest(0, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 6) as lo,
round(least(1, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 6) as hi from p""")
def wilson(s: SparkSession, d: str) -> DataFrame:
    lo, hi = M.wilson(F.col("a"), F.col("n"))
    return _hits(s, d).select("user_id", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


_DISC = _HITS + ", d as (select count(*) filter (a > 2 and not b > 2) x, count(*) filter (b > 2 and not a > 2) y from u)"
_P = "round(case when x + y = 0 then 1.0 else least(1.0, 2 * list_sum(list_transform(range(0, least(x, y) + 1), lambda i: exp(lgamma(x + y + 1) - lgamma(i + 1) - lgamma(x + y - i + 1) - (x + y) * ln(2.0))))) end, 6)"


@query("mcnemar", _DISC + f" select x as only_a, y as only_b, {_P} as p from d")
def mcnemar(s: SparkSession, d: str) -> DataFrame:
    return M.mcnemar(_hits(s, d).select((F.col("a") > 2).cast("int").alias("a"), (F.col("b") > 2).cast("int").alias("b")), "a", "b")


@query("compare_configs", _DISC + f", r as (select avg((a > 2)::int) ra, avg((b > 2)::int) rb from u) select round(ra, 6) as rate_a, round(rb, 6) as rate_b, {_P} as p, {_P} < 0.05 as differs from d, r")
def compare_configs(s: SparkSession, d: str) -> DataFrame:
    h = _hits(s, d).select((F.col("a") > 2).cast("int").alias("a"), (F.col("b") > 2).cast("int").alias("b"))
    rates = h.agg(F.round(F.avg("a"), 6).alias("rate_a"), F.round(F.avg("b"), 6).alias("rate_b"))
    return rates.join(F.broadcast(M.mcnemar(h, "a", "b").select("p"))).withColumn("differs", F.col("p") < 0.05)
