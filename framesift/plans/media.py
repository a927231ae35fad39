"""Queries of time and duplicates: chains, intervals, neighbours, samples, collapse of near-duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.operators import dedup, filters, temporal
from framesift.plans.base import CLIP, K, L, candidates, clips, frames, labels, ok, query
from framesift.session import table


@query("temporal_window", f"with {K} select id, ts as t from k where video_id = 'v_live_01' and abs(ts - 60) <= 10")
def temporal_window(s: SparkSession, d: str) -> DataFrame:
    return filters.temporal_window(frames(s, d, "video_id", "timestamp"), "v_live_01", 60.0, 10.0).select("id", F.col("timestamp").alias("t"))


@query("relevant_ids", f"with {K}, {L} select label_id, id from l join k using (video_id) where ts >= w[1] and ts < w[2]")
def relevant_ids(s: SparkSession, d: str) -> DataFrame:
    return temporal.relevant(frames(s, d, "video_id", "timestamp"), labels(s, d))


_ALL = "with e as (select event_id id, user_id video_id, ts t, value score, event_type from events)"


def _events(s: SparkSession, d: str, *kinds: str) -> list[DataFrame]:
    e = table(s, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("video_id"), F.col("ts").alias("t"), F.col("value").alias("score"), "event_type")
    return [e.where(F.col("event_type") == k).drop("event_type") for k in kinds]


@query("temporal_chain_2", _ALL + " select a.video_id, a.id as id_1, b.id as id_2, round(a.score + b.score, 6) as total from e a join e b on a.video_id = b.video_id and a.t < b.t where a.event_type = 'view' and b.event_type = 'purchase'")
def temporal_chain_2(s: SparkSession, d: str) -> DataFrame:
    return temporal.event_chains(_events(s, d, "view", "purchase")).select("video_id", "id_1", "id_2", F.round("total", 6).alias("total"))


@query("temporal_chain_3", _ALL + """ select a.video_id, a.id as id_1, b.id as id_2, x.id as id_3, round(a.score + b.score + x.score, 6) as total from e a join e b on a.video_id = b.video_id and a.t < b.t
join e x on x.video_id = b.video_id and b.t < x.t where a.event_type = 'signup' and b.event_type = 'click' and x.event_type = 'error'""")
def temporal_chain_3(s: SparkSession, d: str) -> DataFrame:
    return temporal.event_chains(_events(s, d, "signup", "click", "error")).select("video_id", "id_1", "id_2", "id_3", F.round("total", 6).alias("total"))


@query("temporal_chain_best", _ALL + """, p as (select * from (select *, row_number() over (partition by video_id, event_type order by score desc, id) r from e) where r <= 20)
select a.video_id, a.id as id_1, b.id as id_2, round(a.score + b.score, 6) as total from p a join p b on a.video_id = b.video_id and a.t < b.t where a.event_type = 'view' and b.event_type = 'purchase' order by total desc, a.t, a.video_id, b.t, a.id, b.id limit 50""")
def temporal_chain_best(s: SparkSession, d: str) -> DataFrame:
    """The fifty best chains of each user's twenty best events of a kind, as a search for two scenes gives them."""
    chains = temporal.event_chains(_events(s, d, "view", "purchase"), 20).withColumn("total", F.round("total", 6))
    return chains.orderBy(F.col("total").desc(), "t_1", "video_id", "t_2", "id_1", "id_2").limit(50).select("video_id", "id_1", "id_2", "total")


@query("has_valid_ordering", _ALL + """, u as (select distinct video_id from e), c as (select distinct a.video_id from e a join e b on a.video_id = b.video_id and a.t < b.t join e x on x.video_id = b.video_id and b.t < x.t
where a.event_type = 'signup' and b.event_type = 'click' and x.event_type = 'error') select video_id, c.video_id is not null as valid from u left join c using (video_id)""")
def has_valid_ordering(s: SparkSession, d: str) -> DataFrame:
    """Whether a user has a signup, then a click, then an error."""
    return temporal.has_chain(_events(s, d, "signup", "click", "error"), table(s, d, "events").select(F.col("user_id").alias("video_id")).distinct())


@query("common_videos", "select user_id as video_id from events where event_type = 'view' intersect select user_id from events where event_type = 'purchase' intersect select user_id from events where event_type = 'error'")
def common_videos(s: SparkSession, d: str) -> DataFrame:
    a, b, c = (e.select("video_id") for e in _events(s, d, "view", "purchase", "error"))
    return a.intersect(b).intersect(c)


_SEG = "s as (select * from asr_segments where video_id is not null and start_sec is not null and end_sec is not null and transcript is not null and start_sec <= end_sec)"


@query("segment_asof", f"""with {K}, {_SEG}, p as (select k.id, segment_id, transcript, ts >= start_sec and ts < end_sec covers, start_sec, case when ts >= start_sec and ts < end_sec then 0.0 else round(least(abs(ts - start_sec), abs(ts - end_sec)), 6) end::double gap from k join s using (video_id) where ts is not null),
r as (select *, row_number() over (partition by id order by covers desc, gap, start_sec, segment_id) r from p where gap <= 2) select id, segment_id, transcript, gap from r where r = 1""")
def segment_asof(s: SparkSession, d: str) -> DataFrame:
    return temporal.segment_asof(frames(s, d, "video_id", "timestamp"), table(s, d, "asr_segments"))


_N = f"{K}, n as (select *, row_number() over (partition by video_id order by ts, id) n, count(*) over (partition by video_id) len from k where video_id is not null and ts is not null)"


@query("neighbors", f"with {_N}, {L}, x as (select distinct keyframe_id id from candidates), c as (select n.* from n join x using (id)) select c.id as center, n.id as id, (n.n - c.n)::bigint as \"offset\" from c join n on c.video_id = n.video_id and n.n between c.n - 2 and c.n + 2")
def neighbors(s: SparkSession, d: str) -> DataFrame:
    chosen = candidates(s, d).select(F.col("keyframe_id").alias("id"))
    return temporal.neighbors(frames(s, d, "video_id", "timestamp"), chosen).select("center", "id", F.col("offset").cast("bigint").alias("offset"))


@query("explore", f"with {_N}, p as (select video_id, len, unnest(range(least(4, len))) i, least(4, len) take from (select distinct video_id, len from n)), spots as (select distinct video_id, case when take = 1 then 0 else round_even(i * (len - 1) / (take - 1), 0) end::bigint s from p) select n.video_id, id, ts as \"timestamp\" from n join spots on spots.video_id = n.video_id and n.n - 1 = s")
def explore(s: SparkSession, d: str) -> DataFrame:
    return temporal.explore(frames(s, d, "video_id", "timestamp"), 4)


@query("systematic_sample", f"with {_N} select id, video_id from n where (n - 1) % 3 = 0")
def systematic_sample(s: SparkSession, d: str) -> DataFrame:
    return temporal.systematic_sample(frames(s, d, "video_id", "timestamp"), 3).select("id", "video_id")


@query("uniform_subsample", f"with {_N}, p as (select video_id, len, unnest(range(5)) i from (select distinct video_id, len from n where len > 5)) select id, n.video_id from n where len <= 5 union all select id, n.video_id from n join p on p.video_id = n.video_id and n.n - 1 = (p.i * p.len) // 5")
def uniform_subsample(s: SparkSession, d: str) -> DataFrame:
    return temporal.uniform_subsample(frames(s, d, "video_id", "timestamp"), 5).select("id", "video_id")


_FOLD = """with recursive {K}, n as (select video_id, id, {v} v, ts, row_number() over (partition by video_id order by ts, id) n from k where video_id is not null and ts is not null and {ok}),
f as (select video_id, n, id, id as anchor, v as av from n where n = 1 union all
  select n.video_id, n.n, n.id, case when round({sim}, 9) >= {t} then f.anchor else n.id end, case when round({sim}, 9) >= {t} then f.av else n.v end from f join n on n.video_id = f.video_id and n.n = f.n + 1)"""
_ANCHOR = _FOLD.replace("{K}", K).replace("{v}", "clip").replace("{ok}", ok("clip", 64)).replace("{sim}", "list_cosine_similarity(f.av, n.v)").replace("{t}", "0.97")


def _clusters(s: SparkSession, d: str) -> DataFrame:
    return dedup.anchor_clusters(clips(s, d), "vec", 0.97)


@query("anchor_dedup", _ANCHOR + " select video_id, id, anchor from f")
def anchor_dedup(s: SparkSession, d: str) -> DataFrame:
    return _clusters(s, d).select("video_id", "id", "anchor")


@query("dedup_clusters", _ANCHOR + ", g as (select f.video_id, anchor, count(*) members, min(ts) a, max(ts) b from f join n on n.id = f.id group by f.video_id, anchor) select video_id, anchor as id, members, case when members > 1 then a end as t_start, case when members > 1 then b end as t_end from g")
def dedup_clusters(s: SparkSession, d: str) -> DataFrame:
    return dedup.representatives(_clusters(s, d))


@query("dedup_ratio", _ANCHOR + " select count(*) as frames, count(*) filter (anchor = id) as representatives, round(1 - count(*) filter (anchor = id) / count(*), 6) as ratio from f")
def dedup_ratio(s: SparkSession, d: str) -> DataFrame:
    return dedup.reduction(_clusters(s, d))


_CENTRED = "list_transform(clip, lambda x: x - list_avg(clip))"


@query("hist_dedup", _FOLD.replace("{K}", K).replace("{v}", _CENTRED).replace("{ok}", ok("clip", 64)).replace("{sim}", "list_cosine_similarity(f.av, n.v)").replace("{t}", "0.985") + " select video_id, id, anchor from f")
def hist_dedup(s: SparkSession, d: str) -> DataFrame:
    """The fold by correlation, as it drops frames whose histogram hardly differs from that of the last one kept."""
    return dedup.anchor_clusters(clips(s, d), "vec", 0.985, "pearson").select("video_id", "id", "anchor")


@query("representatives_check", f"with {K} select video_id, count(*) as frames, count(*) filter (id in (select id from keyframes where is_cluster_representative)) as marked from k where video_id is not null group by video_id")
def representatives_check(s: SparkSession, d: str) -> DataFrame:
    """Frames of each video and those marked as representatives."""
    f = table(s, d, "keyframes").where("id is not null").groupBy("id").agg(F.first("video_id").alias("video_id"), F.max("is_cluster_representative").alias("m"))
    return f.where("video_id is not null").groupBy("video_id").agg(F.count("*").alias("frames"), F.count(F.when(F.col("m"), 1)).alias("marked"))


@query("dataset_health", f"with {K} select count(*) as keyframes, count(distinct video_id) as videos, count(*) filter ({ok('clip', 64)}) as clip, count(*) filter ({ok('sig', 48)}) as siglip from k")
def dataset_health(s: SparkSession, d: str) -> DataFrame:
    from framesift.functions import vectors as V

    f = frames(s, d, "video_id", "clip_embedding", "siglip_embedding")
    return f.agg(F.count("*").alias("keyframes"), F.countDistinct("video_id").alias("videos"), F.count(F.when(V.usable(F.col("clip_embedding"), CLIP), 1)).alias("clip"), F.count(F.when(V.usable(F.col("siglip_embedding"), 48), 1)).alias("siglip"))


@query("session_windows", """with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end fresh from events), g as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) n from e)
select user_id, min(ts) as first_ts, count(*) as n from g group by user_id, n""")
def session_windows(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("first_ts"), "n")


@query("stream_dedup", _ANCHOR + " select distinct video_id, anchor as id from f")
def stream_dedup(s: SparkSession, d: str) -> DataFrame:
    """The collapse as a stream over all that is there; a single file makes a single micro-batch, whose result is the batch's."""
    from framesift.functions import vectors as V
    from framesift.session import shared_path
    from framesift.streaming import ingest

    schema = table(s, d, "keyframes").schema
    k = s.readStream.schema(schema).parquet(f"{d}/keyframes.parque[t]").where(V.usable(F.col("clip_embedding"), CLIP)).where("id is not null")
    out = shared_path(s, "stream")
    q = ingest.collapse_stream(k, "clip_embedding", 0.97).writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows")
    q.awaitTermination()
    return s.read.schema("video_id string, id string, timestamp double").parquet(f"{out}/rows").select("video_id", "id")
