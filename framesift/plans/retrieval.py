"""Queries of search: filters, dense and sparse ranking, fusion, feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framesift.functions import text as T
from framesift.functions import vectors as V
from framesift.operators import bm25, dense, dialogue, filters, fusion
from framesift.plans.base import CLIP, SIGLIP, C, K, L, candidates, clips, frames, labels, ok, query, stored
from framesift.session import cut, table

PRINT = "round(list_sum(list_transform({v}, lambda x, i: x * i)), 6)"
UNIT = "case when list_inner_product({v}, {v}) = 0 then {v} else list_transform({v}, lambda x: x / sqrt(list_inner_product({v}, {v}))) end"


@query("filter_video", f"with {K} select id, video_id from k where video_id in ('v_live_01', 'v00000001')")
def filter_video(s: SparkSession, d: str) -> DataFrame:
    return filters.apply(frames(s, d, "video_id"), videos=["v_live_01", "v00000001"]).select("id", "video_id")


@query("filter_objects_all", f"with {K} select id from k where list_has_all(objects, ['Person', 'Car'])")
def filter_objects_all(s: SparkSession, d: str) -> DataFrame:
    return filters.apply(frames(s, d, "objects"), objects_all=["Person", "Car"]).select("id")


@query("filter_objects_any", f"with {K} select id from k where list_has_any(objects, ['Dog', 'Bus'])")
def filter_objects_any(s: SparkSession, d: str) -> DataFrame:
    return filters.apply(frames(s, d, "objects"), objects_any=["Dog", "Bus"]).select("id")


@query("filter_time_range", f"with {K} select id, ts as t from k where ts between 10 and 20")
def filter_time_range(s: SparkSession, d: str) -> DataFrame:
    return filters.apply(frames(s, d, "timestamp"), time_range=(10.0, 20.0)).select("id", F.col("timestamp").alias("t"))


@query("attribute_filter", "select event_id, user_id from events where event_type = 'purchase' and (props::json->>'k')::int = 3")
def attribute_filter(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("attributes", F.create_map(F.lit("type"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k")))
    return filters.attribute_filter(e, "attributes", {"type": "purchase", "k": "3", "place": None}).select("event_id", "user_id")


@query("l2_normalize", f"with {K} select id, {PRINT.format(v='u')} as fingerprint, round(sqrt(list_inner_product(u, u)), 6) as length from (select id, {UNIT.format(v='clip')} u from k where clip is not null and len(clip) = 64 and not list_bool_or(list_transform(clip, lambda x: isnan(x))))")
def l2_normalize(s: SparkSession, d: str) -> DataFrame:
    f = frames(s, d, "clip_embedding").where("size(clip_embedding) = 64 and forall(clip_embedding, x -> not isnan(x))").select("id", V.l2_normalize(F.col("clip_embedding")).alias("u"))
    return f.select("id", V.fingerprint(F.col("u")).alias("fingerprint"), F.round(V.norm(F.col("u")), 6).alias("length"))


@query("cosine_pairs", f"""with {K}, n as (select *, lag(id) over w before, lag(clip) over w b from k where ts is not null and video_id is not null and {ok('clip', 64)} window w as (partition by video_id order by ts, id))
select before as id_a, id as id_b, round(list_cosine_similarity(clip, b), 6) as cosine from n where before is not null""")
def cosine_pairs(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("video_id").orderBy("timestamp", "id")
    n = clips(s, d).where("timestamp is not null and video_id is not null").select(F.lag("id").over(w).alias("id_a"), F.col("id").alias("id_b"), F.lag("vec").over(w).alias("b"), "vec")
    return n.where("id_a is not null").select("id_a", "id_b", F.round(V.cosine(F.col("vec"), F.col("b")), 6).alias("cosine"))


def _knn(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    return e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("qv"))


_KNN = """with e as (select vec_id, label, embedding::double[] v from embeddings), p as (select q.vec_id query, e.vec_id, round(list_cosine_similarity(q.v, e.v), 6) similarity from e q, e where q.vec_id % 50 = 0 {where}),
r as (select *, row_number() over (partition by query order by similarity desc, vec_id) rank from p)"""


@query("exact_knn", _KNN.format(where="") + " select query, vec_id, similarity, rank from r where rank <= 10")
def exact_knn(s: SparkSession, d: str) -> DataFrame:
    return dense.batch_knn(*_knn(s, d), "vec_id", "embedding", "query", "qv", 10, CLIP)


@query("batch_knn", f"""with {K}, e as (select * from k where {ok('clip', 64)}), q as (select distinct on (video_id) id query, clip q from e where video_id is not null order by video_id, id),
p as (select query, id, round(list_cosine_similarity(q, clip), 6) similarity from q, e), r as (select *, row_number() over (partition by query order by similarity desc, id) rank from p) select query, id, similarity, rank from r where rank <= 5""")
def batch_knn(s: SparkSession, d: str) -> DataFrame:
    e = clips(s, d)
    first = e.where("video_id is not null").groupBy("video_id").agg(F.min_by(F.struct("id", "vec"), "id").alias("x")).select(F.col("x.id").alias("query"), F.col("x.vec").alias("qv"))
    return dense.batch_knn(e, first, "id", "vec", "query", "qv", 5, CLIP)


@query("prefilter_topk", _KNN.format(where="and e.label in (1, 2, 3)") + " select query, vec_id, similarity, rank from r where rank <= 10")
def prefilter_topk(s: SparkSession, d: str) -> DataFrame:
    _, q = _knn(s, d)
    return dense.batch_knn(table(s, d, "embeddings").where("label in (1, 2, 3)"), q, "vec_id", "embedding", "query", "qv", 10, CLIP)


@query("search_similar", _KNN.format(where="and q.vec_id <> e.vec_id") + " select query, vec_id, similarity, rank from r where rank <= 8")
def search_similar(s: SparkSession, d: str) -> DataFrame:
    found = dense.batch_knn(*_knn(s, d), "vec_id", "embedding", "query", "qv", 9, CLIP).where("query <> vec_id")
    w = Window.partitionBy("query").orderBy(F.col("similarity").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where("rank <= 8")


@query("ann_ivf")
def ann_ivf(s: SparkSession, d: str) -> DataFrame:
    e, q = _knn(s, d)
    index = stored(s, d, "ivf", "embeddings", lambda: dense.ivf_build(e, "vec_id", "embedding", CLIP))
    return dense.ivf_search(index, q, "query", "qv", 10, CLIP)


@query("ann_lsh")
def ann_lsh(s: SparkSession, d: str) -> DataFrame:
    return dense.lsh_knn(*_knn(s, d), "vec_id", "embedding", "query", "qv", 10, CLIP)


@query("ann_recall")
def ann_recall(s: SparkSession, d: str) -> DataFrame:
    exact = exact_knn(s, d)
    one = lambda name, found: dense.recall(found, exact, "query", "vec_id").select(F.lit(name).alias("method"), "recall", "score_ratio")
    return one("ivf", ann_ivf(s, d)).unionAll(one("lsh", ann_lsh(s, d)))


@query("mean_embedding", "with x as (select label, generate_subscripts(embedding, 1) p, unnest(embedding)::double x from embeddings), m as (select label, p, avg(x) x from x group by label, p) select label, round(sum(p * x), 6) as fingerprint from m group by label")
def mean_embedding(s: SparkSession, d: str) -> DataFrame:
    return V.mean_vector(table(s, d, "embeddings"), "embedding", "label").select("label", V.fingerprint(F.col("mean")).alias("fingerprint"))


@query("embedding_lookup", "select doc_id, vec_id is not null as found, round(list_sum(list_transform(embedding::double[], lambda x, i: x * i)), 6) as fingerprint from documents left join embeddings on doc_id = vec_id")
def embedding_lookup(s: SparkSession, d: str) -> DataFrame:
    j = table(s, d, "documents").select("doc_id").join(table(s, d, "embeddings"), F.col("doc_id") == F.col("vec_id"), "left")
    return j.select("doc_id", F.col("vec_id").isNotNull().alias("found"), V.fingerprint(F.col("embedding")).alias("fingerprint"))


_BLEND = f"""with {K} select id, round(list_sum(list_transform(u, lambda x, i: x * i)), 6) as fingerprint from (
select id, list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))) u from (select id, list_transform(list_zip(sig, clip), lambda z: {{a}} * z[1] + {{b}} * z[2]) m from (select id, sig, clip[1:48] clip from k where {ok('clip', 64)} and {ok('sig', 48)})) where list_inner_product(m, m) > 0)"""


@query("multimodal_blend", _BLEND.format(a=0.5, b=0.5))
def multimodal_blend(s: SparkSession, d: str) -> DataFrame:
    both = frames(s, d, "clip_embedding", "siglip_embedding").where(V.usable(F.col("clip_embedding"), CLIP) & V.usable(F.col("siglip_embedding"), SIGLIP))
    u = both.select("id", dialogue.multimodal(F.col("siglip_embedding"), F.slice("clip_embedding", 1, SIGLIP)).alias("u"))
    return u.where(V.norm(F.col("u")) > 0.5).select("id", V.fingerprint(F.col("u")).alias("fingerprint"))


@query("prompt_ensemble", """with e as (select vec_id g, embedding::double[] v from embeddings), u as (select g // 3 g, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) v from e),
x as (select g, generate_subscripts(v, 1) p, unnest(v) x from u), m as (select g, p, avg(x) x from x group by g, p), n as (select g, sqrt(sum(x * x)) n from m group by g)
select g as query, round(sum(p * x) / any_value(n), 6) as fingerprint from m join n using (g) group by g""")
def prompt_ensemble(s: SparkSession, d: str) -> DataFrame:
    u = table(s, d, "embeddings").select(F.expr("vec_id div 3").alias("query"), V.l2_normalize(F.col("embedding")).alias("u"))
    return V.mean_vector(u, "u", "query").select("query", V.fingerprint(V.l2_normalize(F.col("mean"))).alias("fingerprint"))


@query("rocchio", """with e as (select vec_id, label, embedding::double[] v from embeddings), x as (select vec_id, label, generate_subscripts(v, 1) p, unnest(v) x from e),
pos as (select label, p, avg(x) x from x where vec_id % 2 = 0 group by label, p), neg as (select label, p, avg(x) x from x where vec_id % 5 = 1 group by label, p),
q as (select label, min(vec_id) vec_id from e group by label), m as (select q.label, x.p, x.x + coalesce(0.75 * pos.x, 0) - coalesce(0.15 * neg.x, 0) m from q join x using (vec_id) left join pos on pos.label = q.label and pos.p = x.p left join neg on neg.label = q.label and neg.p = x.p)
select label, round(sum(p * m) / sqrt(sum(m * m)), 6) as fingerprint from m group by label""")
def rocchio(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    q = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"))
    pos = V.mean_vector(e.where("vec_id % 2 = 0"), "embedding", "label").withColumnRenamed("mean", "pos")
    neg = V.mean_vector(e.where("vec_id % 5 = 1"), "embedding", "label").withColumnRenamed("mean", "neg")
    return q.join(pos, "label", "left").join(neg, "label", "left").select("label", V.fingerprint(dialogue.rocchio(F.col("q"), F.col("pos"), F.col("neg"))).alias("fingerprint"))


_TEXT = "array_to_string(list_filter([array_to_string(list_filter(objects, lambda x: x is not null), ' '), ocr_text, asr_text, llm_caption], lambda x: x is not null and x <> ''), chr(10))"


@query("searchable_text", f"with {K} select id, {_TEXT} as text from k")
def searchable_text(s: SparkSession, d: str) -> DataFrame:
    return _searchable(s, d)


def _searchable(s: SparkSession, d: str) -> DataFrame:
    k = frames(s, d, "objects", "ocr_text", "asr_text", "llm_caption")
    return k.select("id", T.searchable_text(F.col("objects"), F.col("ocr_text"), F.col("asr_text"), F.col("llm_caption")).alias("text"))


def _asked(s: SparkSession, d: str, every: int = 50) -> DataFrame:
    return labels(s, d).where(f"label_id % {every} = 0 and query is not null").select("label_id", "query", "video_id")


_BM25 = f"""{K}, {L}, t as (select id, case when len(w) = 0 then ['∅'] else w end w from (select id, regexp_extract_all(lower({_TEXT}), '[\\p{{L}}\\p{{N}}_]+') w from k)),
x as (select id, len(w) len, unnest(w) tok from t), post as (select id, tok, len, count(*) tf from x group by id, tok, len), n as (select count(*) n, avg(len(w)) avgdl from t),
raw as (select tok, count(*) df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) raw from post, n group by tok),
idf as (select tok, df, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end idf from raw),
q as (select label_id, tok, count(*) qn from (select label_id, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+')) tok from l where label_id % 50 = 0 and query is not null) group by label_id, tok),
bm as (select label_id, id, sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))) score from q join idf using (tok) join post using (tok), n group by label_id, id having score > 0)"""


@query("tokenize", f"with {K}, w as (select unnest(regexp_extract_all(lower(llm_caption), '[\\p{{L}}\\p{{N}}_]+')) tok from k) select tok, count(*) as n from w group by tok")
def tokenize(s: SparkSession, d: str) -> DataFrame:
    return frames(s, d, "llm_caption").select(F.explode(T.tokenize(F.col("llm_caption"))).alias("tok")).groupBy("tok").agg(F.count("*").alias("n"))


@query("bm25_stats", f"with {_BM25} select tok, df, round(idf, 6) as idf from idf")
def bm25_stats(s: SparkSession, d: str) -> DataFrame:
    return _index(s, d).stats.select("tok", "df", F.round("idf", 6).alias("idf"))


def _index(s: SparkSession, d: str) -> bm25.Index:
    return stored(s, d, "bm25", "keyframes", lambda: bm25.build(_searchable(s, d), "id", "text"))


def _bm25(s: SparkSession, d: str, among: DataFrame | None = None, every: int = 50) -> DataFrame:
    return bm25.score(_index(s, d), _asked(s, d, every), "label_id", "query", among)


_RANKED = "row_number() over (partition by label_id order by round(score, 6) desc, id) rank"


@query("bm25_topk", f"with {_BM25}, r as (select label_id, id, round(score, 6) score, {_RANKED} from bm) select label_id, id, score, rank from r where rank <= 10")
def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    return bm25.top_k(_bm25(s, d), "label_id", "score", "id", 10).withColumn("score", F.round("score", 6))


@query("bm25_filtered", f"with {_BM25}, r as (select label_id, id, round(score, 6) score, {_RANKED} from bm join l using (label_id) join k using (id) where k.video_id = l.video_id) select label_id, id, score, rank from r where rank <= 10")
def bm25_filtered(s: SparkSession, d: str) -> DataFrame:
    """Only frames of the label's video are ranked; the statistics stay those of all frames."""
    own = _asked(s, d).select("label_id", "video_id").join(frames(s, d, "video_id"), "video_id").select("label_id", "id")
    return bm25.top_k(_bm25(s, d, own), "label_id", "score", "id", 10).withColumn("score", F.round("score", 6))


_FUSED = """{lists}, fused as (select label_id, id, sum(s) score, min({'l': lst, 'r': rank}) f, string_agg(name || ':' || rank, ',' order by lst) sources from lists group by label_id, id),
o as (select *, row_number() over (partition by label_id order by round(score, 9) desc, f.l, f.r, id) rank from fused)"""
_SEEDS = f"""seed as (select label_id, arg_min(id, id) id0 from l join k using (video_id) where label_id % 50 = 0 and query is not null and {ok('clip', 64)} group by label_id)"""


def _dense_sql(col: str, dim: int, name: str) -> str:
    return f"""{name} as (select label_id, id, row_number() over (partition by label_id order by sim desc, id) rank from (select s.label_id, e.id, round(list_cosine_similarity(q.{col}, e.{col}), 6) sim from seed s join k q on q.id = s.id0, k e where {ok('q.' + col, dim)} and {ok('e.' + col, dim)}))"""


_HYBRID = f"with {_BM25}, {_SEEDS}, {_dense_sql('clip', 64, 'dc')}, {_dense_sql('sig', 48, 'ds')}, sparse as (select label_id, id, {_RANKED} from bm), " + _FUSED


def _lists(depth: int, sparse: float | None) -> str:
    parts = [(0, "clip", "dc", 1.0), (1, "siglip", "ds", 1.0)] + ([(2, "bm25", "sparse", sparse)] if sparse else [])
    return "lists as (" + " union all ".join(f"select label_id, id, rank, {n} lst, '{name}' as name, {w} / (60 + rank) s from {t} where rank <= {depth}" for n, name, t, w in parts) + ")"


_OUT = " select label_id, id, round(score, 6) as score, sources, rank from o where rank <= 10"


def _dense_lists(s: SparkSession, d: str, depth: int, every: int = 50) -> dict[str, DataFrame]:
    """Each label's first frame of its video, by id, stands for the encoded query."""
    seeds = _asked(s, d, every).select("label_id", "video_id").join(_vectors(s, d, "clip_embedding", CLIP), "video_id").groupBy("label_id").agg(F.min("id").alias("id"))
    out = {}
    for name, col, dim in (("clip", "clip_embedding", CLIP), ("siglip", "siglip_embedding", SIGLIP)):
        v = _vectors(s, d, col, dim)
        q = cut(v.join(seeds, "id").select("label_id", F.col("vec").alias("qv")))  # a row per label asked; read twice
        out[name] = dense.batch_knn(v, q, "id", "vec", "label_id", "qv", depth, dim)
    return out


def _vectors(s: SparkSession, d: str, column: str, dim: int) -> DataFrame:
    """`id`, `video_id`, `vec` of the frames with a usable vector, stored once."""
    return stored(s, d, column, "keyframes", lambda: cut(clips(s, d, column, dim).select("id", "video_id", "vec")))


def _hybrid(s: SparkSession, d: str, depth: int, weight: float | None, every: int = 50) -> DataFrame:
    lists = _dense_lists(s, d, depth, every)
    if weight:
        lists["bm25"] = bm25.top_k(_bm25(s, d, every=every), "label_id", "score", "id", depth)
    fused = fusion.rrf(lists, "label_id", "id", weights={"bm25": weight or 0}, depth=depth)
    return fused.where("rank <= 10").select("label_id", "id", F.round("score", 6).alias("score"), "sources", "rank")


@query("hybrid_search", _HYBRID.replace("{lists}", _lists(1000, 1.0)) + _OUT)
def hybrid_search(s: SparkSession, d: str) -> DataFrame:
    return _hybrid(s, d, 1000, 1.0)


def flagship(s: SparkSession, d: str) -> DataFrame:
    """hybrid_search for every label."""
    return _hybrid(s, d, 1000, 1.0, 1)


@query("hybrid_search_depth", _HYBRID.replace("{lists}", _lists(20, 3.0)) + _OUT)
def hybrid_search_depth(s: SparkSession, d: str) -> DataFrame:
    return _hybrid(s, d, 20, 3.0)


@query("dense_ensemble", _HYBRID.replace("{lists}", _lists(1000, None)) + _OUT)
def dense_ensemble(s: SparkSession, d: str) -> DataFrame:
    return _hybrid(s, d, 1000, None)


@query("rrf_fusion", f"""with {C}, n as (select *, case search_id % 2 when 0 then 'a' else 'b' end src from c where video_id is not null and score is not null and not isnan(score)),
r as (select video_id q, keyframe_id id, src, row_number() over (partition by video_id, src order by score desc, cand_id) rank from n where keyframe_id is not null),
lists as (select q, id, src, min(rank) rank from r group by q, id, src), f as (select q, id, sum(case src when 'a' then 1.0 else 5.0 end / (60 + rank)) score, string_agg(src || ':' || rank, ',' order by src) sources from lists group by q, id)
select q as video_id, id, round(score, 6) as score, sources from f""")
def rrf_fusion(s: SparkSession, d: str) -> DataFrame:
    c = candidates(s, d).where("video_id is not null and keyframe_id is not null and score is not null and not isnan(score)").withColumn("src", F.when(F.col("search_id") % 2 == 0, "a").otherwise("b"))
    w = Window.partitionBy("video_id", "src").orderBy(F.col("score").desc(), "cand_id")
    r = c.withColumn("rank", F.row_number().over(w)).groupBy("video_id", F.col("keyframe_id").alias("id"), "src").agg(F.min("rank").alias("rank"))
    fused = fusion.rrf({n: r.where(F.col("src") == n) for n in ("a", "b")}, "video_id", "id", weights={"b": 5.0}, depth=None)
    return fused.select("video_id", "id", F.round("score", 6).alias("score"), "sources")


@query("source_rank_fusion", """with u as (select cand_id, unnest(map_entries(m)) e from (select cand_id, any_value(source_ranks) m from candidates where cand_id is not null group by cand_id))
select cand_id, round(sum(1.0 / (60 + e.value)), 6) as score, count(*) as sources from u group by cand_id""")
def source_rank_fusion(s: SparkSession, d: str) -> DataFrame:
    m = candidates(s, d).select("cand_id", F.map_values("source_ranks").alias("r")).where("size(r) > 0")
    return m.select("cand_id", F.round(F.aggregate("r", F.lit(0.0), lambda t, x: t + F.lit(1.0) / (60 + x)), 6).alias("score"), F.size("r").cast("bigint").alias("sources"))


@query("adaptive_weight", f"with {L} select label_id, case when len(list_filter(regexp_extract_all(query, '[A-Za-z][A-Za-z\\-]+'), lambda w: w = upper(w))) > 0 then 3.0 else 1.0 end::double as weight from l where query is not null")
def adaptive_weight(s: SparkSession, d: str) -> DataFrame:
    return labels(s, d).where("query is not null").select("label_id", T.adaptive_weight(F.col("query")).alias("weight"))


_OVERLAP = "with {K}, {L}, p as (select label_id, id, list_distinct(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+')) q, regexp_extract_all(lower(coalesce(llm_caption, '')), '[\\p{{L}}\\p{{N}}_]+') c from l join k using (video_id) where query is not null and ts >= w[1] and ts < w[2])"


@query("rerank_overlap", _OVERLAP.format(K=K, L=L) + " select label_id, id, round(case when len(q) = 0 then 0.0 else len(list_intersect(q, c)) / len(q) end, 6)::double as score from p")
def rerank_overlap(s: SparkSession, d: str) -> DataFrame:
    from framesift.operators.temporal import relevant

    pairs = relevant(frames(s, d, "video_id", "timestamp"), labels(s, d)).join(labels(s, d).where("query is not null").select("label_id", "query"), "label_id").join(frames(s, d, "llm_caption"), "id")
    return pairs.select("label_id", "id", F.round(T.token_overlap(F.col("query"), F.coalesce("llm_caption", F.lit(""))), 6).alias("score"))


@query("kisc_retrieve", f"""with {_BM25}, tagged as (select id from k where list_has_all(objects, ['Person'])), hits as (select label_id, id, round(score, 6) score from bm join tagged using (id)),
unmet as (select label_id from l where label_id % 50 = 0 and query is not null and label_id not in (select label_id from hits)), few as (select id from tagged order by id limit 20),
pool as (select * from hits union all select label_id, id, 1.0::double from unmet, few), r as (select label_id, id, score, row_number() over (partition by label_id order by score desc, id) rank from pool) select label_id, id, score, rank from r where rank <= 20""")
def kisc_retrieve(s: SparkSession, d: str) -> DataFrame:
    """Text ranking among the frames that have all the tags, with statistics of all frames; for a label whose text meets none of these, the first
    of them by id with the number of tags as score."""
    tags = ["Person"]
    tagged = filters.apply(frames(s, d, "objects"), objects_all=tags).select("id")
    found = _bm25(s, d).join(tagged, "id", "left_semi").select("label_id", "id", F.round("score", 6).alias("score"))
    best = bm25.top_k(found, "label_id", "score", "id", 20)
    first = tagged.orderBy("id").limit(20).groupBy().agg(F.array_sort(F.collect_list("id")).alias("ids"))  # twenty ids
    none = _asked(s, d).select("label_id").join(found.select("label_id"), "label_id", "left_anti").withColumn("one", F.lit(1))
    rest = none.join(F.broadcast(first.withColumn("one", F.lit(1))), "one").select("label_id", F.posexplode("ids").alias("n", "id"))
    return best.unionByName(rest.select("label_id", "id", F.lit(float(len(tags))).alias("score"), (F.col("n") + 1).alias("rank")))
