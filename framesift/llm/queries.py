"""The queries of this subpackage. QUERIES: name -> (spark, folder) -> DataFrame; SQL: what DuckDB can check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.llm import bpe, group_topn, leaks, neighbors, residue, runs, term_freq, text_form
from framesift.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return text_form.find_same_reading(table(spark, d, "keyframes"), table(spark, d, "moment_labels"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "keyframes")
    found = [neighbors.similar_pairs(k, "id", f"{e}_embedding", 5, 0.9, dim=n).select(F.lit(e).alias("encoder"), "id_a", "id_b") for e, n in (("clip", 64), ("siglip", 48))]
    return found[0].unionAll(found[1])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    texts = ("ocr_text", "asr_text", "llm_caption")
    records = term_freq.distinct_records(table(spark, d, "keyframes"), "id", "objects", *texts)
    counts = term_freq.term_counts(records, {"objects": term_freq.list_terms} | dict.fromkeys(texts, term_freq.text_terms))
    return term_freq.mark_terms(counts).where("mark is not null").select("field", "term", "mark")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidates").select("video_id", "score", "cand_id")
    return group_topn.top_n(c, "video_id", "score", "cand_id", 5).select("video_id", "cand_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    events = runs.collapse(table(spark, d, "keyframes"), "video_id", "id", "timestamp", "cluster_span")
    return events.where("has_span and n >= 2").select("video_id", "first_id", "last_id")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_documents(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_records(table(spark, d, "documents")).select("doc_id")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p6_ids": p6_ids, "p7_found": p7_found, "p8_found": p8_found, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found}


def _exact(encoder: str, dim: int) -> str:
    """All pairs, for the small tables that the SQL check uses."""
    v = f"{encoder}_embedding"
    usable = f"{v} is not null and len({v}) = {dim} and not list_bool_or(list_transform({v}, lambda x: isnan(x))) and list_bool_or(list_transform({v}, lambda x: x <> 0))"
    return f"""select '{encoder}' as encoder, least(a, b) as id_a, greatest(a, b) as id_b from (select a, b, s, row_number() over (partition by a order by s desc, b) r from (
select x.id a, y.id b, round(list_cosine_similarity(x.v, y.v), 9) s from (select id, any_value({v})::double[] v from keyframes where id is not null and {usable} group by id) x,
(select id, any_value({v})::double[] v from keyframes where id is not null and {usable} group by id) y where x.id <> y.id)) where r <= 5 and s >= 0.9"""


SQL = {
    "p2_found": f"select distinct * from ({_exact('clip', 64)} union all {_exact('siglip', 48)})",
    "p3_found": """
with k as (select id, any_value(objects) objects, any_value(ocr_text) ocr_text, any_value(asr_text) asr_text, any_value(llm_caption) llm_caption from keyframes where id is not null group by id),
x as (select 'ocr_text' f, id, ocr_text s from k union all select 'asr_text', id, asr_text from k union all select 'llm_caption', id, llm_caption from k),
w as (select f, id, unnest(list_transform(string_split(lower(s), ' '), lambda y: trim(y, '.,;:!?"''()[]'))) t from x where s is not null
      union all select 'objects', id, unnest(objects) from k where objects is not null),
n as (select f, count(*) n from x where s is not null group by f union all select 'objects', count(*) from k where objects is not null),
c as (select f, t, count(*) o, count(distinct id) r from w where t <> '' group by f, t)
select f as field, t as term, case when r > 0.1 * n then 'common' else 'rare' end as mark from c join n using (f) where r > 0.1 * n or o < 3""",
    "p4_found": """
select video_id, cand_id from (
  select video_id, cand_id, row_number() over (partition by video_id order by score desc, cand_id) r
  from (select distinct video_id, cand_id, score from candidates where video_id is not null and score is not null and not isnan(score))) where r <= 5""",
    "p5_found": """
with f as (select id, any_value(video_id) v, any_value("timestamp") ts, any_value(cluster_span.t_start) a, any_value(cluster_span.t_end) b from keyframes where "timestamp" is not null and video_id is not null group by id),
g as (select *, coalesce(abs(a - lag(a) over w) <= 0.1 + 1e-9 and abs(b - lag(b) over w) <= 0.1 + 1e-9, false) same from f window w as (partition by v order by ts, id)),
h as (select *, sum(case when same then 0 else 1 end) over (partition by v order by ts, id) run from g)
select v as video_id, min_by(id, (ts, id)) as first_id, max_by(id, (ts, id)) as last_id from h group by v, run having count(*) >= 2""",
}
