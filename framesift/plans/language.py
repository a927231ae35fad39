"""Queries of text: query understanding, answers, dialogue and question answering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framesift.functions import location as L_
from framesift.functions import text as T
from framesift.operators import dialogue, sessions, temporal, tools
from framesift.operators import metrics as M
from framesift.plans.base import CLIP, C, K, L, candidates, clips, frames, labels, ok, query
from framesift.session import table

# Questions that show each rule, beside those of the labels.
CASES = [
    "Có bao nhiêu người ở quán cà phê?", "Tìm tất cả các cảnh có xe màu đỏ", "giống đoạn video mẫu này", "Người đàn ông cởi mũ trước khi vào nhà",
    "Cô ấy tưới hoa sau khi anh ấy mặc áo sơ mi xanh dương", "Ai là người cầm bánh sinh nhật?", "she is walking in the park last week", "hai tuần trước tôi ngồi ở công viên",
    "trước khi đi", "trong video có ai ở công viên có hồ không?", "Tại Nhà Hàng Biển tuần trước, hai người ăn", "NASA logo on a red car", "8/10", "score 7.5 because", "no number", '{"k": 4} tail', 'see {"a": {"b": 2}} end', "",
]
_VALUES = "(values " + ", ".join(f"({-i}, '{c}')" for i, c in enumerate(CASES, 1)) + ") v(label_id, query)"
_Q = f"{L}, q as (select label_id, query from l where query is not null union all select label_id, query from {_VALUES}), t as (select *, lower(query) low from q)"


def _queries(s: SparkSession, d: str) -> DataFrame:
    cases = s.createDataFrame([(-i, c) for i, c in enumerate(CASES, 1)], "label_id bigint, query string")
    return labels(s, d).where("query is not null").select("label_id", "query").unionAll(cases)


def _any(words: list[str]) -> str:
    return "(" + " or ".join(f"contains(low, '{w}')" for w in words) + ")"


@query("query_type", f"with {_Q} select label_id, case when {_any(T.COUNT_MARKS)} then 'VQA' when {_any(T.ALL_MARKS)} then 'AVS' when contains(low, 'video mẫu') then 'KIS_video' else 'KIS_textual' end as kind from t")
def query_type(s: SparkSession, d: str) -> DataFrame:
    return _queries(s, d).select("label_id", T.query_type(F.col("query")).alias("kind"))


@query("vqa_intent", f"with {_Q} select label_id, case when {_any(T.COUNT_MARKS)} then 'count' when ltrim(low) like 'ai %' or ltrim(low) like 'ai?%' or contains(low, 'người nào') then 'identify' else 'describe' end as intent from t")
def vqa_intent(s: SparkSession, d: str) -> DataFrame:
    return _queries(s, d).select("label_id", T.intent(F.col("query")).alias("intent"))


def _clean(x: str) -> str:
    x = f"trim({x}, ' ,.;')"
    for w in T.SUBJECTS:
        x = f"regexp_replace({x}, '^{w}', '')"
    return f"trim({x})"


@query("temporal_parse", f"""with {_Q}, p as (select label_id, case when contains(low, 'trước khi') then 1 else 2 end kind, case when contains(low, 'trước khi') then instr(low, 'trước khi') else instr(low, 'sau khi') end pos, low from t where contains(low, 'trước khi') or contains(low, 'sau khi')),
e as (select label_id, kind, {_clean('substr(low, 1, pos - 1)')} a, {_clean("substr(low, pos + case kind when 1 then 9 else 7 end)")} b from p)
select label_id, case kind when 1 then a else b end as first_event, case kind when 1 then b else a end as second_event from e where a <> '' and b <> ''""")
def temporal_parse(s: SparkSession, d: str) -> DataFrame:
    e = _queries(s, d).select("label_id", T.temporal_order(F.col("query")).alias("e")).where("e is not null")
    return e.select("label_id", F.col("e")[0].alias("first_event"), F.col("e")[1].alias("second_event"))


def _scan(words: list[str]) -> str:
    order = sorted(words, key=lambda p: (-len(p), p))
    return "array_to_string(list_reduce([" + ", ".join(f"case when contains(low, '{w}') then ['{w}'] else []::varchar[] end" for w in order) + "], lambda a, b: case when len(b) = 0 or len(list_filter(a, lambda x: contains(x, b[1]))) > 0 then a else a || b end, []::varchar[]), ',')"


@query("lexicon_scan", f"with {_Q} select label_id, {_scan(T.OBJECTS)} as objects, {_scan(T.ACTIONS)} as actions, {_scan(T.COLORS)} as colors, {_scan(T.TIMES)} as times from t")
def lexicon_scan(s: SparkSession, d: str) -> DataFrame:
    scan = lambda name, words: F.array_join(T.lexicon_scan(F.col("query"), words), ",").alias(name)
    return _queries(s, d).select("label_id", scan("objects", T.OBJECTS), scan("actions", T.ACTIONS), scan("colors", T.COLORS), scan("times", T.TIMES))


def _place(mark: str, n: int) -> str:
    """SQL: the place after one mark, or null."""
    clause = f"trim(regexp_extract(substr(query, instr(low, '{mark}') + {len(mark)}), '(?s)^(.*?)(?:{L_.ENDS}|$)', 1))"
    longest = sorted(T.TIMES, key=len, reverse=True)
    short = "case " + " ".join(f"when contains(lower(c), '{t}') then trim(split_part(lower(c), '{t}', 1))" for t in longest) + " else lower(c) end"
    asks = " and ".join(f"not contains(p, '{q}')" for q in L_.QUESTION)
    return f"m{n} as (select label_id, trim(substr(c, 1, length(p))) l{n} from (select label_id, c, {short} p from (select label_id, {clause} c from t where contains(low, '{mark}'))) where p <> '' and p not in {tuple(L_.NOT_A_PLACE)} and {asks} and len(regexp_split_to_array(p, '\\s+')) <= {L_.WORDS})"


_KIND = f"case when {_any(T.COUNT_MARKS)} then 'VQA' when {_any(T.ALL_MARKS)} then 'AVS' when contains(low, 'video mẫu') then 'KIS_video' else 'KIS_textual' end"
_EVENTS_OF = f"""ev as (select label_id, case kind when 1 then a || ' > ' || b else b || ' > ' || a end events from (select label_id, kind, {_clean('substr(low, 1, pos - 1)')} a, {_clean("substr(low, pos + case kind when 1 then 9 else 7 end)")} b from
(select label_id, low, case when contains(low, 'trước khi') then 1 else 2 end kind, case when contains(low, 'trước khi') then instr(low, 'trước khi') else instr(low, 'sau khi') end pos from t where contains(low, 'trước khi') or contains(low, 'sau khi'))) where a <> '' and b <> '')"""


@query("understand", f"with {_Q}, {_EVENTS_OF}, {', '.join(_place(m, n) for n, m in enumerate(L_.MARKS))} select t.label_id, {_KIND} as kind, coalesce({', '.join(f'l{n}' for n in range(len(L_.MARKS)))}) as location, nullif(string_split({_scan(T.TIMES)}, ',')[1], '') as time, events, {_scan(T.OBJECTS)} as objects, {_scan(T.ACTIONS)} as actions, {_scan(T.COLORS)} as colors from t left join ev using (label_id) {' '.join(f'left join m{n} using (label_id)' for n in range(len(L_.MARKS)))}")
def understand(s: SparkSession, d: str) -> DataFrame:
    """The whole structured query: type, location, lexicon hits and order."""
    q = _queries(s, d)
    hits = {n: F.array_join(T.lexicon_scan(F.col("query"), w), ",") for n, w in (("objects", T.OBJECTS), ("actions", T.ACTIONS), ("colors", T.COLORS))}
    return q.select("label_id", T.query_type(F.col("query")).alias("kind"), L_.location(F.col("query")).alias("location"), F.get(T.lexicon_scan(F.col("query"), T.TIMES), F.lit(0)).alias("time"), F.array_join(T.temporal_order(F.col("query")), " > ").alias("events"), *(c.alias(n) for n, c in hits.items()))


def _slot(a: str) -> str:
    return "case " + " ".join(f"when contains(' ' || low || ' ', '{k}') then '{v}'" for k, v in dict(T.SLOTS)[a]) + f" end as {a}"


@query("slot_extract", f"with {_Q} select label_id, {', '.join(_slot(a) for a, _ in T.SLOTS)} from t")
def slot_extract(s: SparkSession, d: str) -> DataFrame:
    return _queries(s, d).select("label_id", *(T.slot(F.col("query"), a).alias(a) for a, _ in T.SLOTS))


_SWAPS = ", ".join(f"case when contains(low, '{a}') then replace(low, '{a}', '{b}') end" for a, b in T.SYNONYMS)
_MORE = ", ".join(f"'{r}' || query" for r in T.REPHRASINGS)


@query("query_expand", f"with {_Q}, e as (select label_id, generate_subscripts(v, 1) i, unnest(v) v from (select label_id, [query] || list_filter([{_SWAPS}], lambda x: x is not null and x <> low) || [{_MORE}] v from t)), u as (select label_id, v, min(i) i from e group by label_id, v), r as (select *, row_number() over (partition by label_id order by i) n from u) select label_id, n, v as variant from r where n <= 4")
def query_expand(s: SparkSession, d: str) -> DataFrame:
    e = _queries(s, d).select("label_id", F.posexplode(T.expand(F.col("query"), 4)).alias("n", "variant"))
    return e.select("label_id", (F.col("n") + 1).cast("bigint").alias("n"), "variant")


@query("parse_score", f"with {_Q}, x as (select label_id, regexp_extract(query, '(\\d+(?:\\.\\d+)?)', 1) n from t) select label_id, case when n = '' then 0.0 else least(1.0, n::double / 10) end::double as score from x")
def parse_score(s: SparkSession, d: str) -> DataFrame:
    return _queries(s, d).select("label_id", T.parse_score(F.col("query")).alias("score"))


@query("json_extract", "select event_id, (props::json->>'k')::bigint as k from events")
def json_extract(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("event_id", F.concat(F.lit("answer: "), "props", F.lit(" .")).alias("answer"))
    return e.select("event_id", F.get_json_object(T.json_part(F.col("answer")), "$.k").cast("bigint").alias("k"))


_ORDERED = f"""o as (select label_id, true ordered from (select label_id, {_clean('substr(low, 1, pos - 1)')} a, {_clean("substr(low, pos + len)")} b from (select label_id, low, case when contains(low, 'trước khi') then 9 else 7 end len,
case when contains(low, 'trước khi') then instr(low, 'trước khi') else instr(low, 'sau khi') end pos from t where contains(low, 'trước khi') or contains(low, 'sau khi'))) where a <> '' and b <> '')"""


@query("route_query", f"with {_Q}, {_ORDERED} select t.label_id, case when ordered then 'search_temporal' when t.label_id % 3 = 0 and trim(query) <> '' then 'search_multimodal' when t.label_id % 3 = 0 then 'search_by_image' when t.label_id % 2 = 0 then 'search_with_feedback' else 'search' end as route from t left join o using (label_id)")
def route_query(s: SparkSession, d: str) -> DataFrame:
    """Where each text goes, as if every third came with an image and every second in a session with feedback."""
    return _queries(s, d).select("label_id", tools.route_column(F.col("query"), F.col("label_id") % 3 == 0, F.col("label_id") % 2 == 0).alias("route"))


_NORM = "trim(regexp_replace(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("normalize_answer", f"with {K} select id, {_NORM.format(x='llm_caption')} as answer from k where llm_caption is not null")
def normalize_answer(s: SparkSession, d: str) -> DataFrame:
    return frames(s, d, "llm_caption").where("llm_caption is not null").select("id", T.normalize_answer(F.col("llm_caption")).alias("answer"))


_AB = f"with {K}, {L}, p as (select label_id, id, {_NORM.format(x='query')} a, {_NORM.format(x='llm_caption')} b from l join k using (video_id) where query is not null and llm_caption is not null and ts >= w[1] and ts < w[2])"


def _answers(s: SparkSession, d: str) -> DataFrame:
    from framesift.operators.temporal import relevant

    pairs = relevant(frames(s, d, "video_id", "timestamp"), labels(s, d))
    return pairs.join(labels(s, d).where("query is not null").select("label_id", "query"), "label_id").join(frames(s, d, "llm_caption").where("llm_caption is not null"), "id")


@query("exact_match", _AB + " select label_id, id, (a = b)::int as em from p")
def exact_match(s: SparkSession, d: str) -> DataFrame:
    return _answers(s, d).select("label_id", "id", M.exact_match(F.col("query"), F.col("llm_caption")).alias("em"))


@query("token_f1", _AB + """, x as (select label_id, id, list_filter(string_split(a, ' '), lambda x: x <> '') a, list_filter(string_split(b, ' '), lambda x: x <> '') b from p),
wa as (select label_id, id, w, count(*) n from (select label_id, id, unnest(a) w from x) group by label_id, id, w), wb as (select label_id, id, w, count(*) n from (select label_id, id, unnest(b) w from x) group by label_id, id, w),
o as (select label_id, id, sum(least(wa.n, wb.n)) o from wa join wb using (label_id, id, w) group by label_id, id)
select label_id, id, round(case when len(a) = 0 or len(b) = 0 then (len(a) = len(b))::int else coalesce(2 * o / (len(a) + len(b)), 0) end, 6)::double as f1 from x left join o using (label_id, id)""")
def token_f1(s: SparkSession, d: str) -> DataFrame:
    return _answers(s, d).select("label_id", "id", F.round(M.token_f1(F.col("query"), F.col("llm_caption")), 6).alias("f1"))


@query("mock_caption", f"with {K} select id, case when len(objects) > 0 then 'Cảnh có ' || array_to_string(list_filter(objects, lambda x: x is not null), ', ') || ' tại video ' || video_id || ' (mô tả mock).' else 'Cảnh trong video ' || video_id || ' lúc ' || round_even(ts, 0)::bigint || 's (mô tả mock).' end as caption from k where ts is not null and video_id is not null")
def mock_caption(s: SparkSession, d: str) -> DataFrame:
    f = frames(s, d, "video_id", "timestamp", "objects").where("timestamp is not null and video_id is not null")
    return f.select("id", T.mock_caption(F.col("objects"), F.col("video_id"), F.col("timestamp")).alias("caption"))


@query("canned_lookup", f"with {K}, {C} select cand_id, k.ocr_text as ocr, k.asr_text as asr from c left join k on k.id = c.keyframe_id")
def canned_lookup(s: SparkSession, d: str) -> DataFrame:
    return candidates(s, d).select("cand_id", "keyframe_id").join(frames(s, d, "ocr_text", "asr_text"), F.col("keyframe_id") == F.col("id"), "left").select("cand_id", F.col("ocr_text").alias("ocr"), F.col("asr_text").alias("asr"))


@query("attr_tag_roundtrip", "select event_id, event_type as kind, props::json->>'k' as k, 'k:' || (props::json->>'k') || ',kind:' || event_type as tags from events")
def attr_tag_roundtrip(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("event_id", T.attributes_to_tags(F.create_map(F.lit("kind"), "event_type", F.lit("k"), F.get_json_object("props", "$.k"), F.lit("none"), F.lit(None).cast("string"))).alias("tags"))
    back = T.tags_to_attributes(F.col("tags"))
    return e.select("event_id", back["kind"].alias("kind"), back["k"].alias("k"), F.array_join("tags", ",").alias("tags"))


_ATTR = ["event_type", "weekday", "k"]
_EVENTS = "e as (select event_type, isodow(ts)::varchar weekday, props::json->>'k' k from events)"
_ENTROPY = f"with {_EVENTS}, x as (select 0 ord, 'event_type' attribute, event_type v from e union all select 1, 'weekday', weekday from e union all select 2, 'k', k from e), n as (select ord, attribute, v, count(*) n from x where v is not null group by ord, attribute, v), h as (select ord, attribute, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) entropy from n group by ord, attribute)"


def _attributes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_type", (F.weekday("ts") + 1).cast("string").alias("weekday"), F.get_json_object("props", "$.k").alias("k"))


@query("attribute_entropy", _ENTROPY + " select attribute, entropy from h")
def attribute_entropy(s: SparkSession, d: str) -> DataFrame:
    return dialogue.entropy(_attributes(s, d), _ATTR).select("attribute", "entropy")


@query("best_attribute", _ENTROPY + " select attribute, entropy from h where entropy > 0 and attribute <> 'k' order by entropy desc, ord limit 1")
def best_attribute(s: SparkSession, d: str) -> DataFrame:
    return dialogue.best_attribute(dialogue.entropy(_attributes(s, d), _ATTR), asked=["k"])


_GAPS = f"with {C}, r as (select video_id, score, row_number() over (partition by video_id order by score desc) r from c where video_id is not null and score is not null and not isnan(score)), g as (select video_id, count(*) n, round(max(score) filter (r = 1) - max(score) filter (r = 2), 6) gap from r group by video_id)"


def _ranked(s: SparkSession, d: str) -> DataFrame:
    return candidates(s, d).where("video_id is not null")


@query("is_confident", _GAPS + " select video_id, n, gap, n <= 3 or coalesce(gap >= 0.15, true) as confident from g")
def is_confident(s: SparkSession, d: str) -> DataFrame:
    return dialogue.confidence(_ranked(s, d), "video_id", "score", 3, 0.15)


@query("is_ambiguous", _GAPS + " select video_id, n > 4 and gap < 0.02 as ambiguous from g")
def is_ambiguous(s: SparkSession, d: str) -> DataFrame:
    return dialogue.confidence(_ranked(s, d), "video_id", "score", 4, 0.02).select("video_id", (~F.col("confident")).alias("ambiguous"))


_TURNS = "t as (select user_id, event_id turn, event_type attribute, case when (props::json->>'k')::int % 4 = 0 then null else props::json->>'k' end v, ((props::json->>'k')::int % 7)::varchar item, case when value > 50 then 1 else -1 end label from events)"


def _turns(s: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(s, d, "events").select("user_id", F.col("event_id").alias("turn"), F.col("event_type").alias("attribute"), F.when(k.cast("int") % 4 != 0, k).alias("v"), (k.cast("int") % 7).cast("string").alias("item"), F.when(F.col("value") > 50, 1).otherwise(-1).alias("label"))


@query("dialogue_filters", f"with {_TURNS} select user_id, attribute, arg_max(v, turn) as v from t where v is not null group by user_id, attribute")
def dialogue_filters(s: SparkSession, d: str) -> DataFrame:
    return dialogue.latest_values(_turns(s, d), "user_id", "turn", "attribute", "v")


@query("feedback_latest", f"with {_TURNS} select user_id, item, arg_max(label, turn) as label from t group by user_id, item")
def feedback_latest(s: SparkSession, d: str) -> DataFrame:
    return dialogue.latest_feedback(_turns(s, d), "user_id", "turn", "item", "label")


@query("recent_turns", f"with {_TURNS}, r as (select *, row_number() over (partition by user_id order by turn desc) r from t) select user_id, turn from r where r <= 3")
def recent_turns(s: SparkSession, d: str) -> DataFrame:
    return dialogue.recent(_turns(s, d), "user_id", "turn", 3).select("user_id", "turn")


@query("filter_refine", f"with {C}, g as (select video_id, count(*) n from c where video_id is not null and score is not null and not isnan(score) group by video_id), r as (select cand_id, video_id, row_number() over (partition by video_id order by score desc, cand_id) r from c where score is not null and not isnan(score) and keyframe_id in (select id from keyframes where list_contains(objects, 'Person'))) select cand_id, r.video_id from r join g using (video_id) where r <= greatest(3, least(ceil(n * 0.5), greatest(n - 1, 1)))")
def filter_refine(s: SparkSession, d: str) -> DataFrame:
    """Of each video's pool the best that the new condition keeps, cut to the size after a refinement."""
    pool = candidates(s, d).where("video_id is not null and score is not null and not isnan(score)")
    sizes = pool.groupBy("video_id").agg(F.count("*").alias("n"))
    fit = frames(s, d, "objects").where(F.array_contains("objects", "Person")).select(F.col("id").alias("keyframe_id"))
    w = Window.partitionBy("video_id").orderBy(F.col("score").desc(), "cand_id")
    kept = pool.join(fit, "keyframe_id", "left_semi").withColumn("r", F.row_number().over(w)).join(sizes, "video_id")
    return kept.where(F.col("r") <= dialogue.shrink_size(F.col("n"))).select("cand_id", "video_id")


@query("rerank_early_stop", f"""with {C}, o as (select *, row_number() over (partition by video_id order by cand_id) n from c where video_id is not null and score is not null and not isnan(score)),
b as (select *, list_reverse_sort(list(score) over (partition by video_id order by n rows unbounded preceding)) s from o where n <= 20), f as (select *, case when n >= 5 and round(s[1] - s[2], 9) >= 0.2 then 1 else 0 end done from b),
x as (select *, coalesce(sum(done) over (partition by video_id order by n rows between unbounded preceding and 1 preceding), 0) stops from f) select video_id, cand_id, n from x where stops = 0""")
def rerank_early_stop(s: SparkSession, d: str) -> DataFrame:
    c = candidates(s, d).where("video_id is not null and score is not null and not isnan(score)")
    return dialogue.early_stop(c, "video_id", "cand_id", "score", 5, 0.2, 20).select("video_id", "cand_id", F.col("n").cast("bigint").alias("n"))


_STOP = "(" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")"
_TOK = "regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+')"


@query("suggest_concepts", f"""with {K}, {L}, p as (select label_id, row_number() over (partition by label_id order by ts, id) o, {_TOK.format(x="coalesce(query, '')")} q, {_TOK.format(x="array_to_string(list_filter([llm_caption, ocr_text, asr_text], lambda x: x is not null and x <> ''), ' ')")} t from l join k using (video_id) where ts >= w[1] and ts < w[2]),
x as (select label_id, o, q, generate_subscripts(t, 1) p, unnest(t) tok from p), n as (select label_id, tok, count(*) n, min([o, p]) f from x where length(tok) >= 3 and not list_contains(q, tok) and tok not in {_STOP} group by label_id, tok),
r as (select *, row_number() over (partition by label_id order by n desc, f) rank from n) select label_id, tok, n, rank from r where rank <= 8""")
def suggest_concepts(s: SparkSession, d: str) -> DataFrame:
    """The words that the frames in each label's window suggest beside its query."""
    texts = ("llm_caption", "ocr_text", "asr_text")
    found = temporal.relevant(frames(s, d, "video_id", "timestamp"), labels(s, d)).join(frames(s, d, "timestamp", *texts), "id")
    rows = found.withColumn("at", F.struct("timestamp", "id")).join(labels(s, d).select("label_id", "query"), "label_id")
    return dialogue.suggest_concepts(rows, "label_id", "at", "query", texts).withColumn("rank", F.col("rank").cast("bigint"))


# Questions over the captions of each video.
QUESTIONS = ["Có bao nhiêu người ở đây?", "Có mấy cây nến trên bánh?", "Đếm số lượng xe", "Ai tặng hoa?", "bao nhiêu lần?"]
_ASKED = "q as (select * from (values " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(QUESTIONS)) + f") v(question, text)), a as (select question, list_filter({_TOK.format(x='text')}, lambda w: w in {tuple(T.COUNTABLE)})[1] noun from q)"


@query("vqa_count", f"""with {K}, {_ASKED}, w as (select question, noun, video_id, {_TOK.format(x='llm_caption')} t, llm_caption, objects from k, a where video_id is not null and noun is not null),
x as (select question, noun, video_id, t, generate_subscripts(t, 1) i, unnest(t) tok from w), n as (select question, video_id, max(coalesce(try_cast(case when regexp_full_match(tok, '[0-9]+') then tok end as int), nullif(list_position({T.NUMBER_WORDS}, tok), 0))) n from x where list_contains(t[i + 1 : i + 3], noun) group by question, video_id),
c as (select question, video_id, count(*) filter (contains(lower(llm_caption), noun) or list_contains(list_transform(objects, lambda o: lower(o)), noun)) c from w group by question, video_id) select question, video_id, coalesce(n, c)::bigint as value from c left join n using (question, video_id)""")
def vqa_count(s: SparkSession, d: str) -> DataFrame:
    """For each question that names something countable: the largest number shortly before it in a video's captions, else the number of frames
    that mention it."""
    k = frames(s, d, "video_id", "llm_caption", "objects").where("video_id is not null")
    asked = F.explode(F.array(*(F.struct(F.lit(i).alias("question"), T.target_noun(F.lit(q)).alias("noun")) for i, q in enumerate(QUESTIONS))))
    k = k.select("video_id", "llm_caption", "objects", asked.alias("x")).select("*", "x.*").where("noun is not null")
    says = F.contains(F.lower("llm_caption"), F.col("noun")) | F.array_contains(F.transform("objects", lambda o: F.lower(o)), F.col("noun"))
    g = k.groupBy("question", "video_id").agg(F.max(T.number_before(F.col("llm_caption"), F.col("noun"))).alias("n"), F.count(F.when(says, 1)).alias("c"))
    return g.select("question", "video_id", F.coalesce("n", "c").cast("bigint").alias("value"))


_AUX = "|".join(T.AUXILIARIES)


@query("vqa_identify", f"""with {K}, v as (select unnest({T.SUBJECT_ACTIONS + ['đi', 'đứng']}) verb), m as (select id, verb, trim(regexp_extract(' ' || regexp_replace(llm_caption, '[\\t \\p{{Z}}]+', ' ', 'g'), '(?i)^ ([^\\n]*?)(?:^|[^\\p{{L}}\\p{{N}}_])' || verb || '(?:$|[^\\p{{L}}\\p{{N}}_])', 1)) b from k, v),
x as (select id, verb, trim(regexp_replace(b, '(?i)(^|\\s+)(({_AUX})(\\s+|$))+$', ''), ' ,.;') subject from m where b <> '') select id, verb as action, subject from x where subject <> ''""")
def vqa_identify(s: SparkSession, d: str) -> DataFrame:
    """Who does each of some actions in a caption: what stands before it, auxiliaries aside."""
    verbs = [*T.SUBJECT_ACTIONS, "đi", "đứng"]
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("action"), T.subject_of(F.col("llm_caption"), v).alias("subject")) for v in verbs)))
    return frames(s, d, "llm_caption").select("id", each.alias("x")).select("id", "x.*").where("subject is not null")


_BEST = f"with {K}, {C}, b as (select video_id, arg_max(ts, (score, -cand_id)) t from c where video_id is not null and score is not null and not isnan(score) and ts is not null group by video_id), w as (select b.video_id, k.id, k.ts, llm_caption from b join k using (video_id) where abs(k.ts - b.t) <= 8)"


def _windows(s: SparkSession, d: str) -> DataFrame:
    c = candidates(s, d).where("video_id is not null and score is not null and not isnan(score) and timestamp is not null")
    best = c.groupBy("video_id").agg(F.max_by("timestamp", F.struct("score", -F.col("cand_id"))).alias("t"))
    return best.join(frames(s, d, "video_id", "timestamp", "llm_caption"), "video_id").where("abs(timestamp - t) <= 8")


@query("vqa_window", _BEST + " select video_id, id, ts as \"timestamp\" from w")
def vqa_window(s: SparkSession, d: str) -> DataFrame:
    """The frames within 8 s of each video's best candidate."""
    return _windows(s, d).select("video_id", "id", "timestamp")


@query("vqa_describe", _BEST + ", r as (select *, row_number() over (partition by video_id order by ts, id) r from w where llm_caption <> '') select video_id, string_agg(llm_caption, ' ' order by r) as answer from r where r <= 3 group by video_id")
def vqa_describe(s: SparkSession, d: str) -> DataFrame:
    """The first three captions of the window."""
    return _joined(_windows(s, d), "timestamp", 3, " ")


def _joined(rows: DataFrame, order: str, n: int, sep: str) -> DataFrame:
    w = Window.partitionBy("video_id").orderBy(order, "id")
    r = rows.where("llm_caption <> ''").withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    return r.groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "llm_caption"))), lambda x: x["llm_caption"]), sep).alias("answer"))


@query("rag_reader", f"""with {K}, {C}, r as (select c.video_id, c.cand_id, k.id, k.ts, score, array_to_string(list_filter([llm_caption, ocr_text, asr_text], lambda x: x is not null and x <> ''), ' · ') txt, row_number() over (partition by c.video_id order by score desc, cand_id) r, count(*) over (partition by c.video_id) n
from c join k on k.id = keyframe_id where c.video_id is not null and score is not null and not isnan(score)) select video_id, n, string_agg(id, ',' order by r) as cited, string_agg('[' || id || '] (' || coalesce(round_even(ts, 1)::varchar, '?') || 's)' || case when txt <> '' then ' — ' || txt else '' end, chr(10) order by r) as answer from r where r <= 5 group by video_id, n""")
def rag_reader(s: SparkSession, d: str) -> DataFrame:
    """Of each video's candidates how many there are, and the five best with their texts, each cited by its id."""
    c = candidates(s, d).where("video_id is not null and score is not null and not isnan(score)").select("video_id", "keyframe_id", "score", "cand_id")
    k = frames(s, d, "timestamp", "llm_caption", "ocr_text", "asr_text").withColumnRenamed("id", "keyframe_id")
    found = c.join(k.select("keyframe_id"), "keyframe_id", "left_semi")
    n = found.groupBy("video_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("video_id").orderBy(F.col("score").desc(), "cand_id")
    best = found.withColumn("r", F.row_number().over(w)).where("r <= 5").join(k, "keyframe_id")  # only the best get their texts
    said = F.array_join(F.filter(F.array("llm_caption", "ocr_text", "asr_text"), lambda x: x.isNotNull() & (x != "")), " · ")
    line = F.concat(F.lit("["), "keyframe_id", F.lit("] ("), F.coalesce(F.bround("timestamp", 1).cast("string"), F.lit("?")), F.lit("s)"), F.when(said != "", F.concat(F.lit(" — "), said)).otherwise(""))
    rows = best.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("r", F.col("keyframe_id").alias("id"), line.alias("line")))).alias("x"))
    return rows.join(n, "video_id").select("video_id", "n", F.array_join("x.id", ",").alias("cited"), F.array_join("x.line", "\n").alias("answer"))


def _far(v: str, picked: list[str]) -> str:
    return f"round(least({', '.join(f'list_distance(e.v, {p}.v)' for p in picked)}), 9)"


def _picks(k: int) -> str:
    """SQL: one step for each pick, from those picked before."""
    out = "p1 as (select video_id, id, v, r from e where r = first)"
    for n in range(2, k + 1):
        before = [f"p{i}" for i in range(1, n)]
        joins = " ".join(f"join {p} on {p}.video_id = e.video_id and {p}.id <> e.id" for p in before)
        out += f", p{n} as (select video_id, id, v, r from (select e.*, row_number() over (partition by e.video_id order by {_far('v', before)} desc, e.r) o from e {joins}) where o = 1)"
    return out + " " + " union all ".join(f"select video_id, id, {n} as pick from p{n}" for n in range(1, k + 1))


@query("diverse_pick", f"""with {K}, {C}, u as (select c.video_id, keyframe_id id, max(score) score, any_value(clip) v from c join k on k.id = c.keyframe_id where c.video_id is not null and score is not null and not isnan(score) and {ok('clip', 64)} group by c.video_id, keyframe_id),
e as (select *, min(r) over (partition by video_id) first from (select *, row_number() over (partition by video_id order by score desc, id) r from u) where r <= 20), """ + _picks(4))
def diverse_pick(s: SparkSession, d: str) -> DataFrame:
    """Of each video's twenty best frames four that differ most, to ask which is meant."""
    c = candidates(s, d).where("video_id is not null and score is not null and not isnan(score)").groupBy("video_id", F.col("keyframe_id").alias("id")).agg(F.max("score").alias("score"))
    rows = c.join(clips(s, d).select("id", "vec"), "id").withColumn("rank", -F.col("score"))
    return dialogue.diverse_pick(rows, "video_id", "rank", "id", "vec", 4, most=20).withColumn("pick", F.col("pick").cast("int"))


_FOLDED = ["event_type", "weekday", "k"]


def _fold_sql() -> str:
    """SQL: the dialogues turn by turn, each from the items that the filters so far leave."""
    e = "e as (select user_id, event_id turn, event_type, isodow(ts)::varchar weekday, props::json->>'k' k, value from events)"
    given = "g as (select user_id, turn, row_number() over (partition by user_id order by turn) n, case when turn % 3 = 0 then event_type end event_type, case when turn % 3 = 1 then weekday end weekday, case when turn % 11 = 2 then k end k from e)"
    state = "st as (select user_id, turn, n, " + ", ".join(f"last_value({a} ignore nulls) over (partition by user_id order by turn rows unbounded preceding) {a}" for a in _FOLDED) + " from g)"
    sets = "f as (select distinct event_type, weekday, k from st)"
    meets = " and ".join(f"(f.{a} is null or f.{a} = e.{a})" for a in _FOLDED)
    left = f"x as (select f.event_type fe, f.weekday fw, f.k fk, e.event_type, e.weekday, e.k from f join e on {meets})"
    hits = "h as (select fe, fw, fk, count(*) hits from x group by fe, fw, fk)"
    counts = " union all ".join(f"select fe, fw, fk, {i} i, {a} v, count(*) m from x where {a} is not null group by fe, fw, fk, {a}" for i, a in enumerate(_FOLDED))
    best = f"b as (select fe, fw, fk, list(i order by h desc, i) best from (select fe, fw, fk, i, round(log2(sum(m)) - sum(m * log2(m)) / sum(m), 6) h from ({counts}) group by fe, fw, fk, i) where h > 0 group by fe, fw, fk)"
    turn = "tt as (select user_id, turn, n, coalesce(hits, 0) hits, coalesce(best, []) best from st left join h on fe is not distinct from event_type and fw is not distinct from weekday and fk is not distinct from k left join b on b.fe is not distinct from event_type and b.fw is not distinct from weekday and b.fk is not distinct from k)"
    step = "case when hits = 0 then 'rephrase' when hits <= 5 or 2 * (n - 1) >= 5 or {ask} is null then 'finish' else 'ask' end"
    one = f"select user_id, turn, n, hits, {step.format(ask='best[1]')} step, case when {step.format(ask='best[1]')} = 'ask' then best[1] end a, case when {step.format(ask='best[1]')} = 'ask' then [best[1]] else []::int[] end asked from tt where n = 1"
    nxt = "list_filter(tt.best, lambda i: not list_contains(r.asked, i))[1]"
    more = f"select user_id, turn, n, hits, step, case when step = 'ask' then nx end, case when step = 'ask' then list_append(was, nx) else was end from (select *, {step.format(ask='nx')} step from (select tt.user_id, tt.turn, tt.n, tt.hits, {nxt} nx, r.asked was from r join tt on tt.user_id = r.user_id and tt.n = r.n + 1 where r.step <> 'finish'))"
    return f"with recursive {e}, {given}, {state}, {sets}, {left}, {hits}, {best}, {turn}, r as ({one} union all {more}) select user_id, turn, hits, step, (['event_type', 'weekday', 'k'])[a + 1] as asked from r"


@query("dialogue_fold", _fold_sql())
def dialogue_fold(s: SparkSession, d: str) -> DataFrame:
    """Each user's events as the turns of a dialogue that tells now and then a kind, a weekday or a number of the event looked for."""
    e = table(s, d, "events").select("user_id", F.col("event_id").alias("turn"), "event_type", (F.weekday("ts") + 1).cast("string").alias("weekday"), F.get_json_object("props", "$.k").alias("k"))
    told = lambda a, by, rest: F.when(F.col("turn") % by == rest, F.col(a)).alias(a)
    turns = e.select("user_id", "turn", told("event_type", 3, 0), told("weekday", 3, 1), told("k", 11, 2))
    return sessions.fold_dialogues(turns, e, "user_id", "turn", _FOLDED)
