"""Answers to questions from the captions and objects of the frames of a window: counts, who does something, descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framesift.functions import text as T

UNKNOWN, NOTHING = "không xác định", "không có mô tả"


def answer_windows(rows: DataFrame, most: int = 100) -> DataFrame:
    """`q`, `intent`, `answer`, `value`, `used`: an answer to each question from the frames of its window.

    rows: `q`, `question`, and of each frame `id`, `timestamp`, `llm_caption`, `objects`. A count is the largest number shortly before the thing
    asked for in a caption, else the number of frames that mention it, and unknown if nothing countable is named; who does something is
    what stands before the action in the first caption that has both; anything else is described by the first three captions.
    used: the frames by time, at most `most` of them. value: of counts only."""
    noun, action = T.target_noun(F.col("question")), T.asked_action(F.col("question"))
    f = rows.withColumns({"intent": T.intent(F.col("question")), "noun": noun, "action": action, "at": F.struct("timestamp", "id")})
    f = f.withColumn("subject", F.coalesce(*(F.when(F.col("action") == a, T.subject_of(F.col("llm_caption"), a)) for a in T.SUBJECT_ACTIONS)))
    says = F.contains(F.lower("llm_caption"), F.col("noun")) | F.array_contains(F.transform("objects", lambda o: F.lower(o)), F.col("noun"))
    by_time = Window.partitionBy("q").orderBy("timestamp", "id")
    told = f.where("llm_caption <> ''").withColumn("r", F.row_number().over(by_time)).where("r <= 3").groupBy("q").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "llm_caption"))), lambda x: x["llm_caption"]), " ").alias("told"))
    used = f.withColumn("r", F.row_number().over(by_time)).where(F.col("r") <= most).groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]).alias("used"))
    g = f.groupBy("q").agg(F.first("intent").alias("kind"), F.first("noun").alias("what"), F.max(T.number_before(F.col("llm_caption"), F.col("noun"))).alias("n"), F.count(F.when(says, 1)).alias("c"), F.min_by(F.when(F.col("subject").isNotNull(), F.col("subject")), F.when(F.col("subject").isNotNull(), F.col("at"))).alias("who"))
    value = F.when((F.col("kind") == "count") & F.col("what").isNotNull(), F.coalesce(F.col("n").cast("bigint"), F.col("c")))
    said = F.when(F.col("kind") == "count", F.coalesce(value.cast("string"), F.lit(UNKNOWN))).when(F.col("kind") == "identify", F.coalesce("who", F.lit(UNKNOWN))).otherwise(F.coalesce("told", F.lit(NOTHING)))
    return g.join(told, "q", "left").join(used, "q").select("q", F.col("kind").alias("intent"), said.alias("answer"), value.alias("value"), "used")
