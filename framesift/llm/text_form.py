"""One consistent form for text that reads the same but is stored in different characters.

Texts are exploded to positioned code points; a broadcast join maps each through canonical decomposition, letter width,
kind of space, invisible characters and look-alike letters; combining marks are ordered by class behind their starter; a
second broadcast join recomposes; the string is put together by position. All of it runs on rows partitioned once by a
hash of the text, so code points are never shuffled. Both tables are fixed by Unicode and don't grow with the data.

Kept apart: case, accents, missing spaces, digits, superscripts, circled and fraction signs, ligatures, mathematical letters.
Null gives null; an empty text, or one of invisible characters only, gives an empty text.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framesift.session import cut

# Letters of other alphabets that look like Latin ones, each row the letters and what they look like.
LOOK_ALIKES = [
    ("АВЕЅІЈКМНОРСТУХӀԚԜҮ", "ABESIJKMHOPCTYXIQWY"),  # Cyrillic capitals
    ("аеосрухіјѕһӏԛԝԁ", "aeocpyxijshlqwd"),  # Cyrillic small letters
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"),  # Greek capitals
    ("αγινορυ", "ayivopu"),  # Greek small letters
    ("ՕՍԼօսոհցզ", "OULounhgq"),  # Armenian
    ("ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᏀᏃᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏴ", "DRTiAJEWMHGZbRWSVSLCPKdB"),  # Cherokee
    ("ÐƉ", "ĐĐ"),  # barred D
]
# Control characters that count as a space.
SPACES = "\t\n\v\f\r\x1c\x1d\x1e\x1f\x85\u2028\u2029"
# Invisible characters that aren't in category Cf.
INVISIBLE = "".join(map(chr, [0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x180E), *range(0xFE00, 0xFE10)]))

WIDTHS = ("<wide>", "<narrow>")
TOP = 31  # the level of windows longer than 2 ** 30 s


def _tail(c: str) -> bool:
    """Whether c is a conjoining vowel or final, which follows its first letter as a mark does."""
    return "ᅡ" <= c <= "ᅵ" or "ᆨ" <= c <= "ᇂ"


@cache
def _look() -> dict[str, str]:
    return {a: b for x, y in LOOK_ALIKES for a, b in zip(x, y, strict=True)}


def map_char(c: str) -> str:
    """The decomposed characters that c comes to."""
    out = []
    for x in unicodedata.normalize("NFD", c):
        kind, *codes = unicodedata.decomposition(x).split() or [""]
        if kind in WIDTHS:
            out += map_char("".join(chr(int(k, 16)) for k in codes)) if x not in INVISIBLE else ""
        elif x in SPACES or unicodedata.category(x) == "Zs":
            out.append(" ")
        elif x not in INVISIBLE and unicodedata.category(x) != "Cf":
            out.append(_look().get(x, x))
    return "".join(out)


@cache
def _tables() -> tuple[pd.DataFrame, pd.DataFrame]:
    chars, forms = [], {}
    for k in [*range(0xD800), *range(0xE000, 0x110000)]:
        c = chr(k)
        to, mark = map_char(c), unicodedata.combining(c)
        if to != c or mark or _tail(c):
            chars.append((c, [(x, unicodedata.combining(x), not unicodedata.combining(x) and not _tail(x)) for x in to]))
        apart = unicodedata.normalize("NFD", c)
        if apart != c and unicodedata.normalize("NFC", apart) == c and map_char(apart[0]) == apart[0]:
            forms[apart] = c
    return pd.DataFrame({"ch": [c for c, _ in chars], "to": [[{"c": x, "cls": n, "st": s} for x, n, s in to] for _, to in chars]}), pd.DataFrame({"seg": list(forms), "form": list(forms.values())})


def mapping(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(ch, to): what each character that doesn't stay the same comes to; (seg, form): composed forms of starter and marks."""
    chars, forms = _tables()
    return spark.createDataFrame(chars, "ch string, to array<struct<c:string,cls:int,st:boolean>>"), spark.createDataFrame(forms, "seg string, form string")


def consistent_texts(texts: DataFrame, text: str = "text", out: str = "form") -> DataFrame:
    """One row per distinct non-null text with its consistent form. Columns: `text`, `out`."""
    spark = texts.sparkSession
    chars, forms = mapping(spark)
    distinct = texts.select(F.col(text).alias("t")).where("t is not null").distinct()
    # two hashes and the length stand for the text while its characters are apart; partitioned by one of them throughout
    keyed = distinct.select("t", F.xxhash64("t").alias("k1"), F.hash("t", F.char_length("t")).alias("k2")).repartition("k1", "k2")
    plain = F.col("t").rlike("\\A[ -~]*\\z")  # every character of these maps to itself
    # outer: a filter would be pushed below the exchange, which then couldn't be used twice
    points = keyed.select("k1", "k2", F.posexplode_outer(F.when(~plain, F.split("t", ""))).alias("pos", "ch"))
    own = F.array(F.struct(F.col("ch").alias("c"), F.lit(0).alias("cls"), F.lit(True).alias("st")))
    apart = points.join(F.broadcast(chars), "ch", "left").select("k1", "k2", "pos", F.posexplode(F.coalesce("to", own)).alias("sub", "x"))
    by = Window.partitionBy("k1", "k2")
    sofar = lambda *order: by.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    apart = apart.select("k1", "k2", "pos", "sub", "x.*").withColumn("seq", F.sum(F.col("st").cast("int")).over(sofar("pos", "sub")))
    order = ("seq", "cls", "pos", "sub")  # marks by class behind their starter
    ahead = [F.when(F.lead("seq", n).over(by.orderBy(*order)) == F.col("seq"), F.lead("c", n).over(by.orderBy(*order))) for n in (1, 2, 3)]
    lined = apart.select("k1", "k2", *order, "c", "st", F.row_number().over(by.orderBy(*order)).alias("n"), *[x.alias(f"a{i}") for i, x in enumerate(ahead, 1)])
    for i in (1, 2, 3):  # a starter with its first marks; null beside other rows, which then meet nothing
        key = F.when(F.col("st"), F.concat("c", *[f"a{j}" for j in range(1, i + 1)]))
        lined = lined.withColumn("key", key).join(F.broadcast(forms.withColumnsRenamed({"seg": "key", "form": f"f{i}"})), "key", "left").drop("key")
    lined = lined.select("k1", "k2", *order, "n", "st", F.coalesce("f3", "f2", "f1", "c").alias("c"), F.expr("case when not st then null when f3 is not null then 3 when f2 is not null then 2 when f1 is not null then 1 else 0 end").alias("used"))
    last = lambda x: F.last(x, ignorenulls=True).over(sofar(*order))
    kept = lined.select("k1", "k2", "n", "c", "st", (F.col("n") - last(F.expr("if(st, n, null)"))).alias("after"), last("used").alias("used")).where("st or after is null or after > used")
    whole = kept.groupBy("k1", "k2").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "c"))), lambda x: x["c"]), "").alias("f"))
    return keyed.join(whole, ["k1", "k2"], "left").select(F.col("t").alias(text), F.when(plain, F.col("t")).otherwise(F.coalesce("f", F.lit(""))).alias(out))


def with_consistent_text(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the column `out`: the consistent form of the column `text`, null for null. Other columns stay as they are."""
    forms = consistent_texts(df.select(F.col(text).alias("__t")), "__t", "__f")
    return df.withColumn("__t", F.col(text)).join(forms, "__t", "left").withColumn(out, F.col("__f")).drop("__t", "__f")


def find_same_reading(frames: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels and frames of the label's video and window whose `ocr_text` or `llm_caption` reads like `query` but is stored
    otherwise: `label_id`, `keyframe_id`, `field`.

    A key delivered twice counts once; rows with a null key, video, time, window bound or text, or one that is NaN, give no case; a
    reversed window covers nothing. The join is on video, consistent form and time: a window is looked up in the one or two stretches that
    it touches of the power of two seconds next above its length, and a frame is entered in its stretch of each length that occurs. So a
    frequent reading of a hot video isn't one key, and what meets mostly is a case.
    """
    k = frames.where("id is not null and video_id is not null and timestamp is not null and not isnan(timestamp)").select("id", "video_id", "timestamp", "ocr_text", "llm_caption").dropDuplicates(["id"])
    k = k.select("id", "video_id", "timestamp", F.expr("stack(2, 'ocr_text', ocr_text, 'llm_caption', llm_caption) as (field, text)")).where("text is not null")
    q = labels.where("label_id is not null and query is not null and video_id is not null and time_window[0] < time_window[1] and not isnan(time_window[1])")
    q = q.select("label_id", "video_id", F.col("query").alias("text"), F.expr("time_window[0]").alias("lo"), F.expr("time_window[1]").alias("hi")).dropDuplicates(["label_id"])
    forms = cut(consistent_texts(k.select("text").unionAll(q.select("text"))))  # read twice below
    stretch = lambda t: F.when(F.col("level") == TOP, 0).otherwise(F.floor(t / F.pow(F.lit(2.0), F.col("level"))).cast("bigint"))
    long = F.col("hi") - F.col("lo")
    q = q.withColumn("level", F.when(long > 2.0**30, TOP).otherwise(F.greatest(F.lit(0), F.ceil(F.log2(long)))).cast("int"))
    levels = sorted(r["level"] for r in q.select("level").distinct().collect())  # at most TOP + 1
    q = q.join(forms, "text").withColumnsRenamed({"text": "query", "form": "reads"})
    q = q.select("label_id", "query", "reads", "lo", "hi", F.col("video_id").alias("v"), F.col("level").alias("l"), F.explode(F.array_distinct(F.array(stretch(F.col("lo")), stretch(F.col("hi"))))).alias("s"))
    k = k.join(forms, "text").withColumn("level", F.explode(F.array(*map(F.lit, levels or [0])))).withColumn("stretch", stretch(F.col("timestamp")))
    on = (F.col("v") == F.col("video_id")) & (F.col("reads") == F.col("form")) & (F.col("l") == F.col("level")) & (F.col("s") == F.col("stretch"))
    return k.join(q, on).where((F.col("timestamp") >= F.col("lo")) & (F.col("timestamp") < F.col("hi")) & (F.col("query") != F.col("text"))).select("label_id", F.col("id").alias("keyframe_id"), "field")
