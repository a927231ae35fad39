"""The place that a question names, as an expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framesift.functions.text import TIMES, let

# What introduces a place, what ends it, and what isn't one.
MARKS = ["ở ", "tại ", "trong ", "trên "]
ENDS = r"[,.;?]| và | rồi | trước | sau |\s+có\s+"
NOT_A_PLACE = ["video", "đoạn video", "phim", "đoạn phim", "ảnh", "hình"]
QUESTION = ["bao nhiêu", "đếm", "mấy"]
WORDS = 6


def _before_time(place: Column) -> Column:
    """A place up to the longest time phrase in it."""
    low = F.lower(place)
    longest = sorted(TIMES, key=len, reverse=True)
    return F.coalesce(*(F.when(F.contains(low, F.lit(t)), F.trim(F.substring_index(low, t, 1))) for t in longest), low)


def location(text: Column) -> Column:
    """What follows the first mark that a place of at most six words follows; null without one. Case is kept."""

    def after(mark: str) -> Column:
        rest = F.when(F.contains(F.lower(text), F.lit(mark)), F.substr(text, F.instr(F.lower(text), mark) + len(mark)))
        clause = F.trim(F.regexp_extract(rest, rf"(?s)^(.*?)(?:{ENDS}|$)", 1))

        def named(clause: Column) -> Column:
            short = _before_time(clause)
            asks = F.lit(False)
            for q in QUESTION:
                asks = asks | F.contains(short, F.lit(q))
            fits = (short != "") & ~short.isin(NOT_A_PLACE) & ~asks & (F.size(F.split(short, r"\s+")) <= WORDS)
            return F.when(fits, F.trim(F.substring(clause, F.lit(1), F.length(short))))

        return let(clause, named)

    return F.coalesce(*map(after, MARKS))
