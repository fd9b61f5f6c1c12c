"""Labels of spans: completed names, runs of Latin letters, offsets in a longer text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEBREW_WORD = "[֐-׿]+"
LATIN_SIGN = "^[A-Za-z'.-]$"


def completed_end(text: Column, start: Column, end: Column, markers: list[str], reach: int = 50) -> Column:
    """The end of a name that stops at a word such as *son of*, moved behind the one or two Hebrew words that follow."""
    name = F.trim(F.substring(text, start + 1, end - start))
    stops = F.greatest(*(F.endswith(name, F.lit(m)) for m in markers), F.lit(False))
    more = F.regexp_extract(F.substring(text, end + 1, F.lit(reach)), rf"^\s+{HEBREW_WORD}(?:\s+{HEBREW_WORD})?", 0)
    return F.when(stops, end + F.length(more)).otherwise(end)


def latin_spans(df: DataFrame, key: str, text: str, least: int = 3) -> DataFrame:
    """``key, start, end`` of runs of Latin letters, apostrophes, stops and hyphens: ``least`` signs or more, or at the text's end."""
    latin = lambda c: F.coalesce(c.rlike(LATIN_SIGN), F.lit(False))
    # A column of its own: inside the lambdas the text would be split for each character.
    signs = df.where(F.length(text) > 0).select(key, F.transform(F.split(text, ""), latin).alias("is_latin"))
    beside = lambda i: F.coalesce(F.get("is_latin", i), F.lit(False))
    edges = lambda step: F.array_compact(F.transform("is_latin", lambda x, i: F.when(x & ~beside(i + step), i + max(step, 0))))
    runs = signs.select(key, F.size("is_latin").alias("n"), F.explode(F.arrays_zip(edges(-1).alias("start"), edges(1).alias("end"))).alias("r"))
    return runs.select(key, "n", F.col("r.start").alias("start"), F.col("r.end").alias("end")).where((F.col("end") - F.col("start") >= least) | (F.col("end") == F.col("n"))).drop("n")


def rebased(payload: Column, text: Column) -> tuple[Column, Column]:
    """``start, end`` of a payload's first place in a text; null where it is empty or absent."""
    at = F.nullif(F.instr(text, payload), F.lit(0))
    start = F.when(payload != "", at - 1)
    return start, start + F.length(payload)
