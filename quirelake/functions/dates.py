"""Dates of manuscripts and persons: an ordered ladder of parsers, as column expressions.

Each parser gives ``struct<start int, end int, approximate boolean, source string>``
or null; the first that isn't null counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The numbers of the Hebrew letters.
LETTERS = {"א": 1, "ב": 2, "ג": 3, "ד": 4, "ה": 5, "ו": 6, "ז": 7, "ח": 8, "ט": 9, "י": 10, "כ": 20, "ך": 20, "ל": 30, "מ": 40, "ם": 40, "נ": 50, "ן": 50, "ס": 60, "ע": 70, "פ": 80, "ף": 80, "צ": 90, "ץ": 90, "ק": 100, "ר": 200, "ש": 300, "ת": 400}
#: Ordinals of centuries in Hebrew.
CENTURIES = {"י": 10, "י\"א": 11, "י\"ב": 12, "י\"ג": 13, "י\"ד": 14, "ט\"ו": 15, "ט\"ז": 16, "י\"ז": 17, "י\"ח": 18, "י\"ט": 19}
#: A Hebrew year without its thousands, and the years of the Seleucid era, begin here.
MINOR_ERA, SELEUCID_ERA = 1240, -312


def gematria(s: Column) -> Column:
    """The sum of a string's letters; signs count nothing."""
    table = F.create_map(*[F.lit(x) for kv in LETTERS.items() for x in kv])
    return F.aggregate(F.split(s, ""), F.lit(0), lambda a, c: a + F.coalesce(table[c], F.lit(0)))


def _range(start: Column, end: Column, source: str, approximate: bool = False) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(approximate).alias("approximate"), F.lit(source).alias("source"))


def _number(s: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(s, pattern, group), F.lit("")).try_cast("int")


def century_range(c: Column) -> tuple[Column, Column]:
    return (c - 1) * 100 + 1, c * 100


def _century(s: Column) -> Column:
    one = _number(s, r"(?i)\b(\d{1,2})(?:st|nd|rd|th)[ -]*(?:cent|c\.)")
    a, b = (_number(s, r"(?i)\b(\d{1,2})(?:st|nd|rd|th)?\s*[-/]\s*(\d{1,2})(?:st|nd|rd|th)[ -]*(?:cent|c\.)", g) for g in (1, 2))
    start, end = F.coalesce(a, one), F.coalesce(b, one)
    return F.when(start.isNotNull(), _range(century_range(start)[0], century_range(end)[1], "century", True))


def _hebrew_century(s: Column) -> Column:
    name = F.regexp_extract(s, r"מאה (?:ה-?)?([א-ת]\"?[א-ת]?)", 1)
    table = F.create_map(*[F.lit(x) for kv in CENTURIES.items() for x in kv])
    c = table[name]
    return F.when(c.isNotNull(), _range(century_range(c)[0], century_range(c)[1], "hebrew century", True))


def _hebrew_with_year(s: Column) -> Column:
    y = _number(s, r"[א-ת\"']+[^0-9(]*\((\d{4})\)")
    return F.when(y.isNotNull(), _range(y, y, "hebrew with year"))


def _seleucid(s: Column) -> Column:
    letters = F.regexp_extract(s, r"([א-ת][א-ת\"']+)\s*(?:לשטרות|שטרות)", 1)
    n = gematria(letters)
    # Letters below a thousand leave the thousand out.
    y = F.when(n > 0, F.when(n < 1000, n + 1000).otherwise(n) + SELEUCID_ERA)
    return F.when(y.isNotNull(), _range(y, y, "seleucid"))


def _hebrew_word(s: Column, word: str, source: str, open_start: bool, open_end: bool) -> Column:
    y = _number(s, rf"{word}\D{{0,6}}(\d{{3,4}})")
    none = F.lit(None).cast("int")
    return F.when(y.isNotNull(), _range(none if open_start else y, none if open_end else y, source, True))


def _approximate(s: Column) -> Column:
    y = _number(s, r"(?i)\b(?:ca?\.?|circa|approximately|about)\s*(\d{3,4})")
    return F.when(y.isNotNull(), _range(y, y, "approximate", True))


def _year_range(s: Column) -> Column:
    a, b = (_number(s, r"\b(\d{3,4})\s*[-–]\s*(\d{3,4})\b", g) for g in (1, 2))
    return F.when(a.isNotNull() & b.isNotNull(), _range(a, b, "range"))


def _open(s: Column) -> Column:
    from_, to = _number(s, r"\b(\d{3,4})\s*[-–]\s*$"), _number(s, r"^\s*[-–]\s*(\d{3,4})\b")
    none = F.lit(None).cast("int")
    return F.when(from_.isNotNull(), _range(from_, none, "open")).when(to.isNotNull(), _range(none, to, "open"))


def _uncertain(s: Column) -> Column:
    y, decade = _number(s, r"\b(\d{3,4})\s*\?"), _number(s, r"\b(\d{2,3})[-?](?:\D|$)")
    return F.when(y.isNotNull(), _range(y, y, "uncertain", True)).when(F.length(s) <= 6, F.when(decade.between(50, 210), _range(decade * 10, decade * 10 + 9, "uncertain", True)))


def _single(s: Column) -> Column:
    y = _number(s, r"\b(\d{3,4})\b")
    return F.when(y.between(100, 2100), _range(y, y, "single"))


def _hebrew_year(s: Column) -> Column:
    n = gematria(F.regexp_extract(s, r"(?:^|\s)(ת?[קרשת][א-ת]?[\"'][א-ת])(?:\s|$)", 1))
    return F.when(n.between(1, 999), _range(n + MINOR_ERA, n + MINOR_ERA, "hebrew year"))


def resolve(s: Column) -> Column:
    """The first parser that understands a date string."""
    return F.coalesce(
        _seleucid(s), _hebrew_with_year(s), _hebrew_word(s, "נפטר", "died", True, False), _hebrew_word(s, "נולד", "born", False, True), _hebrew_word(s, "בערך", "hebrew approximate", False, False), _hebrew_word(s, "פעל", "active", False, False), _hebrew_century(s), _approximate(s),
        _century(s), _uncertain(s), _year_range(s), _open(s), _single(s), _hebrew_year(s),
    )


def person_dates(s: Column) -> Column:
    """``struct<birth, death, active>`` of a person's date string."""
    a, b = (_number(s, r"(\d{3,4})\??\s*[-–]\s*(\d{3,4})", g) for g in (1, 2))
    died = F.coalesce(_number(s, r"(?i)(?:d\.|died)\s*(\d{3,4})"), _number(s, r"^\s*[-–]\s*(\d{3,4})"))
    active = _number(s, r"(?i)(?:fl\.|active)\s*(?:ca?\.?\s*)?(\d{3,4})")
    born = F.coalesce(_number(s, r"(?i)(?:b\.|born)\s*(\d{3,4})"), _number(s, r"^\s*(\d{3,4})\??\s*[-–]\s*$"))
    return F.struct(F.when(active.isNull(), F.coalesce(a, born)).alias("birth"), F.when(active.isNull(), F.coalesce(b, died)).alias("death"), active.alias("active"))


def first_year(s: Column) -> Column:
    """The first number between 100 and 2100, exclusive."""
    found = F.filter(F.transform(F.regexp_extract_all(s, F.lit(r"(\d{3,4})"), F.lit(1)), lambda y: y.cast("int")), lambda y: (y > 100) & (y < 2100))
    return F.get(found, 0)


def midpoint(start: Column, end: Column) -> Column:
    return F.when(start.isNotNull() & end.isNotNull(), F.floor((start + end) / 2).cast("int")).otherwise(F.coalesce(start, end))


def time_value(start: Column, end: Column) -> Column:
    """``struct<time, precision, calendar, earliest, latest>``: a year, decade or century; Julian before 1583."""
    span = end - start
    precision = F.when(span <= 0, 9).when(span < 10, 8).otherwise(7)
    year = midpoint(start, end)
    calendar = F.when(year < 1583, "Q1985786").otherwise("Q1985727")
    return F.struct(F.concat(F.lit("+"), F.lpad(year.cast("string"), 4, "0"), F.lit("-00-00T00:00:00Z")).alias("time"), precision.alias("precision"), calendar.alias("calendar"), start.alias("earliest"), end.alias("latest"))


def label(start: Column, end: Column, approximate: Column) -> Column:
    body = F.when(start == end, start.cast("string")).otherwise(F.concat(F.coalesce(start.cast("string"), F.lit("")), F.lit("-"), F.coalesce(end.cast("string"), F.lit(""))))
    return F.concat(F.when(approximate, "ca. ").otherwise(""), body)


def sum_of(*columns: Column) -> Column:
    return reduce(Column.__add__, columns)
