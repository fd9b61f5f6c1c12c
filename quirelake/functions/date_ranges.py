"""Twelve forms of dates, Hebrew and Gregorian, as column expressions.

``date_range`` gives ``struct<start int, end int, approximate boolean, source
string>`` by the first form, from the most specific on, that a text has; an
unreadable text gives nulls and an empty source.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirelake.functions.dates import MINOR_ERA, SELEUCID_ERA, century_range, gematria

_LETTERS = "א-ת"
_ORDINAL = f"[{_LETTERS}\"״'׳]"
_DASH = "[-–]"
_YEAR = r"(\d{3,4})"


def _number(s: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(s, pattern, group), F.lit("")).try_cast("int")


def _made(start: Column, end: Column, source: str, approximate: Column | bool) -> Column:
    flag = approximate if isinstance(approximate, Column) else F.lit(approximate)
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), flag.alias("approximate"), F.lit(source).alias("source"))


def _both(s: Column, pattern: str) -> tuple[Column, Column]:
    return _number(s, pattern, 1), _number(s, pattern, 2)


def _plausible(year: Column) -> Column:
    return (year > 100) & (year < 2100)


def _letters_number(text: Column) -> Column:
    """A century written in letters or digits, if it is one of 25."""
    n = F.coalesce(F.when(text.rlike(r"^\d+$"), text.try_cast("int")), F.when(text != "", gematria(text)))
    return F.when(n.between(1, 25), n)


def _centuries(first: Column, last: Column, source: str) -> Column:
    return F.when(first.isNotNull() & last.isNotNull(), _made(century_range(first)[0], century_range(last)[1], source, True))


def seleucid(s: Column) -> Column:
    """A year of the Seleucid era, by the Gregorian year in brackets or by its letters; a leading alef, or a value above 900, stands for a thousand more."""
    given = _number(s, r"\((\d{3,4})\)")
    letters = F.regexp_extract(s, rf"({_ORDINAL}+)\s*לשטרות", 1)
    value = gematria(letters)
    bare = F.regexp_replace(letters, "[\"״'׳ ]", "")
    year = value + F.when(bare.startswith("א") | (value > 900), 1000).otherwise(0) + SELEUCID_ERA
    by_letters = F.when((letters != "") & _plausible(year), _made(year, year, "seleucid_era", True))
    return F.when(F.contains(s, F.lit("לשטרות")), F.coalesce(F.when(given.isNotNull(), _made(given, given, "seleucid_era", False)), by_letters))


def hebrew_publication(s: Column) -> Column:
    """Hebrew letters with a Gregorian year in brackets."""
    given = _number(s, r"\((\d{3,4})\)")
    return F.when(given.isNotNull() & s.rlike(f"[{_LETTERS}]"), _made(given, given, "publication_hebrew_year", False))


def hebrew_approximate(s: Column) -> Column:
    """About, born, died."""
    about = F.contains(s, F.lit("בערך"))
    none = F.lit(None).cast("int")
    out = []
    for pattern in (rf"{_YEAR}\s*בערך\s*{_DASH}\s*{_YEAR}", rf"בערך\s*{_YEAR}\s*{_DASH}\s*{_YEAR}"):
        a, b = _both(s, pattern)
        out.append(F.when(a.isNotNull(), _made(a, b, "hebrew_approximate", True)))
    died, born, single = _number(s, rf"נפטר\s+{_YEAR}"), _number(s, rf"נולד\s+{_YEAR}"), _number(s, rf"{_YEAR}\s*בערך")
    out += [F.when(died.isNotNull(), _made(none, died, "hebrew_approximate", about)), F.when(born.isNotNull(), _made(born, none, "hebrew_approximate", about)), F.when(single.isNotNull(), _made(single, single, "hebrew_approximate", True))]
    return F.coalesce(*out)


def hebrew_active(s: Column) -> Column:
    """Active in one or two centuries, or in a year."""
    word = r"(?:פעל|פעיל)\s+"
    a, b = _both(s, rf"{word}(?:ב)?מאה\s+ה-?(\d{{1,2}})\s*{_DASH}\s*(\d{{1,2}})")
    one = _letters_number(F.regexp_extract(s, rf"{word}(?:ב)?מאה\s+ה-?({_ORDINAL}+|\d{{1,2}})", 1))
    year = _number(s, word + _YEAR)
    return F.coalesce(_centuries(a, b, "hebrew_active"), _centuries(one, one, "hebrew_active"), F.when(year.isNotNull(), _made(year, year, "hebrew_active", True)))


def hebrew_century(s: Column) -> Column:
    a, b = _both(s, rf"מאה\s+ה-?(\d{{1,2}})\s*{_DASH}\s*(\d{{1,2}})")
    digits = _number(s, r"מאה\s+ה-?(\d{1,2})")
    letters = _letters_number(F.regexp_extract(s, rf"מאה\s+ה-?({_ORDINAL}{{1,5}})", 1))
    return F.coalesce(_centuries(a, b, "hebrew_century"), _centuries(digits, digits, "hebrew_century"), _centuries(letters, letters, "hebrew_century"))


def english_approximate(s: Column) -> Column:
    word = r"(?:approximately|approx\.?|ca\.?)\s*"
    a, b = _both(s, rf"(?i){word}{_YEAR}\s*{_DASH}\s*{word}{_YEAR}")
    one = _number(s, rf"(?i)(?:ca\.?|c\.)\s*{_YEAR}")
    return F.coalesce(F.when(a.isNotNull(), _made(a, b, "english_approximate", True)), F.when(one.isNotNull(), _made(one, one, "english_approximate", True)))


def english_century(s: Column) -> Column:
    nth = r"(\d{1,2})(?:th|st|nd|rd)\s*"
    a, b = _both(s, rf"(?i){nth}{_DASH}\s*{nth}cent")
    one = _number(s, rf"(?i){nth}cent")
    return F.coalesce(_centuries(a, b, "english_century"), _centuries(one, one, "english_century"))


def uncertain_range(s: Column) -> Column:
    a, b = _both(s, rf"\??\s*{_YEAR}\s*\??\s*{_DASH}\s*\??\s*{_YEAR}\s*\??")
    return F.when(F.contains(s, F.lit("?")) & a.isNotNull(), _made(a, b, "gregorian_uncertain_range", True))


def open_range(s: Column) -> Column:
    a = _number(F.regexp_replace(s, "[. ]+$", ""), rf"{_YEAR}\s*{_DASH}\s*$")
    return F.when(a.isNotNull(), _made(a, F.lit(None), "gregorian_open", False))


def closed_range(s: Column) -> Column:
    a, b = _both(s, rf"{_YEAR}\s*{_DASH}\s*{_YEAR}")
    return F.when(~F.contains(s, F.lit("?")) & _plausible(a) & _plausible(b), _made(a, b, "gregorian_range", False))


def single_year(s: Column) -> Column:
    """The first number of four digits; a question mark or a bracket makes it approximate."""
    y = _number(s, r"(?<![\p{L}\p{N}_])(\d{4})(?![\p{L}\p{N}_])")
    return F.when(_plausible(y), _made(y, y, "gregorian_single", s.rlike(r"[?\[]")))


def hebrew_year(s: Column) -> Column:
    """Two letters or more whose value is at least 50, as a year without its thousands."""
    value = gematria(s)
    letters = F.length(F.regexp_replace(s, f"[^{_LETTERS}]", ""))
    return F.when((letters >= 2) & (value >= 50) & _plausible(value + MINOR_ERA), _made(value + MINOR_ERA, value + MINOR_ERA, "standalone_hebrew_year", True))


FORMS = (seleucid, hebrew_publication, hebrew_approximate, hebrew_active, hebrew_century, english_approximate, english_century, uncertain_range, open_range, closed_range, single_year, hebrew_year)


def date_range(text: Column) -> Column:
    """The range that the first fitting form gives."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", ""), r"\.+$", "")
    none = F.lit(None).cast("int")
    # Bound by a lambda, the text is made ready once for all forms.
    return F.get(F.transform(F.array(bare), lambda s: F.coalesce(*(form(s) for form in FORMS), _made(none, none, "", False))), 0)


def person_years(text: Column) -> Column:
    """``struct<birth, death, active>``: a century or an active period counts at its middle, a single year as active."""
    def years(r: Column) -> Column:
        a, b = r["start"], r["end"]
        period = r["source"].isin("hebrew_century", "english_century", "hebrew_active")
        both, same = a.isNotNull() & b.isNotNull(), F.coalesce(a == b, F.lit(False))
        active = F.when(period & both, F.floor((a + b) / 2)).when(period, a).when(both & same, a)
        return F.struct(F.when(~period & ~same, a).cast("int").alias("birth"), F.when(~period & ~same, b).cast("int").alias("death"), active.cast("int").alias("active"))

    return F.get(F.transform(F.array(date_range(text)), years), 0)


def first_year(text: Column) -> Column:
    """The first plausible number of three or four digits in a free text."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(\d{3,4})"), F.lit(1)), lambda y: y.cast("int"))
    return F.get(F.filter(found, _plausible), 0)


def manuscript_year(year: Column, original: Column) -> Column:
    """The structured year if it is plausible, or else the original text's first plausible one."""
    return F.coalesce(F.when(_plausible(year), year), first_year(original))


def inception_year(year: Column, first: Column, start: Column, original: Column) -> Column:
    """The earliest known year: structured, by the fixed field, by the range, or the first number of a text."""
    return F.coalesce(year, first, start, _number(original, r"(?<![\p{L}\p{N}_])(\d{3,4})(?![\p{L}\p{N}_])"))


def century_text(original: Column) -> Column:
    """A century as a text names it, in English or in Hebrew letters."""
    s = F.trim(F.replace(F.coalesce(original, F.lit("")), F.lit('""'), F.lit('"')))
    english = F.nullif(F.lower(F.regexp_extract(s, r"(?i)(\d{1,2}(?:th|st|nd|rd)\s*century)", 1)), F.lit(""))
    hebrew = F.nullif(F.regexp_extract(s, rf"(מאה\s+[{_LETTERS}][״\"']?[{_LETTERS}]?)", 1), F.lit(""))
    return F.coalesce(english, hebrew)
