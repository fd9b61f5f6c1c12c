"""String functions: normalised names, sentences, windows, identifiers.

Java's ``\\w`` and ``\\d`` know ASCII only; ``(?U)`` makes them Unicode-aware.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

HEBREW_POINTS = r"[֑-ׇ]"


@pandas_udf(StringType())
def _nfd(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFD", x))


@pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@pandas_udf(StringType())
def _nfkd(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x))


def squeezed(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def authority_name(s: Column) -> Column:
    """No points, no marks, no punctuation but hyphens; lower case."""
    bare = F.regexp_replace(_nfd(F.regexp_replace(s, HEBREW_POINTS, "")), r"\p{Mn}", "")
    return F.lower(squeezed(F.regexp_replace(bare, r"(?U)[^\w\s-]", "")))


def place_name(s: Column) -> Column:
    """As ``authority_name``, without a trailing parenthesis and with apostrophes."""
    cut = F.regexp_replace(s, r"\s*\([^)]*\)\s*$", "")
    bare = F.regexp_replace(_nfd(F.regexp_replace(cut, HEBREW_POINTS, "")), r"\p{Mn}", "")
    return F.lower(squeezed(F.regexp_replace(bare, r"(?U)[^\w\s'-]", "")))


def strict_name(s: Column) -> Column:
    """No points or cantillation; punctuation becomes a blank; composed form."""
    bare = F.regexp_replace(_nfd(F.regexp_replace(s, HEBREW_POINTS, "")), r"\p{Mn}", "")
    return _nfc(squeezed(F.regexp_replace(bare, r"(?U)[^\w\s]", " ")))


def without_marks(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(_nfkd(s), r"\p{Mn}", ""), HEBREW_POINTS, "")


def plain_name(s: Column) -> Column:
    """A normaliser of built-in functions alone: lower case, no punctuation but hyphens, single blanks."""
    return F.lower(squeezed(F.regexp_replace(s, r"[^\p{L}\p{N}\s-]", "")))


def uri_safe(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(s), r"[^A-Za-z0-9_.-]+", "_"), r"^_+|_+$", "")


def uri_safe_hebrew(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(s), r"[^A-Za-z0-9א-ת_.-]+", "_"), r"^_+|_+$", "")


def trimmed_edges(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^[\s,.;:/\[\]()\"]+|[\s,.;:/\[\]()\"]+$", "")


def natural_order(name: Column) -> Column:
    """``Surname, Given[, dates]`` as ``Given Surname``."""
    parts = F.split(name, r"\s*,\s*")
    bare = F.filter(parts, lambda p: ~p.rlike(r"^[0-9?-][0-9 ?.-]*$") & (p != ""))
    return F.when(F.size(bare) == 2, F.concat_ws(" ", bare[1], bare[0])).otherwise(F.array_join(bare, ", "))


def dedupe_key(authority: Column, cluster: Column, name: Column) -> Column:
    return F.coalesce(F.concat(F.lit("authority:"), authority), F.concat(F.lit("viaf:"), cluster), F.concat(F.lit("name:"), plain_name(name)))


def ascii_only(s: Column) -> Column:
    return F.regexp_replace(s, r"[^\x00-\x7F]", "")


def has_hebrew(s: Column) -> Column:
    return s.rlike(r"[֐-׿]")


def script_counts(s: Column) -> list[Column]:
    """Aggregates of Hebrew and Latin letters."""
    n = lambda p: F.sum(F.length(F.regexp_replace(s, p, ""))).cast("long")
    return [n(r"[^֐-׿]").alias("hebrew"), n(r"[^A-Za-z]").alias("latin")]


def sentences(s: Column, least: int = 10) -> Column:
    """Sentences of ``least`` characters or more; they end at a full stop, ``!``, ``?`` or a line."""
    return F.filter(F.transform(F.split(s, r"(?<=[.!?])\s+|\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= least)


def pieces(s: Column, mark: str = "|") -> Column:
    """Trimmed, non-empty parts of a delimited value."""
    return F.filter(F.transform(F.split(s, f"[{mark}]"), lambda x: F.trim(x)), lambda x: x != "")


def keyword_context(parts: Column, keyword: str) -> Column:
    """The first sentence with the keyword and its neighbours, or null."""
    at = F.array_position(F.transform(parts, lambda p: F.contains(F.lower(p), F.lit(keyword.lower()))), True).cast("int")
    return F.when(at > 0, F.array_join(F.slice(parts, F.greatest(at - 1, F.lit(1)), F.when(at == 1, 2).otherwise(3)), " "))


def left_window(text: Column, needle: Column, width: int = 30) -> Column:
    """Up to ``width`` characters before the first occurrence; null if there is none."""
    at = F.instr(text, needle)
    start = F.greatest(at - width, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at - start))


def snippet(text: Column, start: Column, end: Column, width: int = 100) -> Column:
    a = F.greatest(start - width, F.lit(0))
    return F.substring(text, a + 1, end + width - a)


def sliced(text: Column, start: Column, end: Column) -> Column:
    """``text[start:end]`` where the span is inside the text, or null."""
    return F.when((start >= 0) & (end <= F.length(text)) & (start < end), F.substring(text, start + 1, end - start))


def keyword_hit(text: Column, keyword: str) -> Column:
    """The keyword as a whole token."""
    return F.array_contains(F.split(F.lower(text), r"(?U)[^\w]+"), keyword.lower())


def first_of(text: Column, table: Iterable[tuple[str, str]]) -> Column:
    """The name of the first pattern in order that matches, or null."""
    return F.coalesce(*(F.when(text.rlike(p), F.lit(n)) for n, p in table))


def all_of(text: Column, table: Iterable[tuple[str, str]]) -> Column:
    """The names of all patterns that match."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p in table)))


def viaf_id(uri: Column) -> Column:
    return F.nullif(F.regexp_extract(uri, r"viaf/(\d{8,15})", 1), F.lit(""))


def qid(uri: Column) -> Column:
    return F.nullif(F.regexp_extract(uri, r"(Q[1-9]\d*)$", 1), F.lit(""))


def qid_number(q: Column) -> Column:
    return F.coalesce(F.substring(q, F.lit(2), F.length(q)).try_cast("bigint"), F.lit(10**12))


def isni(s: Column) -> Column:
    bare = F.regexp_replace(s, r"[\s-]", "")
    return F.when(bare.rlike(r"^\d{15}[\dX]$"), bare)


def lccn(s: Column) -> Column:
    bare = F.regexp_replace(F.lower(s), r"\s", "")
    return F.when(bare.rlike(r"^[a-z]{1,3}\d{8,10}$"), bare)


def gram_counts(a: Column) -> Column:
    return F.size(F.split(squeezed(a), " "))


def escaped(s: Column) -> Column:
    """For quoted output: backslashes and quotes escaped, tabs and line feeds blanked."""
    return F.regexp_replace(F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), r"[\t\r\n]+", " ")


def cut(s: Column, most: int = 250) -> Column:
    return F.left(s, F.lit(most))


# Guards over names and entities -----------------------------------------------

#: Fixed values.
ANONYMOUS = ("anonymous", "unknown", "various", "אנונימי", "לא ידוע")
INSTITUTIONS = ("library", "university", "museum", "college", "institute", "archive", "seminary", "ספריה", "אוניברסיטה", "מכון")


def is_anonymous(name: Column) -> Column:
    return F.lower(F.trim(name)).isin(*ANONYMOUS)


def is_institution(name: Column) -> Column:
    return F.lower(name).rlike("|".join(INSTITUTIONS))


def is_placeholder(name: Column) -> Column:
    letters = F.regexp_replace(name, r"[^\p{L}]", "")
    return name.isNull() | (F.length(letters) < 2) | is_anonymous(name)


def rejection(name: Column) -> Column:
    """Why a recognised name is no person's; null if nothing speaks against it."""
    return (
        F.when(name.isNull() | (F.trim(name) == ""), "empty")
        .when(is_anonymous(name), "anonymous")
        .when(name.rlike(r"\d"), "digits")
        .when(is_institution(name), "institution")
        .when(F.length(F.regexp_replace(name, r"[^\p{L}]", "")) < 2, "too short")
        .when(F.length(name) > 80, "too long")
    )


# Identifiers and addresses --------------------------------------------------------


def canonical_lccn(s: Column) -> Column:
    """A known prefix, one blank, two to ten digits; null if it can't be made so."""
    p = r"^(n|nb|nr|no|ns|sh|sj)\s*([0-9]{2,10})$"
    bare = F.trim(s)
    return F.when(bare.rlike(p), F.concat_ws(" ", F.regexp_extract(bare, p, 1), F.regexp_extract(bare, p, 2)))


def canonical_isni(s: Column) -> Column:
    """Sixteen signs in four groups, the last one a digit or X."""
    bare = F.regexp_replace(s, r"\s+", "")
    return F.when(bare.rlike(r"^[0-9]{15}[0-9X]$"), F.regexp_replace(bare, "^(.{4})(.{4})(.{4})(.{4})$", "$1 $2 $3 $4"))


def canonical_bnf(s: Column) -> Column:
    """Eight digits and a check letter, without the prefix *cb*."""
    bare = F.regexp_replace(F.lower(F.trim(s)), "^cb", "")
    return F.when(bare.rlike("^[0-9]{8}[0-9bcdfghjkmnpqrstvwxz]$"), bare)


def j9u_id(control_number: Column) -> Column:
    return F.trim(control_number)


def catalogue_url(control_number: Column, base: str = "https://www.nli.org.il/en/manuscripts/{}/NLI") -> Column:
    before, after = base.split("{}")
    return F.concat(F.lit(before), F.trim(control_number), F.lit(after))


def is_http_uri(s: Column) -> Column:
    return F.trim(s).rlike(r"(?i)^https?://\S+$")


def authority_parts(values: Column) -> Column:
    """``struct<viaf_id, wikidata_id, external_uri_nli, same_as_uris>`` of a field's raw values: of several of a kind the last counts."""
    viaf_uri, qid_uri = r"(?i)https?://(?:www\.)?viaf\.org/viaf/(\d+)", r"(?i)https?://(?:www\.)?wikidata\.org/entity/(Q\d+)"
    held = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v != "")
    part = lambda v, p: F.nullif(F.regexp_extract(v, p, 1), F.lit(""))
    last = lambda found: F.element_at(F.array_compact(found), -1)
    some = lambda found: F.when(F.size(F.array_compact(found)) > 0, last(F.concat(F.array(F.lit("")), found)))
    viaf = F.transform(held, lambda v: F.coalesce(part(v, viaf_uri), part(v, r"(?i)\(VIAF\)\s*(\d+)"), F.when(v.rlike(r"^\d{5,}$"), v)))
    item = F.transform(held, lambda v: F.upper(F.coalesce(part(v, qid_uri), F.when(v.rlike(r"(?i)^Q\d+$"), v))))
    nli = F.transform(held, lambda v: F.when(is_http_uri(v) & F.contains(F.lower(v), F.lit("nli.org.il")), v))
    same = F.flatten(F.transform(held, lambda v: F.array(F.concat(F.lit("https://viaf.org/viaf/"), part(v, viaf_uri)), F.concat(F.lit("https://www.wikidata.org/entity/"), F.upper(part(v, qid_uri))), F.when(is_http_uri(v) & F.contains(F.lower(v), F.lit("nli.org.il")), v))))
    return F.struct(some(viaf).alias("viaf_id"), some(item).alias("wikidata_id"), some(nli).alias("external_uri_nli"), F.array_distinct(F.array_compact(same)).alias("same_as_uris"))


def literal_escape(s: Column) -> Column:
    """For a quoted literal of a query: backslashes doubled, quotes left out."""
    return F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit(""))


#: Words in an address and the kind that they show, first match first.
ADDRESS_KINDS = (("person", "person"), ("ms_", "manuscript"), ("manuscript", "manuscript"), ("work", "work"), ("expression", "expression"), ("place", "place"), ("cu_", "codicological_unit"), ("event", "event"), ("creation", "event"), ("production", "event"), ("group", "organization"))


def kind_of_address(uri: Column) -> Column:
    return F.coalesce(*(F.when(F.contains(F.lower(uri), F.lit(word)), F.lit(kind)) for word, kind in ADDRESS_KINDS), F.lit("default"))


# Texts of fields and names -----------------------------------------------------------


def clean_field(s: Column) -> Column:
    """Without quotes around it, double pipes, runs of blanks and commas at its end; null becomes empty."""
    bare = F.regexp_replace(F.coalesce(s, F.lit("")), "^[\"']+|[\"']+$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(bare, F.lit("||"), F.lit("|")), r"(?U)\s+", " "), "[,;]+$", ""))


def clean_entity(s: Column) -> Column:
    """Trimmed, without quotes around it, single blanks; null if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"(?U)^\s+|\s+$", ""), '^"+|"+$', ""), "^'+|'+$", "")
    return F.nullif(F.regexp_replace(bare, r"(?U)\s+", " "), F.lit(""))


#: Words that show an owner, an author, a scribe, and a change of hands.
OWNER_WORDS = ("בעלים", "קנה", "ירש", "רכש", "נקנה", "ברשותו", "שייך")
AUTHOR_WORDS = ("מחבר", "חיבר", "כותב", "מאת", "חובר")
SCRIBE_WORDS = ("מעתיק", "העתיק", "כתב", "העתקה", "סופר")
BOUGHT_WORDS = ("קנה", "ירש", "נקנה", "רכש")


def role_in_context(context: Column, entity: Column, predicted: Column, confidence: Column, owner: tuple[str, ...] = OWNER_WORDS, author: tuple[str, ...] = AUTHOR_WORDS, scribe: tuple[str, ...] = SCRIBE_WORDS) -> Column:
    """A predicted role set right by the words around a name.

    In order: a statement of ownership; a change of hands, for authors and
    scribes; the nearer one of author's and owner's word; a confident prediction;
    for an unsure one the role of most words (owner, author, scribe on a tie).
    """
    text = F.lower(context)
    has = lambda w: F.contains(text, F.lit(w))
    count = lambda words: sum((has(w).cast("int") for w in words[1:]), has(words[0]).cast("int"))
    owners, authors, scribes = count(owner), count(author), count(scribe)
    at = F.instr(text, F.lower(entity))
    far = lambda w: F.abs(F.instr(text, F.lit(w)) - at)
    both = has("מחבר") & has("בעלים") & (at > 0)
    bought = has(BOUGHT_WORDS[0]) | has(BOUGHT_WORDS[1]) | has(BOUGHT_WORDS[2]) | has(BOUGHT_WORDS[3])
    most = F.greatest(owners, authors, scribes)
    voted = F.when(owners == most, "OWNER").when(authors == most, "AUTHOR").otherwise("TRANSCRIBER")
    return (
        F.when(has("בעלים של") & (owners > 0), "OWNER")
        .when(bought & predicted.isin("AUTHOR", "TRANSCRIBER"), "OWNER")
        .when(both & (far("מחבר") < far("בעלים")) & (predicted == "OWNER"), "AUTHOR")
        .when(both & (far("בעלים") < far("מחבר")) & (predicted == "AUTHOR"), "OWNER")
        .when(confidence > 0.8, predicted)
        .when((confidence < 0.5) & (most > 0), voted)
        .otherwise(predicted)
    )


def with_certainty(levels: Column, field: str, level: Column, note: Column | None = None) -> Column:
    """A map of certainty levels with a field's level, and its note if there is one; a later entry replaces an earlier."""
    added = F.create_map(F.lit(field), level)
    if note is not None:
        added = F.when(F.coalesce(note != "", F.lit(False)), F.map_concat(added, F.create_map(F.lit(f"{field}_note"), note))).otherwise(added)
    kept = F.map_filter(F.coalesce(levels, F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(added), k))
    return F.map_concat(kept, added)
