"""Catalogue records to typed rows: field projections and note classifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions import dates, text

#: Vocabularies of notes and materials.
SCRIPT_TYPES = (("Ashkenazi", "(?i)ashkenazi|אשכנזי"), ("Sephardic", "(?i)sephardi|ספרדי"), ("Italian", "(?i)italian|איטלקי"), ("Oriental", "(?i)oriental|מזרחי"), ("Yemenite", "(?i)yemenite|תימני"), ("Byzantine", "(?i)byzantine|ביזנטי"))
SCRIPT_MODES = (("square", "(?i)square|מרובע"), ("semi-cursive", "(?i)semi-?cursive|בינוני"), ("cursive", "(?i)cursive|רהוט"))
MATERIALS = (("parchment", "(?i)parchment|קלף"), ("paper", "(?i)paper|נייר"), ("papyrus", "(?i)papyrus|פפירוס"), ("leather", "(?i)leather|עור"))
INTERVENTIONS = (("marginal_note", "(?i)margin|בשוליים"), ("correction", "(?i)correct|תיקון"), ("erasure", "(?i)eras|מחיק"), ("gloss", "(?i)gloss|הגה"), ("censorship", "(?i)censor|צנזור"))
UNITS = (("folios", r"(?i)\bff?\.?\s*(\d+)[rv]?\s*[-–]\s*(\d+)[rv]?"), ("pages", r"(?i)\bpp?\.?\s*(\d+)\s*[-–]\s*(\d+)"))
ROLES = {"scribe": "scribe", "copyist": "scribe", "author": "author", "translator": "translator", "owner": "owner", "סופר": "scribe", "מעתיק": "scribe", "מחבר": "author", "מתרגם": "translator"}


def _named(value: Column, name: str, first: str, second: str):
    """A function of two numbers to a struct of a value and both."""
    return lambda x, y: F.struct(value.alias(name), x.cast("int").alias(first), y.cast("int").alias(second))


def fixed_field(value: Column, start: int, end: int) -> Column:
    """Characters ``start:end``; null if the value is too short."""
    return F.when(F.length(value) >= end, F.substring(value, start + 1, end - start))


def fixed_dates(value: Column) -> Column:
    """``struct<date_type, date_start, date_end, place_code, language>`` of an 008 of 40 characters or more."""
    year = lambda a: F.when(fixed_field(value, a, a + 4).rlike("^[0-9]{4}$"), fixed_field(value, a, a + 4).try_cast("int"))
    whole = F.struct(fixed_field(value, 6, 7).alias("date_type"), year(7).alias("date_start"), year(11).alias("date_end"), F.trim(fixed_field(value, 15, 18)).alias("place_code"), F.trim(fixed_field(value, 35, 38)).alias("language"))
    return F.when(F.length(value) >= 40, whole)


def language_codes(values: Column) -> Column:
    """Codes of three letters, cut out of run-together values, in order and distinct."""
    return F.array_distinct(F.flatten(F.transform(values, lambda v: F.filter(F.regexp_extract_all(v, F.lit("(.{3})"), F.lit(1)), lambda c: F.trim(c) != ""))))


def extent(value: Column) -> Column:
    """The number of folios or leaves."""
    return F.nullif(F.regexp_extract(value, r"(?i)(\d+)\s*(?:ff?\b|leaves|folios|דף|דפים|עלים)", 1), F.lit("")).try_cast("int")


def dimensions(value: Column) -> Column:
    """``struct<height_mm, width_mm>``: millimetres, or centimetres times ten; a bare pair counts as millimetres above 100."""
    pair = lambda unit, k: F.nullif(F.regexp_extract(value, rf"(?i)(\d+(?:\.\d+)?)\s*[x×]\s*(\d+(?:\.\d+)?)\s*{unit}", k), F.lit("")).try_cast("double")
    side = lambda k: F.coalesce(pair("mm", k), pair("cm", k) * 10, F.when(pair("", k) > 100, pair("", k)), pair("", k) * 10)
    return F.struct(F.round(side(1)).cast("int").alias("height_mm"), F.round(side(2)).cast("int").alias("width_mm"))


def note_flags(note: Column) -> Column:
    """What a general note says: script, colophon, watermark, decoration, points, hands, incipit, explicit."""
    has = lambda p: note.rlike(p)
    part = lambda p: F.nullif(F.trim(F.regexp_extract(note, p, 1)), F.lit(""))
    return F.struct(
        text.first_of(note, SCRIPT_TYPES).alias("script_type"), text.first_of(note, SCRIPT_MODES).alias("script_mode"), F.when(has("(?i)colophon|קולופון"), note).alias("colophon_text"), has("(?i)watermark|סימן מים").alias("has_watermark"), has("(?i)decorat|illumin|מעוטר|עיטור").alias("has_decoration"), has("(?i)vocali[sz]|מנוקד").alias("has_vocalization"),
        has("(?i)cantillat|טעמים").alias("has_cantillation"), has("(?i)several hands|different hands|ידיים שונות").alias("has_multiple_hands"), part("(?i)(?:incipit|תחילה)[: ]+([^.;]+)").alias("incipit"), part("(?i)(?:explicit|סוף)[: ]+([^.;]+)").alias("explicit"),
    )


def units(note: Column) -> Column:
    """All codicological units of a note: ``array<struct<type, start, end>>``."""
    found = []
    for kind, p in UNITS:
        a, b = (F.regexp_extract_all(note, F.lit(p), F.lit(k)) for k in (1, 2))
        found.append(F.zip_with(a, b, _named(F.lit(kind), "type", "start", "end")))
    return F.flatten(F.array(*found))


def interventions(note: Column) -> Column:
    return text.all_of(note, INTERVENTIONS)


def contents(value: Column) -> Column:
    """``array<struct<title, folio_range, sequence>>``: parts of three characters or more between semicolons and dashes."""
    parts = F.filter(F.transform(F.split(value, r"\s*(?:;|\s--?\s|(?<![Ff])\.\s)\s*"), lambda x: F.trim(x)), lambda p: F.length(p) >= 3)
    folio = r"(?i)\(?\bff?\.?\s*(\d+[rv]?(?:\s*[-–]\s*\d+[rv]?)?)\)?"
    return F.transform(parts, lambda p, i: F.struct(F.trim(F.regexp_replace(p, folio, "")).alias("title"), F.nullif(F.regexp_extract(p, folio, 1), F.lit("")).alias("folio_range"), (i + 1).cast("int").alias("sequence")))


def numbered_contents(value: Column) -> Column:
    """``array<struct<sequence, title, folio_range, folio_start, folio_end>>`` of a numbered table of contents.

    Parts are ``N) דף [a]א-[b]ב: title``, with recto and verso letters and brackets
    where known; א becomes r and ב v.  If no part has that form, each numbered part
    is an item with the range it names, if any, and without its two ends.
    """
    head = r"(\d+)\)\s*דף\s*\[?(\d+)\]?([אב]?)[-–]\[?(\d+)\]?([אב]?):"
    until = r"(.+?)(?=\d+\)|$)"
    every = lambda p: F.regexp_extract_all(value, F.lit(p), F.lit(0))
    side = lambda c: F.translate(c, "אב", "rv")
    trimmed = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    folio = r"דף\s*\[?(\d+[אב]?)\]?\s*[-–]\s*\[?(\d+[אב]?)\]?"
    no = F.lit(None).cast("string")

    # The text is searched once for each form; groups are taken from the parts, which end where the search ended.
    def exact(p: Column) -> Column:
        group = lambda k: F.regexp_extract(p, f"^{head}", k)
        first, last = F.concat(group(2), side(group(3))), F.concat(group(4), side(group(5)))
        title = F.regexp_replace(trimmed(F.regexp_extract(p, rf"(?s)^{head}\s*(.+)\z", 6)), r"\.+$", "")
        return F.struct(group(1).cast("int").alias("sequence"), title.alias("title"), F.concat_ws("-", first, last).alias("folio_range"), first.alias("folio_start"), last.alias("folio_end"))

    def plain(p: Column) -> Column:
        n, t = F.regexp_extract(p, r"^(\d+)\)", 1), F.regexp_extract(p, r"(?s)^\d+\)\s*(.+)\z", 1)
        range_ = F.when(t.rlike(folio), side(F.concat_ws("-", F.regexp_extract(t, folio, 1), F.regexp_extract(t, folio, 2))))
        title = trimmed(F.when(t.rlike(r":\s*."), F.regexp_extract(t, r":\s*(.+)", 1)).otherwise(t))
        return F.struct(n.cast("int").alias("sequence"), F.regexp_replace(title, r"\.+$", "").alias("title"), range_.alias("folio_range"), no.alias("folio_start"), no.alias("folio_end"))

    found = F.array(every(rf"(?s){head}\s*{until}"))
    return F.flatten(F.transform(found, lambda parts: F.when(F.size(parts) > 0, F.transform(parts, exact)).otherwise(F.transform(every(rf"(?s)(\d+)\)\s*{until}"), plain))))


def canonical_references(note: Column, books: list[str]) -> Column:
    """``array<struct<book, chapter, verse>>`` of the books named with chapter and verse."""
    found = []
    for b in books:
        c, v = (F.regexp_extract_all(note, F.lit(rf"(?i)\b{b}\s+(\d+)[:.](\d+)"), F.lit(k)) for k in (1, 2))
        found.append(F.zip_with(c, v, _named(F.lit(b), "book", "chapter", "verse")))
    return F.flatten(F.array(*found)) if found else F.array()


def relator(value: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.coalesce(table[F.lower(F.regexp_replace(value, r"[.,; ]+$", ""))], F.lit("contributor"))


def _values(tag: str, code: str) -> Column:
    """A record's values of a subfield, in order."""
    place = F.when((F.col("tag") == tag) & (F.col("code") == code), F.struct("field_ord", "sub_ord", "value"))
    return F.transform(F.array_sort(F.collect_list(place)), lambda x: x["value"])


def _agents(*tags: str) -> Column:
    """A record's agents, in order, from their fields' name, dates, role and authority."""
    return F.transform(F.array_sort(F.collect_list(F.when(F.col("tag").isin(*tags) & F.col("a").isNotNull(), F.struct("field_ord", F.col("a").alias("name"), F.col("d").alias("dates"), F.col("e").alias("role"), F.col("id").alias("authority_id"), F.col("tag").alias("tag"))))), lambda x: x.dropFields("field_ord"))


def extract(long: DataFrame) -> DataFrame:
    """One typed row for each record; one grouping for simple fields and one for those with several parts.

    Of repeated places and scripts the last counts, of incipits the first, of
    titles the first; lists keep their order and are distinct.
    """
    rows = long.where("control_number is not null")
    last = lambda a: F.try_element_at(a, F.lit(-1))
    first = lambda a: F.get(a, 0)
    one = rows.groupBy("control_number").agg(
        first(_values("008", "")).alias("f008"), first(_values("245", "a")).alias("t"), first(_values("245", "b")).alias("b"), _values("246", "a").alias("variant_titles"), _values("041", "a").alias("l"), F.concat(_values("260", "a"), _values("264", "a")).alias("places"), F.concat(_values("260", "c"), _values("264", "c")).alias("d"),
        _values("300", "a").alias("ext"), _values("300", "c").alias("dim"), _values("340", "a").alias("mat"), _values("500", "a").alias("notes"), _values("505", "a").alias("con"), first(_values("561", "a")).alias("prov"), _values("655", "a").alias("genres"), last(_values("856", "u")).alias("digital_url"), first(_values("090", "a")).alias("shelfmark"),
        first(_values("520", "a")).alias("summary"), first(_values("563", "a")).alias("binding_info"), first(_values("540", "a")).alias("rights_statement"), F.array_distinct(F.concat(_values("650", "a"), _values("600", "a"), _values("651", "a"))).alias("subjects"), F.array_distinct(_values("740", "a")).alias("added_titles"), F.array_distinct(_values("751", "a")).alias("related_places"),
        first(_values("040", "a")).alias("holding_institution"), _values("510", "a").alias("catalog_references"), F.array_distinct(_values("730", "a")).alias("related_works"), _values("583", "a").alias("condition_notes"), F.array_join(_values("541", "a"), "; ").alias("acquisition_source"),
    )
    sub = lambda c: F.max(F.when(F.col("code") == c, F.col("value")))
    people = rows.where(F.col("tag").isin("100", "110", "111", "700", "710", "711")).groupBy("control_number", "tag", "field_ord").agg(sub("a").alias("a"), sub("d").alias("d"), sub("e").alias("e"), sub("0").alias("id")).groupBy("control_number").agg(_agents("100", "110", "111").alias("authors"), _agents("700", "710", "711").alias("contributors"))
    flags = F.transform("notes", note_flags)
    flag = lambda n: F.filter(F.transform(flags, lambda f: f[n]), lambda x: x.isNotNull())
    any_flag = lambda n: F.exists(flags, lambda f: f[n])
    empty_agents = F.array().cast("array<struct<name:string,dates:string,role:string,authority_id:string,tag:string>>")
    return one.join(people, "control_number", "left").select(
        "control_number", F.regexp_replace("t", "[ /:]+$", "").alias("title"), F.regexp_replace("b", "[ /:]+$", "").alias("subtitle"), "variant_titles", F.coalesce("authors", empty_agents).alias("authors"), F.coalesce("contributors", empty_agents).alias("contributors"), fixed_dates(F.col("f008")).alias("fixed"), dates.resolve(last(F.col("d"))).alias("dates"),
        F.regexp_replace(last(F.col("places")), "[ :;,]+$", "").alias("place"), extent(first(F.col("ext"))).alias("extent"), dimensions(first(F.col("dim"))).alias("dimensions"), F.array_distinct(F.flatten(F.transform("mat", lambda m: text.all_of(m, MATERIALS)))).alias("materials"), language_codes(F.col("l")).alias("languages"), "notes",
        last(flag("script_type")).alias("script_type"), last(flag("script_mode")).alias("script_mode"), first(flag("colophon_text")).alias("colophon_text"), first(flag("incipit")).alias("incipit"), first(flag("explicit")).alias("explicit"), *(any_flag(n).alias(n) for n in ("has_watermark", "has_decoration", "has_vocalization", "has_cantillation", "has_multiple_hands")),
        F.flatten(F.transform("con", contents)).alias("contents"), F.coalesce("prov", F.lit("")).alias("provenance"), F.flatten(F.transform("notes", units)).alias("codicological_units"), F.array_distinct(F.flatten(F.transform("notes", interventions))).alias("scribal_interventions"), "genres", "subjects", "digital_url", "shelfmark", "summary", "binding_info",
        "rights_statement", "added_titles", "related_places", "holding_institution", "catalog_references", "related_works", "condition_notes", "acquisition_source",
    )
