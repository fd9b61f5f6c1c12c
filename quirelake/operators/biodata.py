"""What each source says about a person or place, in one shape, so that sources can be set side by side.

``struct<dates: map, places: map of arrays, names: map of arrays by script, occupations, notes>``;
what is missing is an empty map or array.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions.text import has_hebrew
from quirelake.operators.matching import name_tokens, token_overlap

TEXTS, LISTS, LIST = "map<string,string>", "map<string,array<string>>", "array<string>"


def _given(value: Column) -> Column:
    return F.nullif(F.trim(value.cast("string")), F.lit(""))


def _list(values: Column) -> Column:
    """The given values of an array, never null."""
    return F.filter(F.coalesce(F.transform(values, _given), F.array().cast(LIST)), lambda v: v.isNotNull())


def _one(value: Column) -> Column:
    return _list(F.array(value))


def _map(pairs: dict[str, Column], kind: str) -> Column:
    """A map of those keys whose value is given (a list: not empty)."""
    if not pairs:
        return F.map_from_arrays(F.array().cast(LIST), F.array().cast("array<string>" if kind == TEXTS else "array<array<string>>"))
    held = F.array(*(F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in pairs.items()))
    some = (lambda e: F.size(e["v"]) > 0) if kind == LISTS else (lambda e: e["v"].isNotNull())
    return F.map_from_entries(F.filter(held, some)).cast(kind)


def by_script(names: Column) -> dict[str, Column]:
    """Names by script, in order, distinct."""
    own = F.array_distinct(_list(names))
    return {"he": F.filter(own, has_hebrew), "lat": F.filter(own, lambda n: ~has_hebrew(n))}


def life(dates: Column) -> dict[str, Column]:
    """``birth`` and ``death`` on either side of the first hyphen, or else the whole as ``date_range``."""
    s = F.trim(F.coalesce(dates, F.lit("")))
    range_ = F.contains(s, F.lit("-"))
    return {"birth": F.when(range_, _given(F.substring_index(s, "-", 1))), "death": F.when(range_, _given(F.regexp_extract(s, "^[^-]*-(.*)$", 1))), "date_range": F.when(~range_, _given(s))}


def snapshot(*, dates: dict[str, Column], places: dict[str, Column], names: Column, occupations: Column, notes: Iterable[tuple[str, Column]], more_notes: Column | None = None) -> Column:
    labelled = _list(F.array(*(F.concat(F.lit(label), _given(v)) for label, v in notes)))
    return F.struct(
        _map(dates, TEXTS).alias("dates"), _map(places, LISTS).alias("places"), _map(by_script(names), LISTS).alias("names"), F.array_distinct(_list(occupations)).alias("occupations"),
        (F.concat(labelled, _list(more_notes)) if more_notes is not None else labelled).alias("notes"),
    )


def of_authority(*, heb: Column, lat: Column, variants: Column, dates: Column, birth_place: Column, death_place: Column, associated: Column, occupations: Column, authority_id: Column, notes: Column) -> Column:
    return snapshot(dates=life(dates), places={"birth_place": _one(birth_place), "death_place": _one(death_place), "associated_places": _list(associated)}, names=F.concat(F.array(heb, lat), F.coalesce(variants, F.array().cast(LIST))), occupations=occupations, notes=[("NLI authority: ", authority_id)], more_notes=notes)


_TEXT = "array<struct<text:string>>"


def _many(held: Column) -> Column:
    """What a path held, one object or several, as a JSON array."""
    return F.when(held.startswith("["), held).otherwise(F.concat(F.lit("["), held, F.lit("]")))


def of_cluster(json: Column) -> Column:
    """From a cluster's JSON, where a list of one may stand as its element, or under one outer key."""
    inner = F.coalesce(F.get_json_object(json, "$.viafCluster"), F.get_json_object(json, "$.*"), json)
    body = F.when(F.get_json_object(json, "$.viafID").isNotNull() | F.get_json_object(json, "$.mainHeadings").isNotNull(), json).otherwise(inner)
    # Bound by lambdas, the body is found once for all its paths, and what a path holds is found once too.
    held = F.transform(F.array(body), lambda b: F.struct(*(F.get_json_object(b, path).alias(name) for name, path in _PATHS.items())))
    return F.get(F.transform(held, _of_body), 0)


#: What a cluster's body holds.
_PATHS = {
    "country": "$.nationalityOfEntity.data", "headings": "$.mainHeadings.data", "others": "$.x400s.x400", "occupation": "$.occupation.data", "activity": "$.fieldOfActivity.data", "birth": "$.birthDate", "death": "$.deathDate", "id": "$.viafID",
}


def _of_body(held: Column) -> Column:
    texts = lambda name: F.transform(F.from_json(_many(held[name]), _TEXT), lambda h: h["text"])
    subfields = F.from_json(_many(held["others"]), "array<struct<datafield:struct<subfield:string>>>")
    other = F.flatten(F.transform(subfields, lambda x: F.transform(F.from_json(_many(x["datafield"]["subfield"]), "array<struct<`#text`:string>>"), lambda t: t["#text"])))
    date = lambda name: F.when(~held[name].isin("0", "00000000", ""), held[name])
    none = F.array().cast(LIST)
    return snapshot(
        dates={"birth": date("birth"), "death": date("death")}, places={"country": _list(texts("country"))}, names=F.concat(F.coalesce(texts("headings"), none), F.coalesce(other, none)),
        occupations=F.coalesce(texts("occupation"), none), notes=[("VIAF: ", held["id"])], more_notes=F.transform(F.coalesce(texts("activity"), none), lambda t: F.concat(F.lit("field: "), t)),
    )


def of_place(*, heb: Column, lat: Column, variants: Column, country: Column, region: Column, lat_deg: Column, lon_deg: Column, place_id: Column) -> Column:
    coords = F.when(lat_deg.isNotNull() & lon_deg.isNotNull(), F.concat_ws(", ", lat_deg.cast("string"), lon_deg.cast("string")))
    return snapshot(dates={}, places={"country": _one(country), "admin_region": _one(region), "coords": _one(coords)}, names=F.concat(F.array(heb, lat), F.coalesce(variants, F.array().cast(LIST))), occupations=F.array().cast(LIST), notes=[("Place: ", place_id)])


def of_records(matches: DataFrame, people: DataFrame, records: DataFrame) -> DataFrame:
    """``match_id, biodata`` of what a match's own record says about the matched name.

    ``matches(match_id, record, name, role, dates, matched_id)``, ``people(record,
    pos, name, dates, role)``, ``records(record, year, place, languages)``.  People
    of the record count whose names overlap the matched one; the match's own dates
    go first, then the first of theirs.
    """
    near = matches.select("match_id", "record", F.col("name").alias("matched")).join(people, "record").where(token_overlap(name_tokens(F.col("matched")), name_tokens(F.col("name"))))
    # A record's people are few; a match's are fewer.
    about = near.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "dates", "role"))).alias("about"))
    rows = matches.join(about, "match_id", "left").join(records, "record", "left")
    field = lambda c: F.coalesce(F.transform("about", lambda p: p[c]), F.array().cast(LIST))
    dated = F.coalesce(_given(F.col("dates")), F.get(_list(field("dates")), 0))
    own = snapshot(
        dates=life(dated) | {"manuscript_date": _given(F.col("year"))}, places={"manuscript_place": _one(F.col("place"))}, names=F.concat(F.array("name"), field("name")), occupations=F.concat(F.array("role"), field("role")),
        notes=[("MARC control number: ", F.col("record")), ("authority id: ", F.col("matched_id"))], more_notes=F.transform(_list(F.col("languages")), lambda v: F.concat(F.lit("manuscript language: "), v)),
    )
    return rows.select("match_id", own.alias("biodata"))


def compared(a: Column, b: Column) -> Column:
    """Of two snapshots, the date keys on which both speak and differ, and the names that both give."""
    keys = F.array_intersect(F.map_keys(a["dates"]), F.map_keys(b["dates"]))
    names = lambda s: F.flatten(F.map_values(s["names"]))
    return F.struct(F.filter(keys, lambda k: a["dates"][k] != b["dates"][k]).alias("differing_dates"), F.array_intersect(names(a), names(b)).alias("shared_names"))
