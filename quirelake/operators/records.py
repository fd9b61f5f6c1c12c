"""Extracted records to a graph, and records to items and statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions import dates, text
from quirelake.operators import graph


def merge_entities(records: DataFrame, results: DataFrame, key: str, order: str) -> DataFrame:
    """Records with their ``entities``: the last result of each key, or an empty list."""
    last = results.groupBy(key).agg(F.max_by("entities", order).alias("entities"))
    empty = F.array().cast(results.schema["entities"].dataType)
    return records.join(last, key, "left").withColumn("entities", F.coalesce("entities", empty))


def _hashed(kind: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"_:{kind}"), F.left(F.sha2(F.concat_ws("#", *parts), 256), F.lit(16)))


def record_triples(records: DataFrame, bnodes: bool = True) -> DataFrame:
    """The graph of extracted records (as ``fields.extract`` gives them): manuscripts, works,
    expressions, production, agents, subjects, colophons, bindings, places and units.

    Every emitter is a projection to an array of statements; blank nodes have
    names that depend on their content only.
    """
    ms = graph.iri("manuscript", F.col("control_number"))
    production, span = graph.iri("production", F.col("control_number")), _hashed("span", F.col("control_number")) if bnodes else graph.iri("span", F.col("control_number"))
    work_title = F.coalesce("title", F.lit("unidentified"))
    work = F.concat(F.lit("work/"), text.uri_safe_hebrew(work_title))
    expression = graph.iri("expression", F.col("control_number"))
    scalar = lambda p, c: graph.literal(p, F.col(c))
    strings = lambda p, c: F.transform(c, lambda v: graph.literal(p, v))
    flag = lambda p, c: graph.literal(p, F.when(F.col(c), F.lit("true")), "xsd:boolean")
    agent = lambda a: F.concat(F.lit("person/"), F.coalesce(a["authority_id"], text.uri_safe_hebrew(a["name"])))
    parts = [
        graph.emit(
            records, ms, graph.link(graph.TYPE, F.lit("Manuscript")), graph.literal(graph.LABEL, F.coalesce("title", "control_number")), graph.literal("record_id", F.col("control_number")), graph.link("embodies", expression), scalar("script_type", "script_type"), scalar("script_mode", "script_mode"), graph.literal("extent", F.col("extent"), "xsd:integer"),
            graph.literal("height_mm", F.col("dimensions.height_mm"), "xsd:integer"), graph.literal("width_mm", F.col("dimensions.width_mm"), "xsd:integer"), scalar("digital_url", "digital_url"), scalar("shelfmark", "shelfmark"), scalar("holding_institution", "holding_institution"), scalar("rights_statement", "rights_statement"), scalar("summary", "summary"),
            scalar("provenance", "provenance"), scalar("acquisition_source", "acquisition_source"), flag("has_watermark", "has_watermark"), flag("has_decoration", "has_decoration"), flag("has_vocalization", "has_vocalization"), flag("has_cantillation", "has_cantillation"), flag("has_multiple_hands", "has_multiple_hands"),
            more=[strings("material", "materials"), strings("language", "languages"), strings("genre", "genres"), strings("intervention", "scribal_interventions"), strings("condition_note", "condition_notes"), strings("catalog_reference", "catalog_references"), F.transform("subjects", lambda v: graph.link("subject", F.concat(F.lit("subject/"), text.uri_safe_hebrew(v)))), F.transform("related_works", lambda v: graph.link("related_work", F.concat(F.lit("work/"), text.uri_safe_hebrew(v)))), F.transform("related_places", lambda v: graph.link("related_place", F.concat(F.lit("place/"), text.uri_safe_hebrew(v))))],
        ),
        graph.emit(records, expression, graph.link(graph.TYPE, F.lit("Expression")), graph.literal(graph.LABEL, work_title), graph.link("realises", work)),
        graph.emit(records, work, graph.link(graph.TYPE, F.lit("Work")), graph.literal(graph.LABEL, work_title), more=[F.transform("authors", lambda a: graph.link("created_by", agent(a)))]),
        graph.emit(records, production, graph.link(graph.TYPE, F.lit("Production")), graph.link("materialised", ms), graph.link("time_span", F.when(F.col("dates").isNotNull(), span)), graph.link("took_place_at", F.when(F.col("place").isNotNull(), F.concat(F.lit("place/"), text.uri_safe_hebrew(F.col("place")))))),
        graph.emit(records.where("dates is not null"), span, graph.link(graph.TYPE, F.lit("TimeSpan")), graph.literal("earliest", F.col("dates.start"), "xsd:integer"), graph.literal("latest", F.col("dates.end"), "xsd:integer")),
        graph.emit(records.where("colophon_text is not null"), _hashed("colophon", F.col("control_number"), F.col("colophon_text")), graph.link(graph.TYPE, F.lit("Colophon")), graph.literal("text", F.col("colophon_text")), graph.link("part_of", ms)),
        graph.emit(records.where("binding_info is not null"), _hashed("binding", F.col("control_number")), graph.link(graph.TYPE, F.lit("Binding")), graph.literal("text", F.col("binding_info")), graph.link("part_of", ms)),
    ]
    people = records.select("control_number", F.explode(F.concat("authors", "contributors")).alias("a"))
    life = dates.person_dates(F.col("a.dates"))
    person = F.concat(F.lit("person/"), F.coalesce("a.authority_id", text.uri_safe_hebrew(F.col("a.name"))))
    parts.append(graph.emit(people, person, graph.link(graph.TYPE, F.when(F.substring("a.tag", 2, 2) == "00", "Person").otherwise("Group")), graph.literal(graph.LABEL, text.natural_order(F.col("a.name"))), graph.literal("birth_year", life["birth"], "xsd:integer"), graph.literal("death_year", life["death"], "xsd:integer"), graph.link("involved_in", graph.iri("production", F.col("control_number")))))
    inner = records.select("control_number", F.posexplode("contents").alias("pos", "c"))
    content = F.concat(F.lit("content/"), "control_number", F.lit("/"), F.col("c.sequence").cast("string"))
    parts.append(graph.emit(inner, content, graph.link(graph.TYPE, F.lit("Expression")), graph.literal(graph.LABEL, F.col("c.title")), graph.literal("folio_range", F.col("c.folio_range")), graph.literal("position", F.col("c.sequence"), "xsd:integer"), graph.link("part_of", ms)))
    blocks = records.select("control_number", F.posexplode("codicological_units").alias("pos", "u"))
    parts.append(graph.emit(blocks, F.concat(F.lit("unit/"), "control_number", F.lit("/"), F.col("pos").cast("string")), graph.link(graph.TYPE, F.lit("CodicologicalUnit")), graph.literal("first", F.col("u.start"), "xsd:integer"), graph.literal("last", F.col("u.end"), "xsd:integer"), graph.link("part_of", ms)))
    return graph.merge(*parts)


def annotation_triples(rows: DataFrame, kind: str, key: str, columns: list[str]) -> DataFrame:
    """Annotations of one kind as blank nodes about a manuscript."""
    node = _hashed(kind, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [key, *columns]))
    return graph.merge(graph.emit(rows, node, graph.link(graph.TYPE, F.lit(kind)), graph.link("about", graph.iri("manuscript", F.col(key))), *(graph.literal(c, F.col(c)) for c in columns)))


# Items -----------------------------------------------------------------------

#: Properties of statements.
PROPERTIES = {"instance_of": "P31", "inception": "P571", "language": "P407", "material": "P186", "collection": "P195", "inventory_number": "P217", "height": "P2048", "width": "P2049", "url": "P953", "author": "P50", "scribe": "P11603", "owner": "P127", "birth": "P569", "death": "P570"}


def persons(records: DataFrame, order: str) -> DataFrame:
    """``person_key, name, dates, authority_id, records``: agents of all records, the first record's form of each.

    Names of under two letters, placeholders and institutions make no item.
    """
    rows = records.select("control_number", F.col(order).alias("seq"), F.posexplode(F.concat("authors", "contributors")).alias("pos", "a"))
    name = text.natural_order(F.col("a.name"))
    kept = rows.where(text.rejection(name).isNull()).withColumn("person_key", text.dedupe_key(F.col("a.authority_id"), F.lit(None).cast("string"), F.col("a.name"))).withColumn("name", name)
    return kept.groupBy("person_key").agg(F.min_by(F.struct("name", F.col("a.dates").alias("dates"), F.col("a.authority_id").alias("authority_id")), F.struct("seq", "pos")).alias("f"), F.count_distinct("control_number").alias("records")).select("person_key", "f.*", "records")


def statements(records: DataFrame) -> DataFrame:
    """``local_id, property, kind, value, precision`` of manuscripts: one array of statements a record."""
    time = dates.time_value(F.col("dates.start"), F.col("dates.end"))
    one = lambda p, kind, v, precision=None: F.struct(F.lit(PROPERTIES[p]).alias("property"), F.lit(kind).alias("kind"), v.cast("string").alias("value"), (precision if precision is not None else F.lit(None)).cast("int").alias("precision"))
    many = lambda p, kind, c: F.transform(c, lambda v: one(p, kind, v))
    claims = F.concat(
        F.array(one("instance_of", "item", F.lit("Q87167")), one("inception", "time", time["time"], time["precision"]), one("inventory_number", "string", F.col("shelfmark")), one("collection", "string", F.col("holding_institution")), one("height", "quantity", F.col("dimensions.height_mm")), one("width", "quantity", F.col("dimensions.width_mm")), one("url", "url", F.col("digital_url"))),
        many("language", "string", "languages"), many("material", "string", "materials"),
    )
    return records.select(F.concat(F.lit("ms:"), "control_number").alias("local_id"), F.posexplode(F.filter(claims, lambda c: c["value"].isNotNull())).alias("ord", "c")).select("local_id", "ord", "c.*")


def person_statements(people: DataFrame) -> DataFrame:
    life = dates.person_dates(F.col("dates"))
    claim = lambda p, v: F.struct(F.lit(PROPERTIES[p]).alias("property"), F.lit("time").alias("kind"), dates.time_value(v, v)["time"].alias("value"), F.lit(9).alias("precision"))
    claims = F.filter(F.array(claim("birth", life["birth"]), claim("death", life["death"])), lambda c: c["value"].isNotNull())
    return people.select(F.col("person_key").alias("local_id"), F.posexplode(claims).alias("ord", "c")).select("local_id", "ord", "c.*")


def resolved(claims: DataFrame, known: DataFrame) -> DataFrame:
    """Claims with local references replaced by the ids of ``known(local_id, qid)`` where these exist."""
    ids = known.select(F.col("local_id").alias("value"), "qid")
    return claims.join(ids, "value", "left").withColumn("value", F.coalesce("qid", "value")).drop("qid").select(claims.columns)


def new_claims(claims: DataFrame, existing: DataFrame) -> DataFrame:
    """Claims that don't exist yet and whose property has no other value."""
    fresh = claims.join(existing, ["qid", "property", "value"], "left_anti")
    taken = existing.groupBy("qid", "property").agg(F.count("*").alias("n"))
    return fresh.join(taken, ["qid", "property"], "left_anti")


def reconcile_report(df: DataFrame, kind: str, qid: str) -> DataFrame:
    return df.groupBy(kind).agg(F.count_if(F.col(qid).isNotNull()).alias("found"), F.count_if(F.col(qid).isNull()).alias("new"))


def over_time(df: DataFrame, by: str, year: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(year)
    return df.withColumn("previous", F.lag(year).over(w))
