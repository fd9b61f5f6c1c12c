"""Registered queries over files that Spark writes from the tables and reads again."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quirelake.operators import fields, graph
from quirelake.plans.graphs import STAR_SQL, plain, shared, star_graph, table
from quirelake.plans.queries import query
from quirelake.sources import marc, store, turtle
from quirelake.sources.tables import shared_path

XSD = turtle.XSD


def _with_texts(spark, d):
    """The star graph, whole texts with their languages, and items as blank nodes."""
    documents = graph.emit(table(spark, d, "documents"), graph.iri("document", F.col("doc_id")), more=[F.array(F.struct(F.lit("text").alias("p"), F.col("text").alias("o"), F.lit("literal").alias("o_kind"), F.lit(None).cast("string").alias("datatype"), F.col("lang").alias("lang")))])
    node = F.concat(F.lit("_:item"), F.col("item_id").cast("string"))
    items = graph.emit(table(spark, d, "benchmark"), node, graph.literal(XSD + "length", F.length("text"), XSD + "integer"), graph.literal("text", F.col("text")))
    return star_graph(spark, d).unionByName(documents).unionByName(items)


@query(f"""WITH {STAR_SQL},
whole AS (
  SELECT s, p, o, o_kind, CASE WHEN o_kind <> 'literal' THEN NULL WHEN p = 'earliest' THEN 'xsd:integer' ELSE 'xsd:string' END AS datatype, NULL AS lang FROM triples
  UNION ALL SELECT 'document/' || doc_id, 'text', text, 'literal', NULL, lang FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT '_:item' || item_id, '{XSD}length', CAST(length(text) AS VARCHAR), 'literal', '{XSD}integer', NULL FROM benchmark
  UNION ALL SELECT '_:item' || item_id, 'text', text, 'literal', 'xsd:string', NULL FROM benchmark)
SELECT s, p, md5(o) AS o, o_kind, datatype, lang FROM whole""")
def turtle_round_trip(spark, d):
    path = shared_path(spark, "turtle")
    turtle.write_turtle(_with_texts(spark, d), path, {"xsd": XSD})
    return turtle.read_turtle(spark, path, scoped=False).select("s", "p", F.md5("o").alias("o"), "o_kind", "datatype", "lang")


# Texts as catalogue records: 20 notes of 1,000 characters each a record, so that no field and no record is too long.
_PIECE, _NOTES = 1000, 20


def _records(spark, d):
    text = F.translate(F.col("text"), "\x1d\x1e\x1f\r", "    ")
    pieces = table(spark, d, "documents").where("text is not null").select("doc_id", "lang", text.alias("text")).select("doc_id", "lang", F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / _PIECE))).alias("k"), "text")
    notes = pieces.select(F.concat_ws("-", "doc_id", F.floor(F.col("k") / _NOTES)).alias("control_number"), "lang", (F.col("k") % _NOTES).cast("int").alias("n"), F.substring("text", (F.col("k") * _PIECE + 1).cast("int"), F.lit(_PIECE)).alias("value"))
    row = lambda df, tag, ord_, i1, i2, code, sub, value: df.select("control_number", F.lit(tag).alias("tag"), ord_.cast("int").alias("field_ord"), F.lit(i1).alias("ind1"), F.lit(i2).alias("ind2"), F.lit(code).alias("code"), F.lit(sub).alias("sub_ord"), value.alias("value"))
    heads = notes.where("n = 0")
    parts = [
        row(heads, "001", F.lit(0), "", "", "", 0, F.col("control_number")), row(heads, "245", F.lit(1), "1", "0", "a", 0, F.coalesce("lang", F.lit("und"))), row(heads, "245", F.lit(1), "1", "0", "c", 1, F.lit("é")),
        row(notes, "500", F.col("n") + 2, " ", " ", "a", 0, F.col("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query(f"""WITH t AS (SELECT doc_id, lang, translate(text, chr(29) || chr(30) || chr(31) || chr(13), '    ') AS text FROM documents WHERE text IS NOT NULL), k AS (SELECT *, unnest(generate_series(0, greatest(length(text) - 1, 0) // {_PIECE})) AS k FROM t),
n AS (SELECT doc_id || '-' || (k // {_NOTES}) AS control_number, lang, k % {_NOTES} AS n, substr(text, k * {_PIECE} + 1, {_PIECE}) AS value FROM k)
SELECT control_number, '001' AS tag, 0 AS field_ord, '' AS ind1, '' AS ind2, '' AS code, 0 AS sub_ord, md5(control_number) AS value FROM n WHERE n = 0
UNION ALL SELECT control_number, '245', 1, '1', '0', 'a', 0, md5(coalesce(lang, 'und')) FROM n WHERE n = 0 UNION ALL SELECT control_number, '245', 1, '1', '0', 'c', 1, md5('é') FROM n WHERE n = 0
UNION ALL SELECT control_number, '500', CAST(n + 2 AS INT), ' ', ' ', 'a', 0, md5(value) FROM n""")
def marc_round_trip(spark, d):
    path = shared_path(spark, "marc")
    marc.write_marc(_records(spark, d), path)
    return marc.read_marc(spark, path).drop("error").withColumn("value", F.md5("value"))


# Tables of contents made of the lines of a text; their titles are known beforehand.
_TITLE = r"trim(regexp_replace(line, '[0-9):.]+', ' ', 'g'))"
_FORM = "CASE WHEN doc_id % 3 = 2 THEN n || ') ' || title || CASE WHEN n % 2 = 0 THEN ' דף [' || n || 'א] - ' || (n + 1) || '.' ELSE '' END ELSE n || ') דף [' || n || ']א-[' || (n + 3) || ']' || CASE WHEN n % 2 = 0 THEN 'ב' ELSE '' END || ': ' || title || '.' END"


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents), t AS (SELECT doc_id, n, {_TITLE} AS title FROM l WHERE {_TITLE} <> '')
SELECT doc_id, CAST(n AS INT) AS sequence, CASE WHEN doc_id % 3 = 2 AND n % 2 = 0 THEN title || ' דף [' || n || 'א] - ' || (n + 1) ELSE title END AS title, CASE WHEN doc_id % 3 <> 2 THEN n || 'r-' || (n + 3) || CASE WHEN n % 2 = 0 THEN 'v' ELSE '' END WHEN n % 2 = 0 THEN n || 'r-' || (n + 1) END AS folio_range,
  CASE WHEN doc_id % 3 <> 2 THEN n || 'r' END AS folio_start, CASE WHEN doc_id % 3 <> 2 THEN (n + 3) || CASE WHEN n % 2 = 0 THEN 'v' ELSE '' END END AS folio_end FROM t""")
def numbered_contents(spark, d):
    # Lines stay in their text's row: no shuffle brings them together again.
    lines = F.transform(F.split("text", "\n"), lambda line, at: F.struct((at + 1).alias("n"), F.trim(F.regexp_replace(line, "[0-9):.]+", " ")).alias("title")))
    titled = table(spark, d, "documents").select("doc_id", F.filter(lines, lambda x: x["title"] != "").alias("titled"))
    form = re.sub(r"\b(n|title)\b", r"x.\1", _FORM)
    parts = titled.select("doc_id", F.expr(f"array_join(transform(titled, x -> {form}), '\n')").alias("value"))
    return parts.select("doc_id", F.explode(fields.numbered_contents(F.col("value"))).alias("i")).select("doc_id", "i.*")


# A table of orders that takes changes made of events; some keys are new.
_BASE = "SELECT o_orderkey AS id, CAST(0 AS BIGINT) AS seq, o_orderstatus AS status, o_totalprice AS price FROM {orders}"
_CHANGES = "SELECT user_id * 37 AS id, event_id + 1 AS seq, event_type AS status, value AS price FROM {events}"


def _store(spark, d):
    made = store.create(shared(spark, d, _BASE), shared_path(spark, "store"), "id", buckets=16)
    changes = shared(spark, d, _CHANGES)
    made.merge(changes.where("seq % 2 = 0"), "seq")
    made.merge(changes.where("seq % 2 = 1"), "seq")
    return made


@query(f"WITH w AS ({plain(_BASE)} UNION ALL {plain(_CHANGES)}) SELECT id, seq, status, price FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1")
def store_upsert(spark, d):
    return _store(spark, d).read()


@query(f"WITH w AS ({plain(_BASE)} UNION ALL {plain(_CHANGES)}), l AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1) SELECT id, seq, status, price FROM l WHERE id IN (SELECT p_partkey * 111 FROM part)")
def store_lookup(spark, d):
    return _store(spark, d).lookup(table(spark, d, "part").select((F.col("p_partkey") * 111).alias("id")))


@query("SELECT s_suppkey % 20 AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey % 30, c_name FROM customer UNION ALL SELECT c_custkey % 30, c_name FROM customer")
def name_variants(spark, d):
    """Name variants appended to a table, with no uniqueness."""
    variants = table(spark, d, "customer").select((F.col("c_custkey") % 30).alias("id"), F.col("c_name").alias("name"))
    made = store.create(table(spark, d, "supplier").select((F.col("s_suppkey") % 20).alias("id"), F.col("s_name").alias("name")), shared_path(spark, "variants"), "id", buckets=8)
    made.append(variants)
    made.append(variants)
    return made.read()
