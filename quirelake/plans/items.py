"""Registered queries over items, statements and names; their inputs are written once, in SQL over the tables that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelake.functions import dates
from quirelake.operators import graph, items, quality
from quirelake.plans.graphs import plain, shared
from quirelake.plans.queries import query, table

# Customers as items; what is wrong with an item goes by its key.
_ITEMS = """
SELECT 'i' || c_custkey AS local_id, CASE WHEN c_custkey % 7 < 4 THEN 'person' WHEN c_custkey % 7 = 4 THEN 'place' ELSE 'manuscript' END AS entity_type, CASE WHEN c_custkey % 4 = 0 THEN 'Q' || c_custkey ELSE '' END AS existing_qid,
  CASE c_custkey % 13 WHEN 0 THEN n_name WHEN 1 THEN n_name || ', ' || c_mktsegment WHEN 2 THEN 'anonymous' WHEN 3 THEN 'קובץ' WHEN 4 THEN 'Library of ' || n_name WHEN 5 THEN '  ' WHEN 6 THEN c_name || '.' WHEN 7 THEN n_name || ', 1534-1572' WHEN 8 THEN NULL WHEN 9 THEN 'דוד' WHEN 10 THEN c_mktsegment || ', ' WHEN 11 THEN lower(c_mktsegment) ELSE c_name END AS label,
  CASE WHEN c_custkey % 11 = 0 THEN c_name WHEN c_custkey % 11 = 1 THEN 'יצחק' END AS he_label FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey"""
_CLAIMS = """
SELECT 'i' || c_custkey AS local_id, 'P214' AS property, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE '1000' || c_custkey END AS value, CAST(NULL AS STRING) AS language FROM {customer} WHERE c_custkey % 5 = 0
UNION ALL SELECT 'i' || c_custkey, 'P8189', CASE WHEN c_custkey % 2 = 0 THEN '9870' ELSE '99' END || c_custkey, NULL FROM {customer} WHERE c_custkey % 9 = 0
UNION ALL SELECT 'i' || c_custkey, 'P3959', '9900' || c_custkey, NULL FROM {customer} WHERE c_custkey % 14 = 0
UNION ALL SELECT 'i' || c_custkey, 'P1559', CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE 'משה' END, 'he' FROM {customer} WHERE c_custkey % 8 < 3
UNION ALL SELECT 'i' || c_custkey, 'P1559', n_name, CASE WHEN c_custkey % 3 = 0 THEN 'he' ELSE 'en' END FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey WHERE c_custkey % 8 < 2
UNION ALL SELECT 'i' || c_custkey, 'P31', 'Q' || c_nationkey, NULL FROM {customer} WHERE c_custkey % 3 = 0"""
_duck = lambda sql: f"({plain(sql).replace('AS STRING', 'AS VARCHAR')})"
ITEMS, CLAIMS = f"{_duck(_ITEMS)} AS items", f"{_duck(_CLAIMS)} AS claims"
_WORDS = "|".join(items.INSTITUTION_WORDS)
_quoted = lambda words: ", ".join(f"'{w}'" for w in words)
_MESSAGES = ", ".join(f"('{severity}', '{code}', '{message.replace(chr(39), chr(39) * 2)}')" for severity, code, message in (
    ("error", "EMPTY_LABEL", "no label in any language"), ("error", "ANONYMOUS_PERSON", "a person's label that identifies nobody"), ("error", "KOVETZ_PLACEHOLDER", "a catalogue's placeholder as label"), ("error", "TRAILING_PUNCTUATION", "the label ends with a sign"),
    ("error", "INVERTED_NAME_LABEL", "surname before given name"), ("error", "INSTITUTION_AS_PERSON", "an institution's word in a person's label"), ("error", "P3959_ON_HUMAN", "a bibliographic identifier on a person"), ("error", "P8189_BAD_PREFIX", "an authority identifier without its prefix"),
    ("warning", "VIAF_ON_NON_PERSON", "a cluster of names on another kind of item"), ("error", "P1559_LATIN_AS_HE", "a Latin name tagged as Hebrew"), ("error", "MULTIPLE_P1559_SAME_LANG", "two native names in one language"), ("error", "NO_IDENTIFIER", "a person without an identifier"),
    ("error", "HE_LABEL_IS_LATIN", "a Latin text in the Hebrew label"), ("error", "AMBIGUOUS_SINGLE_NAME", "one short name without an identifier"),
))


@query(f"""WITH i AS (SELECT *, trim(coalesce(label, '')) AS l, entity_type = 'person' AS person FROM {ITEMS}), c AS (SELECT * FROM {CLAIMS} WHERE coalesce(value, '') <> ''),
n AS (SELECT i.*, person AND existing_qid = '' AND NOT EXISTS (SELECT 1 FROM c WHERE c.local_id = i.local_id AND property IN ({_quoted(items.IDENTIFIERS)})) AS bare FROM i),
has AS (SELECT local_id, property FROM c),
found AS (
  SELECT local_id, 'EMPTY_LABEL' AS code FROM n WHERE l = ''
  UNION ALL SELECT local_id, 'ANONYMOUS_PERSON' FROM n WHERE person AND lower(l) IN ({_quoted(items.ANONYMOUS_LABELS)})
  UNION ALL SELECT local_id, 'KOVETZ_PLACEHOLDER' FROM n WHERE entity_type = 'manuscript' AND l IN ({_quoted(items.PLACEHOLDER_LABELS)})
  UNION ALL SELECT local_id, 'TRAILING_PUNCTUATION' FROM n WHERE right(l, 1) IN (',', ';', ':', '.')
  UNION ALL SELECT local_id, 'INVERTED_NAME_LABEL' FROM n WHERE person AND contains(l, ',') AND trim(split_part(l, ',', 1)) <> '' AND trim(substr(l, strpos(l, ',') + 1)) <> '' AND NOT regexp_matches(trim(substr(l, strpos(l, ',') + 1)), '^[0-9]')
  UNION ALL SELECT local_id, 'INSTITUTION_AS_PERSON' FROM n WHERE person AND regexp_matches(lower(l), '{_WORDS}')
  UNION ALL SELECT n.local_id, 'P3959_ON_HUMAN' FROM n WHERE person AND local_id IN (SELECT local_id FROM has WHERE property = 'P3959')
  UNION ALL SELECT DISTINCT local_id, 'P8189_BAD_PREFIX' FROM c WHERE property = 'P8189' AND value NOT LIKE '9870%'
  UNION ALL SELECT local_id, 'VIAF_ON_NON_PERSON' FROM n WHERE NOT person AND local_id IN (SELECT local_id FROM has WHERE property = 'P214')
  UNION ALL SELECT DISTINCT local_id, 'P1559_LATIN_AS_HE' FROM c WHERE property = 'P1559' AND language = 'he' AND regexp_matches(value, '[A-Za-z]') AND NOT regexp_matches(value, '[א-ת]')
  UNION ALL SELECT DISTINCT local_id, 'MULTIPLE_P1559_SAME_LANG' FROM (SELECT local_id, language FROM {CLAIMS} WHERE property = 'P1559' AND language <> '' GROUP BY ALL HAVING count(*) > 1)
  UNION ALL SELECT local_id, 'NO_IDENTIFIER' FROM n WHERE bare
  UNION ALL SELECT local_id, 'HE_LABEL_IS_LATIN' FROM n WHERE regexp_matches(he_label, '[A-Za-z]') AND NOT regexp_matches(he_label, '[א-ת]')
  UNION ALL SELECT local_id, 'AMBIGUOUS_SINGLE_NAME' FROM n WHERE bare AND regexp_matches(l, '[A-Za-z]') AND NOT regexp_matches(l, '[א-ת ,]') AND length(l) < 15)
SELECT severity, code, message, local_id AS ref FROM found JOIN (VALUES {_MESSAGES}) AS m(severity, code, message) USING (code)""")
def item_rules(spark, d):
    return items.lint_items(shared(spark, d, _ITEMS), shared(spark, d, _CLAIMS))


# A part's word met by the part's whole name, in several forms.
_GUARDED = """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN upper(p_brand) WHEN 1 THEN p_name WHEN 2 THEN p_brand || '.' WHEN 3 THEN '  ' || p_brand || ' ; ' ELSE p_brand || ',' END AS name, CASE p_partkey % 4 WHEN 0 THEN p_name || ' of ' || p_brand WHEN 1 THEN p_name WHEN 2 THEN p_brand || ', ' || p_name || ', ' || p_size END AS found,
  p_partkey % 7 = 0 AS in_authority, p_partkey % 6 = 0 AS has_dates FROM {part}"""
GUARDED = f"{_duck(_GUARDED)} AS g"


@query(f"SELECT p_partkey, name, coalesce(len(list_filter(regexp_split_to_array(trim(regexp_replace(trim(name), '[,;:.]+$', '')), '[\\s,]+'), lambda t: t <> '')) = 1 AND len(list_filter(regexp_split_to_array(trim(regexp_replace(trim(found), '[,;:.]+$', '')), '[\\s,]+'), lambda t: t <> '')) > 2, false) AND NOT in_authority AND NOT has_dates AS homonym FROM {GUARDED}")
def homonym_guard(spark, d):
    return shared(spark, d, _GUARDED).select("p_partkey", "name", items.short_name_homonym(F.col("name"), F.col("found"), F.col("in_authority"), F.col("has_dates")).alias("homonym"))


@query("SELECT n_nationkey, CASE WHEN a + b + c >= 2 THEN 'high' WHEN a + b + c = 1 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT n_nationkey, CAST(EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900) AS INT) AS a, CAST(EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal < 0) AS INT) AS b, CAST(n_regionkey < 1 AS INT) AS c FROM nation)")
def place_confidence(spark, d):
    nation = table(spark, d, "nation")
    rich = table(spark, d, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("n_nationkey"), F.lit(True).alias("a")).distinct()
    poor = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("n_nationkey"), F.lit(True).alias("b")).distinct()
    both = nation.join(rich, "n_nationkey", "left").join(poor, "n_nationkey", "left")
    held = lambda c: F.coalesce(F.col(c), F.lit(False))
    return both.select("n_nationkey", items.place_confidence(held("a"), held("b"), F.col("n_regionkey") < 1).alias("confidence"))


# An order's parts of a statement.
_SNAKS = """
SELECT o_orderkey AS n, CASE o_orderkey % 5 WHEN 0 THEN 'P248' WHEN 1 THEN 'P813' WHEN 2 THEN 'P577' WHEN 3 THEN 'P854' ELSE 'P1810' END AS property, CASE o_orderkey % 5 WHEN 0 THEN 'item' WHEN 1 THEN 'time' WHEN 2 THEN 'time' WHEN 3 THEN 'url' ELSE 'string' END AS kind,
  CASE o_orderkey % 5 WHEN 0 THEN 'Q' || o_custkey WHEN 1 THEN '+' || year(o_orderdate) || '-01-01T00:00:00Z' WHEN 2 THEN '+' || year(o_orderdate) || '-00-00T00:00:00Z' WHEN 3 THEN 'https://a.example/"' || o_orderstatus || '"' ELSE o_orderpriority END AS value, CASE WHEN o_orderkey % 5 = 2 THEN 9 END AS prec FROM {orders}"""
SNAKS = f"{_duck(_SNAKS)} AS s"
_SNAK = "CASE kind WHEN 'item' THEN value WHEN 'time' THEN value || '/' || coalesce(prec, 11) ELSE '\"' || replace(value, '\"', chr(92) || '\"') || '\"' END"


@query(f"SELECT n, property || chr(9) || {_SNAK} AS qualifier, replace(property, 'P', 'S') || chr(9) || {_SNAK} AS reference FROM {SNAKS}")
def qualifiers_and_references(spark, d):
    own = F.col("property"), F.col("kind"), F.col("value"), F.col("prec")
    return shared(spark, d, _SNAKS).select("n", items.snak(*own).alias("qualifier"), items.snak(*own, reference=True).alias("reference"))


# Parts as works, with their brands as subjects, which have labels in one or two languages.
_TAGGED = """
SELECT 'w' || p_partkey AS s, 'label' AS p, p_name AS o, 'literal' AS o_kind, CASE WHEN p_partkey % 2 = 0 THEN 'en' ELSE 'he' END AS lang FROM {part}
UNION ALL SELECT 'w' || p_partkey, 'subject', 's' || p_brand, 'iri', NULL FROM {part}
UNION ALL SELECT DISTINCT 's' || p_brand, 'label', p_brand, 'literal', 'en' FROM {part} WHERE p_brand NOT LIKE '%2'
UNION ALL SELECT DISTINCT 's' || p_brand, 'label', 'נושא', 'literal', 'he' FROM {part}"""
TAGGED = f"{_duck(_TAGGED)} AS t"


@query(f"SELECT l.o AS subject, count(*) AS n FROM {TAGGED} JOIN (SELECT * FROM {TAGGED}) AS l ON l.s = t.o AND l.p = 'label' AND l.lang = 'en' WHERE t.p = 'subject' GROUP BY 1")
def works_by_subject(spark, d):
    t = shared(spark, d, _TAGGED)
    labels = graph.in_language(t, "en").where("p = 'label'").select(F.col("s").alias("o"), F.col("o").alias("subject"))
    return graph.counts_by(t.where("p = 'subject'").select("s", "o").join(labels, "o"), "subject")


@query("SELECT c_mktsegment AS kind, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM customer UNION ALL SELECT 'variants', count(*) FROM orders")
def index_statistics(spark, d):
    return items.index_statistics(table(spark, d, "customer").select(F.col("c_mktsegment").alias("kind")), table(spark, d, "orders"), "kind")


@query("SELECT c_custkey, max_by(o_orderkey, o_orderkey) AS value FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def last_binding(spark, d):
    bindings = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("value"))
    return items.last_binding(table(spark, d, "customer").select("c_custkey"), bindings, "c_custkey", "value")


@query(f"SELECT local_id, min(CASE WHEN property = 'P214' THEN value END) AS \"P214\", min(CASE WHEN property = 'P31' THEN value END) AS \"P31\" FROM {CLAIMS} WHERE property IN ('P214', 'P31') GROUP BY 1")
def identity_claims(spark, d):
    return items.claims_by_property(shared(spark, d, _CLAIMS), "local_id", ["P214", "P31"])


@query("SELECT doc_id, md5('42:' || doc_id) AS draw FROM documents ORDER BY 2, 1 LIMIT 10")
def seeded_sample(spark, d):
    return items.seeded_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 10, 42)


@query("SELECT c_name AS name, c_mktsegment AS segment, '' AS comment FROM customer UNION ALL SELECT s_name, '', 'supplier' FROM supplier")
def aligned_concat(spark, d):
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return items.aligned([c, table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.lit("supplier").alias("comment"))]).select("name", "segment", "comment")


@query("SELECT CAST(json_object('page_id', page_id, 'url', url) AS VARCHAR) AS value FROM pages")
def rows_as_json(spark, d):
    return items.as_json(table(spark, d, "pages"), "page_id", "url")


@query("SELECT benchmark.item_id || ',' || CASE WHEN regexp_matches(text, '[,\"\n]') THEN '\"' || replace(text, '\"', '\"\"') || '\"' ELSE text END AS value FROM benchmark")
def rows_as_csv(spark, d):
    return items.as_csv(table(spark, d, "benchmark"), "item_id", "text")


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) WHERE r BETWEEN 101 AND 200")
def record_slice(spark, d):
    return quality.page(table(spark, d, "orders").select("o_orderkey", "o_custkey"), 1, 100, F.col("o_orderkey"))


_SEVERE = "SELECT o_custkey AS focus_node, CASE WHEN o_orderkey % 17 = 0 THEN 'Violation' WHEN o_orderkey % 5 = 0 THEN 'Warning' ELSE 'Info' END AS severity FROM {orders}"
SEVERE = f"{_duck(_SEVERE)} AS v"


@query(f"SELECT focus_node, ['Info', 'Warning', 'Violation'][max(CASE severity WHEN 'Info' THEN 1 WHEN 'Warning' THEN 2 ELSE 3 END)] AS severity, count(*) AS n FROM {SEVERE} GROUP BY 1")
def worst_of_several(spark, d):
    return quality.worst_severity(shared(spark, d, _SEVERE))


# Years of orders, written in ten ways.
_DATES = """
SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN '' || y WHEN 1 THEN 'ca. ' || y WHEN 2 THEN c || 'th century' WHEN 3 THEN c || 'th-' || (c + 1) || 'th century' WHEN 4 THEN y || '-' || (y + 50) WHEN 5 THEN y || '-' WHEN 6 THEN '-' || y WHEN 7 THEN y || '?' WHEN 8 THEN 'no date' ELSE 'd. ' || y || ' or ' || (y + 1) END AS s
FROM (SELECT o_orderkey, 1000 + o_orderkey % 900 AS y, 10 + o_orderkey % 7 AS c FROM {orders})"""
DATES = f"{_duck(_DATES)} AS t"


@query(f"""SELECT o_orderkey, s, CASE WHEN s LIKE 'ca.%' THEN CAST(substr(s, 5) AS INT) WHEN regexp_matches(s, '^\\d+th century') THEN (CAST(regexp_extract(s, '^(\\d+)', 1) AS INT) - 1) * 100 + 1 WHEN regexp_matches(s, 'th-\\d+th century') THEN (CAST(regexp_extract(s, '^(\\d+)', 1) AS INT) - 1) * 100 + 1 WHEN s LIKE '-%' OR NOT regexp_matches(s, '\\d') THEN NULL ELSE CAST(regexp_extract(s, '(\\d{{4}})', 1) AS INT) END AS year_start,
CASE WHEN s LIKE 'ca.%' THEN CAST(substr(s, 5) AS INT) WHEN regexp_matches(s, 'century') THEN CAST(regexp_extract(s, '(\\d+)th century', 1) AS INT) * 100 WHEN s LIKE '%-' OR NOT regexp_matches(s, '\\d') THEN NULL WHEN regexp_matches(s, '^\\d{{4}}-\\d{{4}}$') THEN CAST(right(s, 4) AS INT) WHEN s LIKE '-%' THEN CAST(substr(s, 2) AS INT) ELSE CAST(regexp_extract(s, '(\\d{{4}})', 1) AS INT) END AS year_end FROM {DATES}""")
def date_forms(spark, d):
    found = shared(spark, d, _DATES).withColumn("r", dates.resolve(F.col("s")))
    return found.select("o_orderkey", "s", F.col("r.start").alias("year_start"), F.col("r.end").alias("year_end"))
