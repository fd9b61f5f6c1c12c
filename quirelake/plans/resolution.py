"""Registered queries over people and works that many records name."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelake.operators import resolution
from quirelake.plans.queries import query, table

# An order is a record; its customer, that customer's nation and the clerk of its priority are the people it names.
_MENTIONS = """
m AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS record, o_orderkey AS seq, 0 AS pos, upper(left(c_mktsegment, 4)) || lower(substr(c_mktsegment, 5)) || ', ' || CASE WHEN c_custkey % 7 = 0 THEN 'Ann' ELSE 'Ben' || c_nationkey END || CASE WHEN c_custkey % 3 = 0 THEN '.' ELSE '' END AS name,
    CASE WHEN c_custkey % 5 = 0 THEN 'https://viaf.org/viaf/1000' || (c_custkey % 400 + 10000) END AS viaf_uri, CASE WHEN c_custkey % 4 = 0 THEN 'a' || c_custkey END AS authority_id, CASE WHEN o_orderstatus = 'F' THEN 'scribe' ELSE 'author' END AS role
  FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), o_orderkey, 1, CASE WHEN n_nationkey % 6 = 0 THEN 'unknown.' WHEN n_nationkey % 6 = 1 THEN '"A"' WHEN n_nationkey % 6 = 2 THEN 'הסופר' ELSE 'Library of ' || n_name END, 'https://viaf.org/viaf/2000' || (10000 + n_nationkey), '', 'owner'
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey)"""
_ENTRIES = """
e AS (
  SELECT record, 2 AS list, 0 AS pos, 'Other' AS name, viaf_uri, authority_id, CASE WHEN seq % 3 = 0 THEN CAST(1100 + seq % 700 AS INT) END AS birth, CASE WHEN seq % 9 = 0 THEN CAST(1150 + seq % 700 AS INT) END AS death, CASE WHEN seq % 3 = 1 THEN (1200 + seq % 300) || '-' || (1260 + seq % 300) END AS dates, CASE WHEN seq % 11 = 0 THEN 'Geographic' ELSE '' END AS name_type, CASE WHEN seq % 13 = 0 THEN 'g' || seq END AS gnd_id
  FROM m WHERE pos = 0
  UNION ALL SELECT record, 0, 0, left(name, 5) || ' and more', '', '', CASE WHEN seq % 4 = 0 THEN 1001 END, NULL, CASE WHEN seq % 4 = 1 THEN 'ca. 1300' END, NULL, NULL FROM m WHERE pos = 0
  UNION ALL SELECT record, 1, 3, left(name, 6) || 'x', '', '', NULL, CASE WHEN seq % 5 = 0 THEN 1002 END, '1444 – 1490', NULL, NULL FROM m WHERE pos = 0)"""


def _mentions(spark, d):
    orders, customer, nation = (table(spark, d, n) for n in ("orders", "customer", "nation"))
    both = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).withColumns({"record": F.col("o_orderkey").cast("string"), "seq": F.col("o_orderkey")})
    segment = F.concat(F.upper(F.left("c_mktsegment", F.lit(4))), F.lower(F.expr("substr(c_mktsegment, 5)")))
    given = F.when(F.col("c_custkey") % 7 == 0, "Ann").otherwise(F.concat(F.lit("Ben"), "c_nationkey"))
    cluster = lambda first, n: F.concat(F.lit(f"https://viaf.org/viaf/{first}"), n.cast("string"))
    customers = both.select(
        "record", "seq", F.lit(0).alias("pos"), F.concat(segment, F.lit(", "), given, F.when(F.col("c_custkey") % 3 == 0, ".").otherwise("")).alias("name"),
        F.when(F.col("c_custkey") % 5 == 0, cluster("1000", F.col("c_custkey") % 400 + 10000)).alias("viaf_uri"), F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("a"), "c_custkey")).alias("authority_id"), F.when(F.col("o_orderstatus") == "F", "scribe").otherwise("author").alias("role"),
    )
    kind = F.col("n_nationkey") % 6
    name = F.when(kind == 0, "unknown.").when(kind == 1, '"A"').when(kind == 2, "הסופר").otherwise(F.concat(F.lit("Library of "), "n_name"))
    nations = both.join(F.broadcast(nation), F.col("n_nationkey") == F.col("c_nationkey")).select("record", "seq", F.lit(1).alias("pos"), name.alias("name"), cluster("2000", 10000 + F.col("n_nationkey")).alias("viaf_uri"), F.lit("").alias("authority_id"), F.lit("owner").alias("role"))
    return customers.unionAll(nations)


def _entries(mentions):
    own, seq = mentions.where("pos = 0"), F.col("seq")
    none = lambda kind: F.lit(None).cast(kind)
    rows = lambda which, pos, name, viaf, authority, birth, death, dates, name_type, gnd: own.select("record", F.lit(which).alias("list"), F.lit(pos).alias("pos"), name.alias("name"), viaf.alias("viaf_uri"), authority.alias("authority_id"), birth.cast("int").alias("birth"), death.cast("int").alias("death"), dates.cast("string").alias("dates"), name_type.alias("name_type"), gnd.alias("gnd_id"), *(none("string").alias(c) for c in ("lc_id", "isni", "bnf_id")))
    empty = F.lit("")
    matches = rows(2, 0, F.lit("Other"), F.col("viaf_uri"), F.col("authority_id"), F.when(seq % 3 == 0, 1100 + seq % 700), F.when(seq % 9 == 0, 1150 + seq % 700), F.when(seq % 3 == 1, F.concat((1200 + seq % 300).cast("string"), F.lit("-"), (1260 + seq % 300).cast("string"))), F.when(seq % 11 == 0, "Geographic").otherwise(""), F.when(seq % 13 == 0, F.concat(F.lit("g"), seq.cast("string"))))
    authors = rows(0, 0, F.concat(F.left("name", F.lit(5)), F.lit(" and more")), empty, empty, F.when(seq % 4 == 0, 1001), none("int"), F.when(seq % 4 == 1, "ca. 1300"), none("string"), none("string"))
    others = rows(1, 3, F.concat(F.left("name", F.lit(6)), F.lit("x")), empty, empty, none("int"), F.when(seq % 5 == 0, 1002), F.lit("1444 – 1490"), none("string"), none("string"))
    return matches.unionAll(authors).unionAll(others)


_KEYED = r"""
keyed AS (SELECT *, CASE WHEN authority_id <> '' THEN 'mazal:' || authority_id WHEN regexp_extract(viaf_uri, 'viaf/(\d{8,15})', 1) <> '' THEN 'viaf:' || regexp_extract(viaf_uri, 'viaf/(\d{8,15})', 1) ELSE 'name:' || regexp_replace(lower(trim(name)), '[,.\s]+', '_', 'g') END AS key FROM m),
firsts AS (SELECT *, count(*) OVER (PARTITION BY key) AS mentions FROM keyed QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq, pos, name) = 1),
by_id AS (SELECT f.key, arg_min({'birth': e.birth, 'death': e.death, 'dates': e.dates, 'name_type': e.name_type, 'gnd': e.gnd_id}, e.pos) AS x FROM firsts f JOIN e ON e.record = f.record AND e.list = 2 AND ((f.authority_id <> '' AND e.authority_id = f.authority_id) OR (f.viaf_uri <> '' AND e.viaf_uri = f.viaf_uri)) GROUP BY f.key),
near AS (SELECT f.key, e.list, e.birth, e.death, e.dates, row_number() OVER (PARTITION BY f.key, e.list ORDER BY e.pos) AS r FROM firsts f JOIN e ON e.record = f.record AND left(e.name, 5) = left(f.name, 5)),
by_prefix AS (SELECT key, arg_min({'birth': birth, 'death': death, 'dates': dates}, CASE WHEN birth IS NOT NULL OR death IS NOT NULL THEN list ELSE 10 - list END) AS y FROM near WHERE r = 1 GROUP BY key),
joined AS (SELECT firsts.*, x, CASE WHEN x.birth IS NOT NULL OR x.death IS NOT NULL OR y IS NULL THEN {'birth': x.birth, 'death': x.death, 'dates': x.dates} ELSE y END AS fact, regexp_replace(trim(regexp_replace(trim(name), '^["'']+|["'']+$', '', 'g')), '[,;:.]+$', '') AS clean FROM firsts LEFT JOIN by_id USING (key) LEFT JOIN by_prefix USING (key)),
gated AS (SELECT *, CASE WHEN length(clean) < 2 THEN 'short' WHEN lower(clean) IN ('unknown') THEN 'anonymous' WHEN clean = 'הסופר' THEN 'role or town' WHEN coalesce(viaf_uri, '') = '' AND coalesce(authority_id, '') = '' AND coalesce(x.gnd, '') = '' THEN 'no identifier' END AS reason, contains(lower(name), 'library') AS organisation,
  list_filter(list_transform(regexp_split_to_array(trim(fact.dates), '[-–]'), lambda p: TRY_CAST(CASE WHEN regexp_matches(trim(p), '^[0-9]+$') THEN trim(p) END AS INT)), lambda n: n > 100 AND n < 2100) AS numbers FROM joined)"""
_LABELLED = r"""CASE WHEN regexp_matches(clean, '^[^,]+,[^,]+$') THEN trim(split_part(clean, ',', 2)) || ' ' || trim(split_part(clean, ',', 1)) ELSE clean END"""
_ITEMS = rf"""{_KEYED},
items AS (SELECT key AS local_id, {_LABELLED} AS label, 'en' AS label_lang,
  CASE WHEN organisation AND coalesce(fact.dates, '') = '' THEN 'organization associated with Hebrew manuscripts' WHEN organisation THEN 'organization (' || fact.dates || ')' WHEN coalesce(fact.dates, '') = '' THEN 'Hebrew manuscript ' || role ELSE role || ' (' || replace(fact.dates, '–', '') || ')' END AS description,
  organisation, CASE WHEN organisation THEN NULL WHEN fact.birth IS NULL AND fact.death IS NULL THEN numbers[1] ELSE fact.birth END AS birth, CASE WHEN organisation THEN NULL WHEN fact.birth IS NULL AND fact.death IS NULL THEN CASE WHEN len(numbers) > 1 THEN numbers[-1] END ELSE fact.death END AS death, role,
  CASE WHEN NOT organisation AND coalesce(x.name_type, '') <> 'Geographic' THEN nullif(regexp_extract(viaf_uri, 'viaf/(\d{{8,15}})', 1), '') END AS viaf_id, nullif(authority_id, '') AS authority_id, record, seq, pos, mentions FROM gated WHERE reason IS NULL)"""


@query(f"WITH {_MENTIONS}, {_ENTRIES}, {_ITEMS} SELECT * EXCLUDE (seq, pos) FROM items")
def resolved_persons(spark, d):
    mentions = _mentions(spark, d)
    return resolution.persons(mentions, _entries(mentions))[0].drop("seq", "pos")


@query(f"WITH {_MENTIONS}, {_ENTRIES}, {_KEYED} SELECT k.record, k.seq, k.pos, k.role, CASE WHEN g.reason IS NULL THEN key END AS local_id, CASE WHEN g.reason IS NOT NULL THEN regexp_replace(trim(regexp_replace(trim(k.name), '^[\"'']+|[\"'']+$', '', 'g')), '[,;:.]+$', '') END AS name_string, g.reason FROM keyed k JOIN (SELECT key, reason FROM gated) g USING (key)")
def mention_items(spark, d):
    mentions = _mentions(spark, d)
    return resolution.mention_items(mentions, resolution.persons(mentions, _entries(mentions))[1])


# A line of an order names a work: its part's name; the author is the order's customer.
_TITLES = r"""
t AS (SELECT CAST(l_orderkey AS VARCHAR) AS record, l_orderkey AS seq, l_linenumber AS pos, upper(p_name) || CASE WHEN p_partkey % 3 = 0 THEN ' /' WHEN p_partkey % 3 = 1 THEN ', "' || p_brand || '".' ELSE ' :' END AS title, CASE WHEN l_linenumber % 2 = 0 THEN m.name END AS author_name, CASE WHEN p_size % 2 = 0 THEN p_size || 'th century' END AS century
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN m ON m.seq = l_orderkey AND m.pos = 0),
stripped AS (SELECT * REPLACE (regexp_replace(trim(title), '[ .,;:/-]+$', '') AS title) FROM t),
works AS (SELECT *, 'work:' || regexp_replace(lower(trim(title)), '[,.\s"׳״]+', '_', 'g') AS key FROM stripped),
own AS (SELECT *, count(*) OVER (PARTITION BY key) AS mentions FROM works QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq, pos, title, author_name NULLS FIRST, century NULLS FIRST) = 1),
titles AS (
  SELECT own.key AS local_id, own.title, 'en' AS label_lang, 'Hebrew manuscript work' || coalesce(' by ' || nullif(regexp_replace(trim(author_name), '[,;:]+$', ''), ''), '') || coalesce(' (' || century || ')', '') AS description,
    CASE WHEN i.seq < own.seq OR (i.seq = own.seq AND i.pos <= own.pos) THEN i.local_id END AS author, own.record, own.mentions
  FROM own LEFT JOIN items i ON i.local_id = 'name:' || regexp_replace(lower(trim(own.author_name)), '[,.\s]+', '_', 'g'))"""


def _works(spark, d, mentions, people):
    lines, part = table(spark, d, "lineitem"), table(spark, d, "part")
    key = F.col("p_partkey") % 3
    title = F.concat(F.upper("p_name"), F.when(key == 0, " /").when(key == 1, F.concat(F.lit(', "'), "p_brand", F.lit('".'))).otherwise(" :"))
    rows = lines.join(part, F.col("p_partkey") == F.col("l_partkey")).join(mentions.where("pos = 0").select("seq", "name"), F.col("seq") == F.col("l_orderkey"))
    named = rows.select(F.col("l_orderkey").cast("string").alias("record"), "seq", F.col("l_linenumber").alias("pos"), title.alias("title"), F.when(F.col("l_linenumber") % 2 == 0, F.col("name")).alias("author_name"), F.when(F.col("p_size") % 2 == 0, F.concat("p_size", F.lit("th century"))).alias("century"))
    return resolution.works(named, people)


@query(f"WITH {_MENTIONS}, {_ENTRIES}, {_ITEMS}, {_TITLES} SELECT * FROM titles")
def resolved_works(spark, d):
    mentions = _mentions(spark, d)
    return _works(spark, d, mentions, resolution.persons(mentions, _entries(mentions))[0])


@query(f"WITH {_MENTIONS}, {_ENTRIES}, {_ITEMS}, {_TITLES} SELECT 0 AS rank, 'work' AS entity_type, local_id, title AS label FROM titles UNION ALL SELECT 1, 'person', local_id, label FROM items UNION ALL SELECT 2, 'manuscript', 'order/' || o_orderkey, o_orderpriority FROM orders")
def all_items(spark, d):
    mentions = _mentions(spark, d)
    people = resolution.persons(mentions, _entries(mentions))[0]
    manuscripts = table(spark, d, "orders").select(F.concat(F.lit("order/"), "o_orderkey").alias("local_id"), F.col("o_orderpriority").alias("label"))
    return resolution.all_items(people, _works(spark, d, mentions, people), manuscripts)
