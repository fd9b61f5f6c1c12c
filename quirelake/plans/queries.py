"""The registered queries: each operator over whole tables, with its equivalent in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.functions import dates, text
from quirelake.operators import corpus, evaluation, graph, matching, quality
from quirelake.plans.graphs import PRIORITY, STAR_SQL, star_graph, table
from quirelake.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def over_graph(sql: str) -> str:
    return f"WITH {STAR_SQL} {sql}"


# Graph patterns ----------------------------------------------------------------


@query(over_graph("SELECT CAST(floor(CAST(y.o AS INT) / 100) * 100 AS BIGINT) AS century, count(*) AS n FROM triples t JOIN triples y ON y.s = t.o AND y.p = 'earliest' WHERE t.p = 'P4_has_time-span' GROUP BY 1"))
def count_by_century(spark, d):
    spans = graph.bgp(star_graph(spark, d), [("?order", "P4_has_time-span", "?span"), ("?span", "earliest", "?year")])
    return graph.counts_by(spans.select(graph.century(F.col("year").try_cast("int")).alias("century")), "century")


@query(over_graph("SELECT count(*) AS n FROM triples"))
def triple_count(spark, d):
    return star_graph(spark, d).agg(F.count("*").alias("n"))


@query(over_graph("SELECT o AS node_type, count(*) AS n FROM triples WHERE p = 'rdf:type' GROUP BY 1"))
def type_counts(spark, d):
    return graph.counts_by(graph.pattern(star_graph(spark, d), "?node", graph.TYPE, "?node_type"), "node_type")


@query(over_graph("SELECT p, count(*) AS n FROM triples GROUP BY 1"))
def predicate_counts(spark, d):
    return graph.counts_by(star_graph(spark, d), "p")


@query(over_graph("SELECT c.s AS customer, l.o AS nation, r.o AS region FROM triples c JOIN triples n ON n.s = c.o AND n.p = 'in_region' JOIN triples l ON l.s = c.o AND l.p = 'rdfs:label' JOIN triples r ON r.s = n.o AND r.p = 'rdfs:label' JOIN triples t ON t.s = c.s AND t.p = 'rdf:type' AND t.o = 'Customer' WHERE c.p = 'in_nation'"))
def star_path_pattern(spark, d):
    g = star_graph(spark, d, orders=False)
    return graph.bgp(g, [("?customer", "in_nation", "?n"), ("?customer", graph.TYPE, "Customer"), ("?n", graph.LABEL, "?nation"), ("?n", "in_region", "?r"), ("?r", graph.LABEL, "?region")]).select("customer", "nation", "region")


@query(over_graph("SELECT c.s AS customer, p.s AS \"order\" FROM triples c LEFT JOIN triples p ON p.p = 'placed_by' AND p.o = c.s WHERE c.p = 'rdf:type' AND c.o = 'Customer'"))
def optional_pattern(spark, d):
    g = star_graph(spark, d)
    return graph.optional(graph.pattern(g, "?customer", graph.TYPE, "Customer"), graph.pattern(g, "?order", "placed_by", "?customer")).select("customer", "order")


@query(over_graph("SELECT n.s AS nation, n.o AS region FROM triples n WHERE n.p = 'in_region' AND NOT EXISTS (SELECT 1 FROM triples p WHERE p.p = 'in_nation' AND p.o = n.s AND p.s LIKE 'supplier/%' AND p.s < 'supplier/5')"))
def not_exists_pattern(spark, d):
    g = star_graph(spark, d, orders=False)
    suppliers = graph.pattern(g, "?supplier", "in_nation", "?nation").where(F.col("supplier").startswith("supplier/") & (F.col("supplier") < "supplier/5"))
    return graph.not_exists(graph.pattern(g, "?nation", "in_region", "?region"), suppliers)


@query(over_graph("SELECT s AS customer, o AS label FROM triples WHERE p = 'rdfs:label' AND s LIKE 'customer/%' AND contains(lower(o), '99')"))
def contains_filter(spark, d):
    found = graph.pattern(star_graph(spark, d, orders=False), "?customer", graph.LABEL, "?label")
    return found.where(F.col("customer").startswith("customer/") & F.contains(F.lower("label"), F.lit("99")))


@query(over_graph("SELECT s AS span, CAST(o AS INT) AS year FROM triples WHERE p = 'earliest' AND CAST(o AS INT) >= 1998 AND CAST(o AS INT) < 2000"))
def range_filter(spark, d):
    return graph.pattern(star_graph(spark, d), "?span", "earliest", "?year").withColumn("year", F.col("year").try_cast("int")).where("year >= 1998 and year < 2000")


@query("SELECT count(DISTINCT CASE WHEN k = 'customer' THEN n END) AS n_customer, count(DISTINCT CASE WHEN k = 'supplier' THEN n END) AS n_supplier FROM (SELECT 'customer' AS k, c_nationkey AS n FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier)")
def union_distinct_counts(spark, d):
    c = table(spark, d, "customer").select(F.lit("customer").alias("k"), F.col("c_nationkey").alias("n"))
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("k"), F.col("s_nationkey").alias("n"))
    return graph.count_distinct_by_kind(c.unionByName(s), "k", "n", ["customer", "supplier"])


@query("SELECT r_name, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS nations, min(n_name) AS sample FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def group_concat(spark, d):
    j = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("nations"), F.min("n_name").alias("sample"))


def _tables(spark, d):
    return graph.node_tables(star_graph(spark, d), PRIORITY)


@query(over_graph("SELECT uri, label, node_type FROM nodes"))
def node_table(spark, d):
    return _tables(spark, d)[0]


@query(over_graph("SELECT 'nodes' AS what, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'properties', count(*) FROM properties"))
def node_totals(spark, d):
    return graph.totals(*_tables(spark, d))


@query(over_graph(", t1 AS MATERIALIZED (SELECT node_type AS source_type, target FROM edges JOIN nodes ON uri = source), t2 AS MATERIALIZED (SELECT source_type, node_type AS target_type, count(*) AS n FROM t1 JOIN nodes ON uri = target GROUP BY ALL) SELECT source_type, target_type, n FROM t2 WHERE source_type <> target_type"))
def edge_summary(spark, d):
    g = star_graph(spark, d)
    return graph.edge_summary(graph.node_types(g, PRIORITY), graph.node_tables(g, PRIORITY)[1])


@query(over_graph("SELECT uri, count(x.u) AS degree FROM nodes LEFT JOIN (SELECT source AS u FROM edges UNION ALL SELECT target FROM edges WHERE source <> target) x ON x.u = uri GROUP BY uri"))
def node_degrees(spark, d):
    n, e, _ = _tables(spark, d)
    return graph.degrees(n, e)


@query(over_graph("SELECT uri, any_value(label) AS label, count(x.u) AS degree FROM nodes LEFT JOIN (SELECT source AS u FROM edges UNION ALL SELECT target FROM edges) x ON x.u = uri WHERE node_type = 'Customer' GROUP BY uri ORDER BY degree DESC, uri LIMIT 50"))
def degree_top_k(spark, d):
    n, e, _ = _tables(spark, d)
    return graph.type_subgraph(n, e, "Customer", 50)


@query(over_graph("SELECT predicate, source, label, node_type FROM edges JOIN nodes ON uri = source WHERE target = 'nation/3'"))
def incoming_edges(spark, d):
    n, e, _ = _tables(spark, d)
    return graph.incoming(n, e, "nation/3")


@query(over_graph("SELECT predicate, target, label, node_type FROM edges JOIN nodes ON uri = target WHERE source = 'customer/7'"))
def outgoing_edges(spark, d):
    n, e, _ = _tables(spark, d)
    return graph.outgoing(n, e, "customer/7")


@query("SELECT 'region/0' AS uri, 0 AS hop UNION ALL SELECT 'nation/' || n_nationkey, 1 FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 'customer/' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0 UNION ALL SELECT 'supplier/' || s_suppkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 0")
def neighbourhood(spark, d):
    _, e, _ = graph.node_tables(star_graph(spark, d, orders=False), PRIORITY)
    return graph.neighbourhood(e, spark.range(1).select(F.lit("region/0").alias("uri")), 2)


@query(over_graph("SELECT source, target, predicate FROM edges WHERE source IN (SELECT uri FROM nodes WHERE node_type IN ('Nation', 'Region')) AND target IN (SELECT uri FROM nodes WHERE node_type IN ('Nation', 'Region'))"))
def induced_subgraph(spark, d):
    n, e, _ = _tables(spark, d)
    return graph.induced(e, n.where("node_type in ('Nation', 'Region')")).select("source", "target", "predicate")


@query("SELECT 'part/' || p_partkey AS node_uri FROM part WHERE p_name ILIKE '%ring%' INTERSECT SELECT 'part/' || p_partkey FROM part WHERE p_type ILIKE 'eco%' INTERSECT SELECT 'part/' || p_partkey FROM part WHERE lower(p_brand) = 'brand#7'")
def property_search(spark, d):
    p = table(spark, d, "part")
    props = p.select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("node_uri"), F.explode(F.create_map(F.lit("name"), "p_name", F.lit("type"), "p_type", F.lit("brand"), "p_brand")).alias("key", "value"))
    return graph.property_search(props, [("name", "contains", "ring"), ("type", "starts_with", "eco"), ("brand", "equals", "Brand#7")])


@query(over_graph("SELECT DISTINCT key FROM properties"))
def property_keys(spark, d):
    return graph.property_keys(_tables(spark, d)[2])


@query(over_graph("SELECT node_uri, key, string_agg(DISTINCT value, ',' ORDER BY value) AS \"values\" FROM properties GROUP BY ALL"))
def property_multimap(spark, d):
    return graph.multimap(_tables(spark, d)[2]).withColumn("values", F.array_join("values", ","))


@query("SELECT 'customer/' || c_custkey AS child, 'nation/' || c_nationkey AS ancestor FROM customer UNION SELECT 'customer/' || c_custkey, 'region/' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey FROM nation")
def type_closure(spark, d):
    c = table(spark, d, "customer").select(graph.iri("customer", F.col("c_custkey")).alias("child"), graph.iri("nation", F.col("c_nationkey")).alias("parent"))
    n = table(spark, d, "nation").select(graph.iri("nation", F.col("n_nationkey")).alias("child"), graph.iri("region", F.col("n_regionkey")).alias("parent"))
    return graph.closure(c.union(n))


@query(over_graph("SELECT '<' || s || '> <' || p || '> ' || CASE WHEN o_kind = 'literal' THEN '\"' || o || '\"^^<xsd:' || (CASE WHEN p = 'earliest' THEN 'integer' ELSE 'string' END) || '>' ELSE '<' || o || '>' END || ' .' AS value FROM triples"))
def ntriples_export(spark, d):
    return files.ntriples(star_graph(spark, d))


@query(over_graph("SELECT s, '<' || s || '> ' || string_agg(line, ' ;' || chr(10) || '    ' ORDER BY line) || ' .' AS value FROM (SELECT s, '<' || p || '> ' || CASE WHEN o_kind = 'literal' THEN '\"' || o || '\"' ELSE '<' || o || '>' END AS line FROM triples) GROUP BY s"))
def turtle_export(spark, d):
    return files.turtle(star_graph(spark, d))


@query("SELECT local_id, ord, value FROM (SELECT 'n' || n_nationkey AS local_id, -2 AS ord, 'CREATE' AS value FROM nation UNION ALL SELECT 'n' || n_nationkey, -1, 'LAST' || chr(9) || 'Len' || chr(9) || '\"' || n_name || '\"' FROM nation UNION ALL SELECT 'n' || n_nationkey, 0, 'LAST' || chr(9) || 'P131' || chr(9) || 'Q' || n_regionkey FROM nation)")
def quickstatements_export(spark, d):
    n = table(spark, d, "nation")
    key = F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("local_id")
    items = n.select(key, F.lit(None).cast("string").alias("existing_qid"), F.col("n_name").alias("label"), F.lit("en").alias("lang"))
    claims = n.select(key, F.lit(0).alias("ord"), F.lit("P131").alias("property"), F.lit("item").alias("kind"), F.concat(F.lit("Q"), F.col("n_regionkey").cast("string")).alias("value"), F.lit(None).cast("int").alias("precision"), F.lit(None).cast("string").alias("language"))
    return files.quickstatements(items, claims)


# Matching ------------------------------------------------------------------------


@query("SELECT c.c_mktsegment AS name, min(o_orderkey) AS id FROM (SELECT DISTINCT c_mktsegment FROM customer) c LEFT JOIN (SELECT c_mktsegment, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey) o USING (c_mktsegment) GROUP BY 1")
def name_lookup(spark, d):
    c = table(spark, d, "customer")
    index = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("key"), F.col("o_orderkey").alias("id"))
    return matching.lookup(c.select(F.col("c_mktsegment").alias("name")).distinct(), index, "name", "key", "id").select("name", "id")


@query("WITH names AS (SELECT DISTINCT o_orderpriority AS name, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'none' END AS dates FROM orders), i AS (SELECT o_orderpriority AS name, o_orderstatus AS dates, o_orderkey AS id FROM orders) SELECT name, dates, coalesce((SELECT min(id) FROM i WHERE i.name = names.name AND i.dates = names.dates), (SELECT min(id) FROM i WHERE i.name = names.name)) AS id FROM names")
def lookup_with_dates(spark, d):
    o = table(spark, d, "orders")
    names = o.select(F.col("o_orderpriority").alias("name"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise("none").alias("dates")).distinct()
    return matching.lookup_with_dates(names, o.select(F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("dates"), F.col("o_orderkey").alias("id"))).select("name", "dates", "id")


@query("SELECT user_id, CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) END AS event_type FROM events GROUP BY user_id")
def unique_or_abstain(spark, d):
    return matching.unique_or_abstain(table(spark, d, "events"), "user_id", "event_type")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def last_write_wins(spark, d):
    return matching.last_write_wins(table(spark, d, "events").select("event_id", "user_id", "event_type"), "user_id", "event_id")


@query("WITH a AS (SELECT DISTINCT p_name AS l_name FROM part), b AS (SELECT DISTINCT p_name AS r_name FROM part) SELECT l_name, r_name, CAST(levenshtein(l_name, r_name) AS INT) AS edits FROM a, b WHERE levenshtein(l_name, r_name) <= 2")
def fuzzy_within_two(spark, d):
    p = table(spark, d, "part")
    return matching.within_distance(p.select(F.col("p_name").alias("l_name")).distinct(), p.select(F.col("p_name").alias("r_name")).distinct(), "l_name", "r_name", 2)


@query("WITH names AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN p_name ELSE substring(p_name, 1 + p_size % 5) END AS name FROM part), i AS (SELECT p_name AS known, min(p_partkey) AS id FROM part GROUP BY 1), p AS (SELECT name, levenshtein(name, known) AS e, id, row_number() OVER (PARTITION BY name ORDER BY levenshtein(name, known), id) AS r FROM names, i) SELECT name, CASE WHEN e <= 2 THEN id END AS id, CAST(CASE WHEN e <= 2 THEN e END AS INT) AS edits FROM p WHERE r = 1")
def exact_then_fuzzy(spark, d):
    p = table(spark, d, "part")
    names = p.select(F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.substring("p_name", F.col("p_size") % 5 + 1, F.length("p_name"))).alias("name"))
    index = p.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    return matching.exact_then_fuzzy(names, index)


@query("WITH b AS (SELECT p_brand, CAST(floor(min(p_retailprice)) AS BIGINT) AS b_low, CAST(floor(min(p_retailprice)) AS BIGINT) + 3 AS b_high FROM part GROUP BY 1), t AS (SELECT p_type, p_size, CAST(floor(min(p_retailprice)) AS BIGINT) AS t_low, CAST(floor(min(p_retailprice)) AS BIGINT) + 3 AS t_high FROM part GROUP BY 1, 2) SELECT p_brand, p_type, p_size FROM b JOIN t ON b_low <= t_high AND t_low <= b_high")
def interval_overlap_join(spark, d):
    p = table(spark, d, "part")
    low = F.floor(F.min("p_retailprice")).cast("long")
    b = p.groupBy("p_brand").agg(low.alias("b_low"), (low + 3).alias("b_high"))
    t = p.groupBy("p_type", "p_size").agg(low.alias("t_low"), (low + 3).alias("t_high"))
    return matching.interval_join(b, t, ("b_low", "b_high"), ("t_low", "t_high"), 8).select("p_brand", "p_type", "p_size")


@query("WITH y AS (SELECT c_custkey, c_nationkey, min(year(o_orderdate)) AS a, max(year(o_orderdate)) AS b FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL) SELECT c_custkey, (a IS NULL) OR (a - 5 <= 1992 AND 1990 - 5 <= b) AS overlaps FROM y")
def years_overlap(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.year(F.min("o_orderdate")).alias("a"), F.year(F.max("o_orderdate")).alias("b"))
    y = table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left")
    return y.select("c_custkey", matching.years_overlap(F.col("a"), F.col("b"), F.lit(1990), F.lit(1992)).alias("overlaps"))


@query("WITH t AS (SELECT DISTINCT p_name AS name, string_split(p_name, ' ') AS w FROM part) SELECT a.name AS a, b.name AS b FROM t a, t b WHERE len(list_intersect(list_distinct(a.w), list_distinct(b.w))) >= 2 OR (len(list_intersect(list_distinct(a.w), list_distinct(b.w))) > 0 AND len(list_intersect(list_distinct(a.w), list_distinct(b.w))) = least(len(list_distinct(a.w)), len(list_distinct(b.w))))")
def token_overlap(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("name"))
    return matching.overlapping_names(names, names)


@query("WITH c AS (SELECT o_custkey AS name, o_orderkey AS qid, o_orderdate AS rank FROM orders), bad AS (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') SELECT name, qid FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY rank, qid) AS r FROM c WHERE qid NOT IN (SELECT o_orderkey FROM bad)) WHERE r = 1")
def first_without_conflict(spark, d):
    o = table(spark, d, "orders")
    candidates = o.select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("qid"), F.col("o_orderdate").alias("rank"))
    existing = o.select(F.col("o_orderkey").alias("qid"), F.lit("status").alias("prop"), F.col("o_orderstatus").alias("value"))
    proposed = o.select(F.col("o_custkey").alias("name"), F.lit("status").alias("prop"), F.lit("F").alias("value")).distinct()
    return matching.first_without_conflict(candidates, existing, proposed)


_LADDER = ", ".join(f"(l_orderkey & {1 << k}) <> 0 AS {name}" for k, name in enumerate(("corroborated", "exact", "dated", "conflict", "low")))


@query(f"SELECT *, CASE WHEN low OR conflict THEN 'low' WHEN corroborated::INT + exact::INT + dated::INT >= 2 THEN 'high' WHEN corroborated::INT + exact::INT + dated::INT = 1 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT l_orderkey, l_linenumber, {_LADDER} FROM lineitem)")
def confidence_ladder(spark, d):
    names = ("corroborated", "exact", "dated", "conflict", "low")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *((F.col("l_orderkey").bitwiseAND(1 << k) > 0).alias(n) for k, n in enumerate(names)))
    return rows.withColumn("confidence", matching.confidence(*map(F.col, names)))


@query("SELECT n_regionkey, count(*) AS n, count(s_suppkey) AS matched, round(count(s_suppkey) / count(*), 6) AS rate FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN supplier ON s_suppkey = c_custkey GROUP BY 1")
def match_rate(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return matching.match_rate(c.join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("c_custkey"), "left"), "n_regionkey", F.col("s_suppkey").isNotNull())


@query("SELECT o_custkey, o_orderstatus, count(DISTINCT lower(trim(o_orderpriority))) AS names FROM orders GROUP BY ALL HAVING count(DISTINCT lower(trim(o_orderpriority))) >= 2")
def collapsed_clusters(spark, d):
    return matching.collapsed_clusters(table(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_orderpriority")


@query("SELECT p_size, count(DISTINCT p_brand) AS names, count(DISTINCT p_type) AS ids FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) >= 2 AND count(DISTINCT p_type) >= 2")
def colliding_clusters(spark, d):
    return matching.colliding_clusters(table(spark, d, "part"), "p_size", "p_brand", "p_type")


@query("SELECT o_custkey, count(DISTINCT o_orderkey) AS qids, count(DISTINCT o_orderstatus) AS n_o_orderstatus, count(DISTINCT o_orderpriority) AS n_o_orderpriority FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey) >= 2 AND (count(DISTINCT o_orderstatus) >= 2 OR count(DISTINCT o_orderpriority) >= 2)")
def over_merged(spark, d):
    return matching.over_merged(table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(text) ORDER BY CASE role WHEN 'system' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END, turn) AS r FROM conversations) WHERE r = 1")
def role_priority(spark, d):
    return matching.role_priority(table(spark, d, "conversations"), "conv_id", "text", "role", "turn", ["system", "assistant"])


@query("SELECT o_orderkey, CASE WHEN b > w + 5 THEN 'born after' WHEN o_orderstatus = 'F' AND w - x > 80 THEN 'died long before' END AS reason FROM (SELECT o_orderkey, o_orderstatus, 1992 + o_orderkey % 12 AS b, 1900 + o_orderkey % 50 AS x, year(o_orderdate) AS w FROM orders)")
def date_conflicts(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", matching.date_conflict(1992 + F.col("o_orderkey") % 12, 1900 + F.col("o_orderkey") % 50, F.year("o_orderdate"), F.col("o_orderstatus") == "F").alias("reason"))


@query("WITH c AS (SELECT o_orderpriority AS prop, CAST(o_custkey AS VARCHAR) AS value, o_orderkey AS qid FROM orders) SELECT prop, value, CASE WHEN count(DISTINCT qid) = 1 THEN min(qid) END AS qid FROM c GROUP BY ALL")
def identifier_lookup(spark, d):
    claims = table(spark, d, "orders").select(F.col("o_orderpriority").alias("prop"), F.col("o_custkey").cast("string").alias("value"), F.col("o_orderkey").alias("qid"))
    return matching.by_identifier(claims.select("prop", "value").distinct(), claims)


@query("WITH a AS (SELECT l_partkey AS k, min(l_orderkey) AS q FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 GROUP BY 1), b AS (SELECT l_partkey AS k, min(l_orderkey) AS q FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) SELECT p_partkey, coalesce(a.q, b.q) AS qid, CASE WHEN a.q IS NOT NULL THEN 0 WHEN b.q IS NOT NULL THEN 1 END AS source FROM part LEFT JOIN a ON a.k = p_partkey LEFT JOIN b ON b.k = p_partkey")
def ordered_fallback(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_orderkey").alias("qid"), "l_returnflag", "l_quantity")  # noqa: E741
    return matching.first_found(table(spark, d, "part"), "p_partkey", l.where("l_returnflag = 'R' and l_quantity > 45"), l.where("l_returnflag = 'A'"))


@query("WITH labels AS (SELECT p_name AS name, 'Q' || p_partkey AS qid, p_partkey AS n FROM part UNION SELECT p_type, 'Q' || p_partkey, p_partkey FROM part) SELECT DISTINCT x.name, (SELECT arg_min(qid, n) FROM labels l WHERE l.name = x.name AND n IN (SELECT p_partkey FROM part WHERE p_size > 10)) AS qid FROM labels x")
def label_search(spark, d):
    p = table(spark, d, "part").withColumn("qid", F.concat(F.lit("Q"), F.col("p_partkey").cast("string")))
    tables = [p.select(F.col(c).alias("name"), "qid") for c in ("p_name", "p_type")]
    names = tables[0].select("name").union(tables[1].select("name")).distinct()
    return matching.by_label(names, tables, p.where("p_size > 10"), text.qid_number)


# Quality -------------------------------------------------------------------------


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_claims(spark, d):
    return quality.duplicate_claims(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey"])


@query("SELECT l_orderkey, l_suppkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_shipdate) AS r FROM lineitem) WHERE r > 1")
def redundant_claims(spark, d):
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")]
    return quality.redundant_claims(table(spark, d, "lineitem"), ["l_orderkey", "l_suppkey"], *order).select("l_orderkey", "l_suppkey", "l_linenumber")


@query("SELECT o_custkey, o_orderstatus, count(DISTINCT o_orderpriority) AS n_values FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL HAVING count(DISTINCT o_orderpriority) >= 2")
def conflicting_values(spark, d):
    return quality.conflicting_values(table(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_orderpriority", ["F", "O"])


_CARDINALITY = "SELECT CAST(c_custkey AS VARCHAR) AS focus_node, 'placed' AS path, 'Warning' AS severity, CASE WHEN n < 1 THEN 'Less than 1 values of placed: ' ELSE 'More than 15 values of placed: ' END || n AS message FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) WHERE n < 1 OR n > 15"


def _cardinality(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return quality.cardinality(table(spark, d, "customer"), o, "c_custkey", "placed", least=1, most=15, severity="Warning")


@query(_CARDINALITY)
def cardinality_shape(spark, d):
    return _cardinality(spark, d)


@query("SELECT CAST(page_id AS VARCHAR) AS focus_node, 'url' AS path, 'Violation' AS severity, 'Value does not match: ' || url AS message FROM pages WHERE NOT regexp_matches(url, '^https://')")
def pattern_shape(spark, d):
    return quality.matches_pattern(table(spark, d, "pages"), "page_id", "url", "url", "^https://")


@query("SELECT CAST(l_suppkey AS VARCHAR) AS focus_node, 'part' AS path, 'Violation' AS severity, 'Value is not of the class: ' || l_partkey AS message FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def class_shape(spark, d):
    return quality.of_class(table(spark, d, "lineitem"), "l_suppkey", "l_partkey", table(spark, d, "part").where("p_size > 5"), "p_partkey", "part")


@query(over_graph(", s(c, p, a, b, v) AS (VALUES ('Customer', 'rdfs:label', 1, 1, 'Violation'), ('Customer', 'placed', 1, NULL, 'Warning'), ('Order', 'status', 1, 1, 'Violation')) SELECT t.s AS focus_node, s.p AS path, s.v AS severity, 'values: ' || count(DISTINCT x.o) AS message FROM triples t JOIN s ON t.p = 'rdf:type' AND t.o = s.c LEFT JOIN triples x ON x.s = t.s AND x.p = s.p GROUP BY t.s, s.p, s.v, s.a, s.b HAVING count(DISTINCT x.o) < s.a OR count(DISTINCT x.o) > s.b"))
def shape_table(spark, d):
    shapes = (("Customer", "rdfs:label", 1, 1, "Violation"), ("Customer", "placed", 1, None, "Warning"), ("Order", "status", 1, 1, "Violation"))
    return quality.validate(star_graph(spark, d), shapes)


@query(f"SELECT focus_node, 'Warning' AS severity, count(*) AS n FROM ({_CARDINALITY}) GROUP BY 1")
def worst_severity(spark, d):
    return quality.worst_severity(_cardinality(spark, d))


@query(f"SELECT severity, message, count(*) AS n, list_aggregate(list(focus_node ORDER BY focus_node)[1:20], 'string_agg', ',') AS examples FROM ({_CARDINALITY}) GROUP BY ALL")
def violation_report(spark, d):
    return quality.report(_cardinality(spark, d)).withColumn("examples", F.array_join("examples", ","))


@query("SELECT severity, code, message, CAST(p_partkey AS VARCHAR) AS ref FROM (SELECT p_partkey, 'error' AS severity, 'SMALL' AS code, 'too small' AS message FROM part WHERE p_size < 3 UNION ALL SELECT p_partkey, 'warning', 'CHEAP', 'too cheap' FROM part WHERE p_retailprice < 905)")
def item_lint(spark, d):
    return quality.lint(table(spark, d, "part"), "p_partkey", [("error", "SMALL", F.col("p_size") < 3, "too small"), ("warning", "CHEAP", F.col("p_retailprice") < 905, "too cheap")])


@query("WITH p(o_orderstatus) AS (VALUES ('F'), ('O'), ('X')), t AS (SELECT count(*) AS total FROM customer), h AS (SELECT o_orderstatus, count(DISTINCT o_custkey) AS held FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) GROUP BY 1) SELECT o_orderstatus, coalesce(held, 0) AS held, total - coalesce(held, 0) AS missing, round(coalesce(held, 0) / total, 6) AS share FROM p LEFT JOIN h USING (o_orderstatus), t")
def coverage_audit(spark, d):
    claims = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return quality.coverage(table(spark, d, "customer"), claims, "c_custkey", "o_orderstatus", ["F", "O", "X"])


@query("WITH b AS (SELECT o_orderpriority AS k, count(*) AS n FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1), a AS (SELECT o_orderpriority AS k, count(*) AS n FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1) SELECT k, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta FROM b FULL JOIN a USING (k)")
def before_after(spark, d):
    of = lambda y: table(spark, d, "orders").where(F.year("o_orderdate") == y).groupBy(F.col("o_orderpriority").alias("k")).agg(F.count("*").alias("n"))
    return quality.before_after(of(1996), of(1997), "k", "n")


@query("SELECT p_partkey FROM part WHERE (p_size >= 40 AND p_type <> 'PROMO') OR p_brand IN ('Brand#3', 'Brand#5')")
def rule_engine(spark, d):
    both = quality.rules([("p_size", ">=", "40"), ("p_type", "!=", "PROMO")], "AND") | quality.rules([("p_brand", "in", ["Brand#3", "Brand#5"])], "OR")
    return table(spark, d, "part").where(both).select("p_partkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 300")
def pagination(spark, d):
    return quality.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 3, 100, F.desc("o_totalprice"), F.col("o_orderkey"))


# Text ------------------------------------------------------------------------------


@query(r"SELECT doc_id, len(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: length(x) >= 10)) AS n_sentences FROM documents")
def sentence_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("n_sentences"))


@query("WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents), w AS (SELECT doc_id, p, list_position(list_transform(p, lambda x: contains(lower(x), 'license')), true) AS k FROM l) SELECT doc_id, CASE WHEN k > 0 THEN array_to_string(p[greatest(k - 1, 1):k + 1], ' ') END AS context FROM w")
def keyword_context(spark, d):
    return table(spark, d, "documents").select("doc_id", text.keyword_context(F.split("text", "\n"), "license").alias("context"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)license') THEN 'license' WHEN regexp_matches(text, '@') THEN 'mail' WHEN regexp_matches(text, '[0-9]{16}') THEN 'number' END AS first_kind, concat_ws(',', CASE WHEN regexp_matches(text, '(?i)license') THEN 'license' END, CASE WHEN regexp_matches(text, '@') THEN 'mail' END, CASE WHEN regexp_matches(text, '[0-9]{16}') THEN 'number' END) AS kinds FROM documents")
def note_classifier(spark, d):
    rules = (("license", "(?i)license"), ("mail", "@"), ("number", "[0-9]{16}"))
    return table(spark, d, "documents").select("doc_id", text.first_of(F.col("text"), rules).alias("first_kind"), F.array_join(text.all_of(F.col("text"), rules), ",").alias("kinds"))


@query("SELECT doc_id, CASE WHEN trim(text) = '' THEN 'empty' WHEN lower(trim(text)) IN ('anonymous', 'unknown', 'various', 'אנונימי', 'לא ידוע') THEN 'anonymous' WHEN regexp_matches(text, '[0-9]') THEN 'digits' WHEN regexp_matches(lower(text), 'library|university|museum|college|institute|archive|seminary|ספריה|אוניברסיטה|מכון') THEN 'institution' WHEN length(regexp_replace(text, '[^\\p{L}]', '', 'g')) < 2 THEN 'too short' WHEN length(text) > 80 THEN 'too long' END AS reason FROM documents")
def rejection_reasons(spark, d):
    return table(spark, d, "documents").select("doc_id", text.rejection(F.col("text")).alias("reason"))


@query("SELECT doc_id, CASE WHEN instr(text, '@') > 0 THEN substring(text, greatest(instr(text, '@') - 30, 1), instr(text, '@') - greatest(instr(text, '@') - 30, 1)) END AS before FROM documents")
def left_context(spark, d):
    return table(spark, d, "documents").select("doc_id", text.left_window(F.col("text"), F.lit("@"), 30).alias("before"))


@query("SELECT lang, sum(length(regexp_replace(text, '[^\\x{0590}-\\x{05FF}]', '', 'g')))::BIGINT AS hebrew, sum(length(regexp_replace(text, '[^A-Za-z]', '', 'g')))::BIGINT AS latin FROM documents GROUP BY 1")
def script_counts(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(*text.script_counts(F.col("text")))


@query("SELECT conv_id, turn, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM conversations")
def segment_offsets(spark, d):
    return corpus.offsets(table(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "offset")


@query("SELECT s_suppkey, 'ca. ' || y AS written, y AS start_year, y AS end_year, true AS approximate, 'approximate' AS source FROM (SELECT s_suppkey, 1300 + s_suppkey % 400 AS y FROM supplier)")
def date_ladder(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("ca. "), (1300 + F.col("s_suppkey") % 400).cast("string")).alias("written"))
    r = s.withColumn("r", dates.resolve(F.col("written")))
    return r.select("s_suppkey", "written", F.col("r.start").cast("long").alias("start_year"), F.col("r.end").cast("long").alias("end_year"), "r.approximate", "r.source")


@query("SELECT o_orderkey, '+' || lpad(CAST(year(o_orderdate) - 500 AS VARCHAR), 4, '0') || '-00-00T00:00:00Z' AS time, 9 AS precision, CASE WHEN year(o_orderdate) - 500 < 1583 THEN 'Q1985786' ELSE 'Q1985727' END AS calendar FROM orders")
def time_values(spark, d):
    y = F.year("o_orderdate") - 500
    return table(spark, d, "orders").select("o_orderkey", dates.time_value(y, y).alias("t")).select("o_orderkey", "t.time", "t.precision", "t.calendar")


# Evaluation --------------------------------------------------------------------------


def _scored(spark, d):
    """Labelled documents with a score from their length."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    score = F.least(F.col("n_chars") / 4000.0, F.lit(1.0))
    return table(spark, d, "labels").join(docs, "doc_id").select("doc_id", "lang", (F.col("quality") == 1).alias("gold"), score.alias("score"))


_SCORED = "scored AS (SELECT l.doc_id, lang, quality = 1 AS gold, least(n_chars / 4000.0, 1.0) AS score FROM labels l JOIN documents USING (doc_id))"
_PRF = "count(*) FILTER (gold AND {p}) AS tp, count(*) FILTER (NOT gold AND {p}) AS fp, count(*) FILTER (gold AND NOT {p}) AS fn, round(coalesce(count(*) FILTER (gold AND {p}) / nullif(count(*) FILTER ({p}), 0), 0), 6) AS precision, round(coalesce(count(*) FILTER (gold AND {p}) / nullif(count(*) FILTER (gold), 0), 0), 6) AS recall, round(coalesce(2 * count(*) FILTER (gold AND {p}) / nullif(count(*) FILTER (gold) + count(*) FILTER ({p}), 0), 0), 6) AS f1".format(p="(score >= 0.5)")


@query(f"WITH {_SCORED} SELECT {_PRF} FROM scored")
def micro_prf(spark, d):
    return evaluation.micro(_scored(spark, d), F.col("gold"), F.col("score") >= 0.5)


@query(f"WITH {_SCORED} SELECT lang, {_PRF}, count(*) FILTER (gold) AS support FROM scored GROUP BY lang")
def per_class_prf(spark, d):
    return evaluation.per_class(_scored(spark, d), "lang", F.col("gold"), F.col("score") >= 0.5)


_GRID = f"WITH {_SCORED}, g AS (SELECT unnest(generate_series(20, 80, 5))::INT AS threshold), c AS (SELECT threshold, count(*) FILTER (gold AND floor(round(score * 100, 6)) >= threshold) AS tp, count(*) FILTER (NOT gold AND floor(round(score * 100, 6)) >= threshold) AS fp, count(*) FILTER (gold AND floor(round(score * 100, 6)) < threshold) AS fn FROM scored, g GROUP BY 1), f AS (SELECT *, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM c)"


@query(f"{_GRID} SELECT threshold, tp, fp, fn, f1 FROM f")
def threshold_grid(spark, d):
    return evaluation.threshold_grid(_scored(spark, d), F.col("gold"), F.col("score"))


@query(f"{_GRID} SELECT threshold, f1 FROM f ORDER BY f1 DESC, threshold LIMIT 1")
def best_threshold(spark, d):
    return evaluation.best_threshold(evaluation.threshold_grid(_scored(spark, d), F.col("gold"), F.col("score")))


@query("SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1) % 5 AS INT) AS fold FROM labels")
def stratified_folds(spark, d):
    return evaluation.folds(table(spark, d, "labels").select("doc_id", "quality"), "quality", "doc_id")


@query("SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS r FROM labels) WHERE r <= 50")
def class_rebalance(spark, d):
    return evaluation.rebalance(table(spark, d, "labels").select("doc_id", "quality"), "quality", "doc_id", 50)


@query("""WITH n AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS place, count(*) OVER (PARTITION BY quality) AS size FROM labels), c AS (SELECT *, CASE WHEN size >= 301 THEN CAST(place < 301 AS BIGINT) ELSE 301 // size + CAST(place < 301 % size AS BIGINT) END AS c FROM n)
SELECT doc_id, quality, unnest(range(1, c + 1)) AS copy FROM c""")
def class_oversample(spark, d):
    return evaluation.rebalance(table(spark, d, "labels").select("doc_id", "quality"), "quality", "doc_id", 301, replace=True)


@query("SELECT lang, round((t.total - count(*)) / greatest(count(*), 1), 6) AS weight FROM documents, (SELECT count(*) AS total FROM documents) t GROUP BY lang, t.total")
def class_weights(spark, d):
    return evaluation.class_weights(table(spark, d, "documents"), "lang")


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 10 ORDER BY n DESC, p_brand LIMIT 10")
def label_vocabulary(spark, d):
    return evaluation.vocabulary(table(spark, d, "part"), "p_brand", 10, 10)


@query("SELECT p_brand, string_agg(CASE WHEN t THEN '1' ELSE '0' END, '' ORDER BY k) AS hot FROM (SELECT p_brand, k, CASE WHEN v = '' THEN NOT list_has_any(x, ['ECONOMY', 'PROMO']) ELSE list_contains(x, v) END AS t FROM (SELECT p_brand, list(DISTINCT p_type) AS x FROM part WHERE p_size < 4 GROUP BY 1), (VALUES (1, 'ECONOMY'), (2, 'PROMO'), (3, '')) w(k, v)) GROUP BY 1")
def multi_hot(spark, d):
    types = table(spark, d, "part").where("p_size < 4").groupBy("p_brand").agg(F.collect_set("p_type").alias("x"))
    return types.select("p_brand", F.array_join(F.transform(evaluation.multi_hot(F.col("x"), ["ECONOMY", "PROMO"]), lambda v: v.cast("string")), "").alias("hot"))


@query("WITH s AS (SELECT l_orderkey, l_returnflag, sum(l_linenumber) AS w FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY w DESC, l_returnflag) AS k, sum(w) OVER (PARTITION BY l_orderkey) AS total FROM s) SELECT l_orderkey, l_returnflag, round(w / total, 6) AS confidence FROM r WHERE k = 1")
def weighted_votes(spark, d):
    return evaluation.weighted_votes(table(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag", "l_linenumber")


@query("SELECT o_custkey, o_orderkey, s, e, next_start FROM (SELECT o_custkey, o_orderkey, s, e, lead(s) OVER (PARTITION BY o_custkey ORDER BY s, e, o_orderkey) AS next_start FROM (SELECT o_custkey, o_orderkey, CAST(datediff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS INT) AS s, CAST(datediff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS INT) + 90 + o_orderkey % 7 AS e FROM orders)) WHERE e > next_start")
def adjacent_overlaps(spark, d):
    day = F.date_diff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date"))
    spans = table(spark, d, "orders").select("o_custkey", "o_orderkey", day.alias("s"), (day + 90 + F.col("o_orderkey") % 7).alias("e"))
    return evaluation.adjacent_overlaps(spans, "o_custkey", "s", "e", "o_orderkey")


# Annotated corpora -----------------------------------------------------------------


@query("SELECT lang, source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY length(text) DESC, doc_id) AS r FROM documents) WHERE r = 1")
def keep_longest(spark, d):
    return corpus.keep_longest(table(spark, d, "documents"), ["lang", "source"], "text", "doc_id").select("lang", "source", "doc_id")


@query("SELECT p_type, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM part), 6) AS percent FROM part GROUP BY 1")
def share_of_total(spark, d):
    return corpus.share_of_total(table(spark, d, "part"), "p_type")


@query("SELECT p_brand, p_partkey, p_retailprice, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 3")
def top_per_group(spark, d):
    return corpus.top_per_group(table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice"), "p_brand", 3, F.desc("p_retailprice"), F.col("p_partkey"))


@query("SELECT event_type, user_id, n, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS r FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL)) WHERE r <= 10")
def top_values(spark, d):
    return corpus.top_values(table(spark, d, "events"), "event_type", "user_id")


@query("SELECT min(k) AS least, max(k) AS most, round(avg(k), 6) AS mean, median(k) AS median FROM (SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY 1)")
def rows_per_record(spark, d):
    return corpus.per_record(table(spark, d, "lineitem"), "l_orderkey")


@query("SELECT lang, count(n_chars) AS n, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 6) AS mean, median(n_chars) AS median FROM documents GROUP BY 1")
def length_summary(spark, d):
    return corpus.summary(table(spark, d, "documents"), "n_chars", "lang")


@query("SELECT coalesce(event_type, 'OVERALL') AS event_type, count(*) AS n, count(*) FILTER (value > 10) AS good, round(100 * count(*) FILTER (value > 10) / count(*), 6) AS rate FROM events GROUP BY ROLLUP (event_type)")
def rate_rollup(spark, d):
    return corpus.rate_rollup(table(spark, d, "events"), "event_type", F.col("value") > 10)


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT coalesce(regexp_matches(nullif(c_mktsegment, 'BUILDING'), 'MACH|HOUSE'), false)")
def negated_filter(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("x"))
    return corpus.without_matches(c, "x", "MACH|HOUSE").drop("x")


@query("SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), '') || ' ' || c_name || ' ' || CAST(c_nationkey AS VARCHAR) AS context FROM customer")
def joined_columns(spark, d):
    c = table(spark, d, "customer").withColumn("x", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return c.select("c_custkey", corpus.joined("x", "c_name", "c_nationkey").alias("context"))


_UNPIVOT = "e AS (SELECT p_partkey, entity_type, source_field, unnest(list_filter(string_split(v, ' '), lambda x: x <> '')) AS entity FROM (SELECT p_partkey, 'name' AS entity_type, 'p_name' AS source_field, p_name AS v FROM part UNION ALL SELECT p_partkey, 'kind', 'p_type', p_type FROM part UNION ALL SELECT p_partkey, 'kind', 'p_brand', p_brand FROM part))"


def _entities(spark, d):
    return corpus.unpivot(table(spark, d, "part"), "p_partkey", {"name": ["p_name"], "kind": ["p_type", "p_brand"]}, mark=" ")


@query(f"WITH {_UNPIVOT} SELECT * FROM e")
def field_unpivot(spark, d):
    return _entities(spark, d)


@query(f"WITH {_UNPIVOT}, v AS (SELECT e.*, contains(lower(p_name || ' of ' || lower(p_type)), lower(entity)) AS found FROM e JOIN part USING (p_partkey)) SELECT coalesce(entity_type, 'OVERALL') AS entity_type, count(*) AS n, count(*) FILTER (found) AS good, round(100 * count(*) FILTER (found) / count(*), 6) AS rate FROM v GROUP BY ROLLUP (entity_type)")
def validation_rates(spark, d):
    contexts = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(" of "), F.lower("p_type")).alias("context"))
    return corpus.rate_rollup(corpus.validated(_entities(spark, d), contexts, "p_partkey", "context"), "entity_type", F.col("found"))


@query("WITH p AS (SELECT doc_id, string_split(text, ' the ') AS p FROM documents), x AS (SELECT doc_id, p, unnest(generate_series(1, len(p) - 1)) AS k FROM p WHERE len(p) > 1) SELECT doc_id, CAST(list_sum(list_transform(p[1:k], lambda y: length(y))) + (k - 1) * 5 AS INT) AS start, CAST(list_sum(list_transform(p[1:k], lambda y: length(y))) + k * 5 AS INT) AS \"end\" FROM x")
def occurrences(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.lit(" the ").alias("needle"))
    return corpus.occurrences(docs, "text", "needle").select("doc_id", "start", "end")


@query("SELECT user_id, arg_min(event_type, event_id) AS text, count(*) AS validation_score, round(avg(event_id), 6) AS validation_rate FROM events GROUP BY 1")
def training_records(spark, d):
    return corpus.training_records(table(spark, d, "events"), "user_id", "event_id", "event_type", "event_id")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS records, round(100 * count(*) FILTER (value >= 10) / count(*), 6) AS high_percent FROM events GROUP BY 1")
def quality_report(spark, d):
    return corpus.quality_report(table(spark, d, "events"), "event_type", "user_id", "value", 10)


@query("SELECT max(n) AS largest, min(n) AS smallest, round(max(n) / min(n), 6) AS ratio, max(n) / min(n) > 10 AS rebalance FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)")
def class_imbalance(spark, d):
    return corpus.imbalance(table(spark, d, "documents"), "lang")


# These register their own queries here.
from quirelake.plans import cascade as _cascade  # noqa: E402, F401
from quirelake.plans import files as _files  # noqa: E402, F401
from quirelake.plans import items as _items  # noqa: E402, F401
from quirelake.plans import names as _names  # noqa: E402, F401
from quirelake.plans import records as _records  # noqa: E402, F401
from quirelake.plans import resolution as _resolution  # noqa: E402, F401
from quirelake.plans import scalars as _scalars  # noqa: E402, F401
from quirelake.plans import structures as _structures  # noqa: E402, F401
from quirelake.plans import texts as _texts  # noqa: E402, F401
from quirelake.plans import validation as _validation  # noqa: E402, F401
