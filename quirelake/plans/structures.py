"""Registered queries over containment trees, volume sets and framed records."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelake.operators import framing, hierarchy
from quirelake.operators.framing import Field, Frame
from quirelake.plans.graphs import star_graph, table
from quirelake.plans.queries import over_graph, query

# A supplier's lines as ranges of days: many overlap, many are nested.
_RANGES = "SELECT CAST(l_suppkey AS VARCHAR) AS key, concat_ws('-', l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT)) AS id, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS start, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity * (l_linenumber % 3) AS BIGINT) AS \"end\" FROM lineitem"
_TREE = f"""
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY start, "end" DESC, id) AS n FROM ({_RANGES})),
up AS (SELECT c.key, c.id, arg_max(p.id, p.n) AS parent FROM r c JOIN r p ON p.key = c.key AND p.n < c.n AND p."end" >= c."end" GROUP BY ALL),
t AS MATERIALIZED (SELECT r.*, parent FROM r LEFT JOIN up USING (key, id)),
deep AS (SELECT key, id, 0 AS depth FROM t WHERE parent IS NULL UNION ALL SELECT t.key, t.id, depth + 1 FROM deep JOIN t ON t.key = deep.key AND t.parent = deep.id),
tree AS (SELECT t.key, t.id, t.start, t."end", t.parent, CAST(depth AS BIGINT) AS depth, CAST(row_number() OVER (PARTITION BY t.key, t.parent ORDER BY t.start, t."end" DESC, t.id) AS INT) AS position FROM t JOIN deep USING (key, id))"""


def _tree(spark, d):
    day = F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long")
    ranges = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long")).alias("id"), day.alias("start"), (day + (F.col("l_quantity") * (F.col("l_linenumber") % 3)).cast("long")).alias("end"))
    return hierarchy.containment(ranges)


@query(f"WITH RECURSIVE {_TREE} SELECT key, id, start, \"end\", parent, depth, position FROM tree")
def containment_tree(spark, d):
    return _tree(spark, d)


@query(f"""WITH RECURSIVE {_TREE}, e AS (SELECT 'unit/' || key || '/' || id AS s, *, CASE WHEN parent IS NULL THEN 'manuscript/' || key ELSE 'unit/' || key || '/' || parent END AS above FROM tree)
SELECT s, 'rdf:type' AS p, 'CodicologicalUnit' AS o FROM e UNION ALL SELECT s, 'part_of', above FROM e UNION ALL SELECT s, 'position', CAST(position AS VARCHAR) FROM e UNION ALL SELECT s, 'depth', CAST(depth AS VARCHAR) FROM e UNION ALL SELECT s, 'first', CAST(start AS VARCHAR) FROM e UNION ALL SELECT s, 'last', CAST("end" AS VARCHAR) FROM e""")
def unit_hierarchy(spark, d):
    return hierarchy.hierarchy_triples(_tree(spark, d)).select("s", "p", "o")


_VOLUMES = "SELECT CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS \"set\", o_orderkey % 9000 AS record, CASE WHEN o_orderkey % 4 <> 0 THEN year(o_orderdate) END AS number FROM orders"


@query(f"""WITH own AS (SELECT record, "set", number FROM ({_VOLUMES}) WHERE "set" IS NOT NULL QUALIFY row_number() OVER (PARTITION BY record ORDER BY "set", number NULLS FIRST) = 1),
n AS (SELECT "set", count(*) AS n FROM own GROUP BY 1 HAVING count(*) >= 2), v AS (SELECT own.*, row_number() OVER (PARTITION BY "set" ORDER BY number NULLS LAST, record) AS place FROM own JOIN n USING ("set"))
SELECT 'set/' || "set" AS s, 'rdf:type' AS p, 'MultiVolumeSet' AS o FROM n UNION ALL SELECT 'set/' || "set", 'volumes', CAST(n AS VARCHAR) FROM n
UNION ALL SELECT 'manuscript/' || record, 'volume_of', 'set/' || "set" FROM v UNION ALL SELECT 'manuscript/' || record, 'volume_number', CAST(place AS VARCHAR) FROM v""")
def volume_sets(spark, d):
    o = F.col("o_orderkey")
    members = table(spark, d, "orders").select(F.when(o % 5 != 0, F.col("o_custkey")).alias("set"), (o % 9000).alias("record"), F.when(o % 4 != 0, F.year("o_orderdate")).alias("number"))
    return hierarchy.volume_sets(members).select("s", "p", "o")


@query("""WITH w AS (SELECT l_orderkey AS record, l_linenumber AS pos, l_partkey AS work, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS place, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem), a AS (SELECT * FROM w WHERE n > 1), x AS (SELECT DISTINCT record, n FROM a)
SELECT 'anthology/' || record AS s, 'rdf:type' AS p, 'AnthologyStructure' AS o FROM x UNION ALL SELECT 'anthology/' || record, 'structure_of', 'manuscript/' || record FROM x UNION ALL SELECT 'anthology/' || record, 'works', CAST(n AS VARCHAR) FROM x
UNION ALL SELECT 'anthology/' || record || '/' || place, 'part_of', 'anthology/' || record FROM a UNION ALL SELECT 'anthology/' || record || '/' || place, 'holds', 'work/' || work FROM a UNION ALL SELECT 'anthology/' || record || '/' || place, 'position', CAST(place AS VARCHAR) FROM a""")
def anthologies(spark, d):
    works = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("record"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("work"))
    return hierarchy.anthologies(works).select("s", "p", "o")


# Orders with their customer, its nation and region, and their time span.
_REGION = Frame((Field("label", "rdfs:label"),), "Region")
_NATION = Frame((Field("label", "rdfs:label"), Field("region", "in_region", frame=_REGION)), "Nation")
_CUSTOMER = Frame((Field("label", "rdfs:label"), Field("segment", "segment"), Field("nation", "in_nation", frame=_NATION)), "Customer")
_SPAN = Frame((Field("earliest", "earliest", datatype="xsd:integer"),), "TimeSpan")
ORDER = Frame((Field("status", "status"), Field("customer", "placed_by", frame=_CUSTOMER), Field("spans", "P4_has_time-span", many=True, frame=_SPAN)), "Order")


@query("""SELECT 'order/' || o_orderkey AS id, o_orderstatus AS status, 'customer/' || c_custkey AS customer_id, c_name AS customer, c_mktsegment AS segment, n_name AS nation, r_name AS region, 'span/' || o_orderkey || '=' || year(o_orderdate) AS spans
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def framed_orders(spark, d):
    records = framing.framed(star_graph(spark, d), ORDER)
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["id"], F.lit("="), s["earliest"])), ",")
    return records.select("id", "status", F.col("customer.id").alias("customer_id"), F.col("customer.label").alias("customer"), F.col("customer.segment").alias("segment"), F.col("customer.nation.label").alias("nation"), F.col("customer.nation.region.label").alias("region"), spans.alias("spans"))


@query(over_graph("""SELECT s, p, o, o_kind FROM triples WHERE s LIKE 'order/%' OR s LIKE 'span/%' OR s IN (SELECT 'customer/' || o_custkey FROM orders) OR s IN (SELECT 'nation/' || c_nationkey FROM customer JOIN orders ON o_custkey = c_custkey) OR s IN (SELECT 'region/' || n_regionkey FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey)"""))
def unframed_orders(spark, d):
    return framing.unframed(framing.framed(star_graph(spark, d), ORDER), ORDER, unique=True).select("s", "p", "o", "o_kind")


@query("""SELECT 'order/' || o_orderkey AS local_id, 'P31' AS property, 'Q87167' AS value FROM orders UNION ALL SELECT 'order/' || o_orderkey, 'P571', CAST(year(o_orderdate) AS VARCHAR) FROM orders UNION ALL SELECT 'order/' || o_orderkey, 'P127', 'customer/' || o_custkey FROM orders UNION ALL SELECT 'order/' || o_orderkey, 'P276', n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
def graph_items(spark, d):
    """From triples to records to the claims of items."""
    records = framing.framed(star_graph(spark, d), ORDER)
    claim = lambda p, v: F.struct(F.lit(p).alias("property"), v.alias("value"))
    claims = F.array(claim("P31", F.lit("Q87167")), claim("P571", F.get("spans", 0)["earliest"]), claim("P127", F.col("customer.id")), claim("P276", F.col("customer.nation.label")))
    return records.select(F.col("id").alias("local_id"), F.explode(F.filter(claims, lambda c: c["value"].isNotNull())).alias("c")).select("local_id", "c.*")
