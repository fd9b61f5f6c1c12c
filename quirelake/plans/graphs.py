"""The star schema of the relational tables as a graph."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.operators import graph

PRIORITY = ["Region", "Nation", "Customer", "Supplier", "Order", "TimeSpan"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession, d: str, sql: str) -> DataFrame:
    """A statement over tables in braces, run by Spark; ``plain`` gives it to DuckDB."""
    return spark.sql(sql, **{n: table(spark, d, n) for n in set(re.findall(r"{(\w+)}", sql))})


def plain(sql: str) -> str:
    return re.sub(r"{(\w+)}", r"\1", sql)


def star_graph(spark: SparkSession, d: str, orders: bool = True) -> DataFrame:
    """Regions, nations, customers, suppliers and, if asked for, orders with their time spans.

    Keys are unique, so the triples are distinct by construction and need no shuffle.
    """
    t = lambda n: table(spark, d, n)
    named = lambda kind, name: (graph.link(graph.TYPE, F.lit(kind)), graph.literal(graph.LABEL, F.col(name)))
    parts = [
        graph.emit_each(t("region"), graph.iri("region", F.col("r_regionkey")), *named("Region", "r_name")),
        graph.emit_each(t("nation"), graph.iri("nation", F.col("n_nationkey")), *named("Nation", "n_name"), graph.link("in_region", graph.iri("region", F.col("n_regionkey")))),
        graph.emit_each(t("customer"), graph.iri("customer", F.col("c_custkey")), *named("Customer", "c_name"), graph.link("in_nation", graph.iri("nation", F.col("c_nationkey"))), graph.literal("segment", F.col("c_mktsegment"))),
        graph.emit_each(t("supplier"), graph.iri("supplier", F.col("s_suppkey")), *named("Supplier", "s_name"), graph.link("in_nation", graph.iri("nation", F.col("s_nationkey")))),
    ]
    if orders:
        o = t("orders")
        span = graph.iri("span", F.col("o_orderkey"))
        parts.append(graph.emit_each(o, graph.iri("order", F.col("o_orderkey")), graph.link(graph.TYPE, F.lit("Order")), graph.link("placed_by", graph.iri("customer", F.col("o_custkey"))), graph.link("P4_has_time-span", span), graph.literal("status", F.col("o_orderstatus"))))
        parts.append(graph.emit_each(o, span, graph.link(graph.TYPE, F.lit("TimeSpan")), graph.literal("earliest", F.year("o_orderdate"), "xsd:integer")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: The same graph in SQL: s, p, o, o_kind, datatype.
STAR_SQL = """
triples AS MATERIALIZED (
  SELECT 'region/' || r_regionkey AS s, 'rdf:type' AS p, 'Region' AS o, 'iri' AS o_kind FROM region
  UNION ALL SELECT 'region/' || r_regionkey, 'rdfs:label', r_name, 'literal' FROM region
  UNION ALL SELECT 'nation/' || n_nationkey, 'rdf:type', 'Nation', 'iri' FROM nation
  UNION ALL SELECT 'nation/' || n_nationkey, 'rdfs:label', n_name, 'literal' FROM nation
  UNION ALL SELECT 'nation/' || n_nationkey, 'in_region', 'region/' || n_regionkey, 'iri' FROM nation
  UNION ALL SELECT 'customer/' || c_custkey, 'rdf:type', 'Customer', 'iri' FROM customer
  UNION ALL SELECT 'customer/' || c_custkey, 'rdfs:label', c_name, 'literal' FROM customer
  UNION ALL SELECT 'customer/' || c_custkey, 'in_nation', 'nation/' || c_nationkey, 'iri' FROM customer
  UNION ALL SELECT 'customer/' || c_custkey, 'segment', c_mktsegment, 'literal' FROM customer
  UNION ALL SELECT 'supplier/' || s_suppkey, 'rdf:type', 'Supplier', 'iri' FROM supplier
  UNION ALL SELECT 'supplier/' || s_suppkey, 'rdfs:label', s_name, 'literal' FROM supplier
  UNION ALL SELECT 'supplier/' || s_suppkey, 'in_nation', 'nation/' || s_nationkey, 'iri' FROM supplier
  UNION ALL SELECT 'order/' || o_orderkey, 'rdf:type', 'Order', 'iri' FROM orders
  UNION ALL SELECT 'order/' || o_orderkey, 'placed_by', 'customer/' || o_custkey, 'iri' FROM orders
  UNION ALL SELECT 'order/' || o_orderkey, 'P4_has_time-span', 'span/' || o_orderkey, 'iri' FROM orders
  UNION ALL SELECT 'order/' || o_orderkey, 'status', o_orderstatus, 'literal' FROM orders
  UNION ALL SELECT 'span/' || o_orderkey, 'rdf:type', 'TimeSpan', 'iri' FROM orders
  UNION ALL SELECT 'span/' || o_orderkey, 'earliest', CAST(year(o_orderdate) AS VARCHAR), 'literal' FROM orders),
nodes AS MATERIALIZED (
  SELECT s AS uri, max(CASE WHEN p = 'rdfs:label' THEN o END) AS label, max(CASE WHEN p = 'rdf:type' THEN o END) AS node_type FROM triples GROUP BY s),
edges AS MATERIALIZED (SELECT s AS source, o AS target, p AS predicate FROM triples WHERE o_kind = 'iri' AND p <> 'rdf:type'),
properties AS (SELECT s AS node_uri, p AS key, o AS value FROM triples WHERE o_kind = 'literal' AND p <> 'rdfs:label')
"""
