"""Edges by the types of their ends: only type triples are grouped."""

from quirelake.operators import graph


def test_ends_without_a_type_are_entities(spark):
    iri = [("a", "rdf:type", "T"), ("a", "rdf:type", "A"), ("b", "rdf:type", "B"), ("b", "rdf:type", "Z"), ("a", "k", "b"), ("a", "k", "b"), ("a", "k", "x"), ("y", "k", "x"), ("y", "k", "a"), ("a", "k", "a")]
    rows = [(*t, "iri", None, None) for t in iri] + [("x", "rdfs:label", "l", "literal", None, None)]
    triples = spark.createDataFrame(rows, graph.TRIPLE)
    nodes, edges, _ = graph.node_tables(triples, ["T"])
    types = graph.node_types(triples, ["T"])
    assert {tuple(r) for r in types.collect()} == {("a", "T"), ("b", "B")}
    wanted = {("T", "B", 2), ("T", "Entity", 1), ("Entity", "T", 1)}
    for ends in (types, nodes.select("uri", "node_type")):
        assert {tuple(r) for r in graph.edge_summary(ends, edges).collect()} == wanted


def test_links_and_labels_are_not_grouped(spark):
    triples = spark.createDataFrame([], graph.TRIPLE)
    plan = graph.node_types(triples, ["T"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "rdfs:label" not in plan
