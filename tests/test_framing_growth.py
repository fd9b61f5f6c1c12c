"""Framed records and back: what is read, and what has to be made distinct."""

from collections import Counter

from pyspark.sql import functions as F

from quirelake.operators import framing, graph
from quirelake.operators.framing import Field, Frame
from quirelake.plans import structures
from quirelake.plans.graphs import star_graph

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def keyed_by_objects(df):
    return sum("hashpartitioning(s#" in line and "o_kind#" in line for line in plan(df).splitlines())


def statement(s, p, o, kind="iri"):
    return (s, p, o, kind, "xsd:string" if kind == "literal" else None, None)


def test_frames_read_types_of_their_own_nodes(spark):
    """Types, status and two links of orders, types and years of spans; types of orders are no part of regions."""
    assert plan(framing.framed(star_graph(spark, DATA), structures.ORDER)).count("ReadSchema: struct<o_orderkey") == 6


def test_only_shared_predicates_are_made_distinct(spark):
    leaf = Frame((Field("name", "name"),), "Leaf")
    frame = Frame((Field("code", "code"), Field("leaves", "leaf", many=True, frame=leaf)), "Stem")
    rows = [statement("a", "rdf:type", "Stem"), statement("b", "rdf:type", "Stem"), statement("a", "code", "1", "literal"), statement("x", "rdf:type", "Leaf"), statement("x", "name", "X", "literal"), *(statement(s, "leaf", "x") for s in "ab")]
    records = framing.framed(spark.createDataFrame(rows, graph.TRIPLE), frame)
    back = framing.unframed(records, frame, unique=True)
    assert keyed_by_objects(back) == 0 and keyed_by_objects(framing.unframed(records, frame)) == 1
    assert Counter(map(tuple, back.collect())) == Counter(rows)


def test_statements_of_several_fields_come_once(spark):
    """A person linked by two fields, a place that is a region too, and a field that reads what another one reads."""
    region = Frame((Field("label", "rdfs:label"),), "Region")
    place = Frame((Field("label", "rdfs:label"), Field("region", "in", frame=region)), "Place")
    person = Frame((Field("name", "name"), Field("home", "home", frame=place)), "Person")
    frame = Frame((Field("first", "title"), Field("titles", "title", many=True), Field("by", "by", many=True, frame=person), Field("for_", "for", frame=person), Field("kinds", "rdf:type", many=True)), "Book")
    text = lambda s, p, o: statement(s, p, o, "literal")
    rows = [
        statement("b1", "rdf:type", "Book"), text("b1", "title", "A"), text("b1", "title", "B"), statement("b1", "by", "p1"), statement("b1", "by", "p2"), statement("b1", "for", "p1"),
        statement("b2", "rdf:type", "Book"), statement("b2", "by", "p1"), statement("b3", "rdf:type", "Book"), statement("p1", "rdf:type", "Person"), text("p1", "name", "N"), statement("p1", "home", "x"),
        statement("p2", "rdf:type", "Person"), statement("p2", "home", "x"), statement("x", "rdf:type", "Place"), statement("x", "rdf:type", "Region"), text("x", "rdfs:label", "X"), statement("x", "in", "x"),
    ]
    records = framing.framed(spark.createDataFrame(rows, graph.TRIPLE), frame)
    wanted = Counter(rows) + Counter(text(s, "rdf:type", "Book") for s in ("b1", "b2", "b3"))
    assert Counter(map(tuple, framing.unframed(records, frame, unique=True).collect())) == wanted
    assert Counter(map(tuple, framing.unframed(records, frame).collect())) == wanted
    # Records that stand twice, and disagree.
    twice = records.unionByName(records).unionByName(records.where("id = 'b1'").withColumn("first", F.lit("C")))
    assert Counter(map(tuple, framing.unframed(twice, frame).collect())) == wanted + Counter([text("b1", "title", "C")])


def test_orders_come_back_once(spark):
    from quirelake.plans.queries import QUERIES

    got = QUERIES["unframed_orders"](spark, DATA).collect()
    read = star_graph(spark, DATA).where("s like 'order/%' or s like 'span/%'").select("s", "p", "o", "o_kind").collect()
    assert len(set(got)) == len(got) and set(read) == {r for r in got if r["s"].split("/")[0] in ("order", "span")}
