"""Graph patterns and graph analytics over triples.

Triples are rows ``s, p, o, o_kind (iri|literal|bnode), datatype, lang``.  Every
operator is a plan of joins and aggregates; sets of triples are distinct rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.sources.tables import written

TRIPLE = "s string, p string, o string, o_kind string, datatype string, lang string"
TYPE, LABEL = "rdf:type", "rdfs:label"


def iri(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}/"), key.cast("string"))


def literal(p: str, value: Column, datatype: str = "xsd:string", lang: str | None = None) -> Column:
    return F.struct(F.lit(p).alias("p"), value.cast("string").alias("o"), F.lit("literal").alias("o_kind"), F.lit(datatype).alias("datatype"), F.lit(lang).cast("string").alias("lang"))


def link(p: str, target: Column) -> Column:
    return F.struct(F.lit(p).alias("p"), target.alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang"))


def emit(df: DataFrame, subject: Column, *statements: Column, more: Iterable[Column] = ()) -> DataFrame:
    """Triples of each row: single ``statements`` and arrays of them in ``more``; null objects are left out."""
    all_of = F.array(*statements)
    for m in more:
        all_of = F.concat(all_of, F.coalesce(m, F.array().cast("array<struct<p:string,o:string,o_kind:string,datatype:string,lang:string>>")))
    rows = df.select(subject.alias("s"), F.explode(all_of).alias("t")).select("s", "t.*")
    return rows.where("s is not null and o is not null")


def emit_each(df: DataFrame, subject: Column, *statements: Column) -> DataFrame:
    """The same triples as one branch for each statement: a filter on ``p`` leaves out all other branches, and each reads only its own columns.

    For tables that are cheap to scan again; ``emit`` passes over its rows once.
    """
    branches = (df.select(subject.alias("s"), x.alias("t")).select("s", "t.*").where("s is not null and o is not null") for x in statements)
    return reduce(DataFrame.unionAll, branches)


def merge(*graphs: DataFrame) -> DataFrame:
    """The set union of graphs."""
    return reduce(DataFrame.unionByName, graphs).dropDuplicates()


def canonical(triples: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Predicates and types renamed by an alias table."""
    if not aliases:
        return triples
    names = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return triples.withColumn("p", F.coalesce(names[F.col("p")], "p")).withColumn("o", F.when(F.col("p") == TYPE, F.coalesce(names[F.col("o")], "o")).otherwise(F.col("o")))


def pattern(triples: DataFrame, s: str, p: str, o: str) -> DataFrame:
    """Bindings of one triple pattern; names that begin with ``?`` are variables."""
    rows = triples
    for column, term in (("s", s), ("p", p), ("o", o)):
        if not term.startswith("?"):
            rows = rows.where(F.col(column) == term)
    if s == o and s.startswith("?"):
        rows = rows.where("s = o")
    names = {t[1:]: c for c, t in (("o", o), ("p", p), ("s", s)) if t.startswith("?")}
    return rows.select(*(F.col(c).alias(n) for n, c in names.items()))


def natural(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """A join on all columns that both have."""
    return left.join(right, [c for c in left.columns if c in right.columns], how)


def bgp(triples: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """A basic graph pattern: star and path joins over predicate-wise views."""
    return reduce(natural, (pattern(triples, *x) for x in patterns))


def optional(left: DataFrame, right: DataFrame) -> DataFrame:
    return natural(left, right, "left")


def not_exists(left: DataFrame, right: DataFrame) -> DataFrame:
    return natural(left, right, "left_anti")


def counts_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def count_distinct_by_kind(bindings: DataFrame, kind: str, value: str, kinds: list[str]) -> DataFrame:
    """A count of distinct values for each kind, side by side, in one scan."""
    return bindings.agg(*(F.count_distinct(F.when(F.col(kind) == k, F.col(value))).alias(f"n_{k}") for k in kinds))


def century(year: Column) -> Column:
    return (F.floor(year / 100) * 100).cast("long")


def _rank(priority: list[str]) -> Column:
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, priority)), F.col("o")), F.lit(0)) if priority else F.lit(0)
    return F.when(rank > 0, rank).otherwise(len(priority) + 1)


def node_types(triples: DataFrame, priority: list[str]) -> DataFrame:
    """``uri, node_type`` of the typed nodes alone, as ``node_tables`` has them: neither labels nor links are grouped."""
    typed = triples.where(F.col("p") == TYPE).select(F.col("s").alias("uri"), F.struct(_rank(priority).alias("r"), F.col("o").alias("t")).alias("typed"))
    return typed.groupBy("uri").agg(F.min("typed")["t"].alias("node_type"))


def node_tables(triples: DataFrame, priority: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``nodes(uri, label, node_type)``, ``edges(source, target, predicate)`` and ``properties(node_uri, key, value)``.

    Of several types of a node the first in ``priority`` counts, then the smallest.
    """
    order = _rank(priority)
    # One grouping by node: what its own triples say, and that links lead to it.
    own = triples.select(F.col("s").alias("uri"), F.when(F.col("p") == TYPE, F.struct(order.alias("r"), F.col("o").alias("t"))).alias("typed"), F.when(F.col("p") == LABEL, F.col("o")).alias("label"))
    nothing = [F.lit(None).cast(dict(own.dtypes)[c]).alias(c) for c in ("typed", "label")]
    met = triples.where((F.col("o_kind") == "iri") & (F.col("p") != TYPE)).select(F.col("o").alias("uri"), *nothing)
    nodes = own.unionAll(met).groupBy("uri").agg(F.min("label").alias("label"), F.coalesce(F.min("typed")["t"], F.lit("Entity")).alias("node_type"))
    edges = triples.where((F.col("o_kind") == "iri") & (F.col("p") != TYPE)).select(F.col("s").alias("source"), F.col("o").alias("target"), F.col("p").alias("predicate"))
    properties = triples.where((F.col("o_kind") == "literal") & (F.col("p") != LABEL)).select(F.col("s").alias("node_uri"), F.col("p").alias("key"), F.col("o").alias("value"))
    return nodes, edges, properties


def edge_summary(types: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges counted by the types of their ends, where these differ; an end without a type is an ``Entity``."""
    of = lambda end: types.select(F.col("uri").alias(end), F.col("node_type").alias(f"{end}_type"))
    typed = edges.join(of("source"), "source", "left").join(of("target"), "target", "left").select(*(F.coalesce(f"{end}_type", F.lit("Entity")).alias(f"{end}_type") for end in ("source", "target")))
    return counts_by(typed.where("source_type != target_type"), "source_type", "target_type")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``uri, degree``: edges at either end; a loop counts once.  No disjunctive join: ends are united first."""
    # Equal edges need no grouping of their own: three texts an edge would be held and shuffled for it.
    ends = edges.select(F.col("source").alias("uri"), F.lit(1).alias("n")).unionAll(edges.where("source != target").select(F.col("target").alias("uri"), F.lit(1).alias("n")))
    return nodes.select("uri").join(ends.groupBy("uri").agg(F.sum("n").alias("degree")), "uri", "left").select("uri", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def type_subgraph(nodes: DataFrame, edges: DataFrame, node_type: str, limit: int = 50) -> DataFrame:
    """The best connected nodes of a type (ties by uri)."""
    own = nodes.where(F.col("node_type") == node_type)
    return own.join(degrees(own, edges), "uri").orderBy(F.desc("degree"), "uri").limit(limit).select("uri", "label", "degree")


def outgoing(nodes: DataFrame, edges: DataFrame, uri: str) -> DataFrame:
    return edges.where(F.col("source") == uri).join(nodes, F.col("target") == F.col("uri")).select("predicate", "target", "label", "node_type")


def incoming(nodes: DataFrame, edges: DataFrame, uri: str) -> DataFrame:
    return edges.where(F.col("target") == uri).join(nodes, F.col("source") == F.col("uri")).select("predicate", "source", "label", "node_type")


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """``uri, hop``: nodes within ``hops`` undirected steps of the seeds and their distance.

    A frontier join for each hop; nodes seen before are taken out by an anti join.
    Frontiers are written, since each is read by all later hops.
    """
    both = edges.select(F.col("source").alias("uri"), F.col("target").alias("next")).union(edges.select("target", "source"))
    frontier = written(seeds.select("uri").distinct().withColumn("hop", F.lit(0)), "frontier")
    seen = frontier
    for k in range(1, hops + 1):
        near = frontier.join(both, "uri").select(F.col("next").alias("uri")).distinct()
        frontier = written(near.join(seen, "uri", "left_anti").withColumn("hop", F.lit(k)), "frontier")
        seen = seen.unionAll(frontier)
    return seen


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    keep = nodes.select("uri").distinct()
    return edges.join(keep.select(F.col("uri").alias("source")), "source", "left_semi").join(keep.select(F.col("uri").alias("target")), "target", "left_semi")


def closure(parents: DataFrame) -> DataFrame:
    """``child, ancestor``: the transitive closure of ``child, parent``.

    Only a round's new pairs join on, with all known ones on either side, so that
    the reach doubles each round and no pair is made twice from the same two; the
    rounds end when none is new.  Each round is written.
    """
    fresh = written(parents.select(F.col("child"), F.col("parent").alias("ancestor")).where("child is not null and ancestor is not null").distinct(), "closure")
    known = fresh
    step = lambda low, high: low.select("child", F.col("ancestor").alias("via")).join(high.select(F.col("child").alias("via"), "ancestor"), "via").select("child", "ancestor")
    while not fresh.isEmpty():
        further = step(fresh, known).unionAll(step(known, fresh)).distinct()
        fresh = written(further.join(known, ["child", "ancestor"], "left_anti"), "closure")
        known = known.unionAll(fresh)
    return known


def in_language(triples: DataFrame, language: str) -> DataFrame:
    """Triples whose literal is tagged with a language."""
    return triples.where((F.col("o_kind") == "literal") & (F.col("lang") == language))


def property_search(properties: DataFrame, filters: list[tuple[str, str, str]]) -> DataFrame:
    """Nodes that satisfy all filters ``(key, mode, text)`` in one scan.

    Modes: contains, equals, starts_with.  Case is folded; ``%`` and ``_`` in the
    text stay wildcards for contains and starts_with.
    """
    tests = []
    for key, mode, text in filters:
        value = F.col("value")
        hit = {"contains": value.ilike(f"%{text}%"), "starts_with": value.ilike(f"{text}%"), "equals": F.lower(value) == text.lower()}[mode]
        tests.append((F.col("key") == key) & hit)
    held = properties.where(reduce(Column.__or__, tests)).groupBy("node_uri").agg(*(F.bool_or(t).alias(f"t{k}") for k, t in enumerate(tests)))
    return held.where(" and ".join(f"t{k}" for k in range(len(tests)))).select("node_uri")


def totals(nodes: DataFrame, edges: DataFrame, properties: DataFrame) -> DataFrame:
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n") for name, df in (("nodes", nodes), ("edges", edges), ("properties", properties))]
    return reduce(DataFrame.unionAll, counted)


def property_keys(properties: DataFrame) -> DataFrame:
    return properties.select("key").distinct()


def multimap(properties: DataFrame) -> DataFrame:
    """``node_uri, key, values``: each property's sorted distinct values."""
    return properties.groupBy("node_uri", "key").agg(F.array_sort(F.collect_set("value")).alias("values"))


def local_name(uri: Column) -> Column:
    """What follows the last ``#``, or else the last ``/``."""
    return F.when(F.contains(uri, F.lit("#")), F.substring_index(uri, "#", -1)).otherwise(F.substring_index(uri, "/", -1))


def drop_redundant_annotations(triples: DataFrame) -> DataFrame:
    """Leave out ``AnnotationProperty`` types of subjects that are declared object or data properties."""
    declared = triples.where((F.col("p") == TYPE) & F.col("o").isin("owl:ObjectProperty", "owl:DatatypeProperty")).select("s").distinct()
    redundant = triples.where((F.col("p") == TYPE) & (F.col("o") == "owl:AnnotationProperty"))
    rest = triples.where(~((F.col("p") == TYPE) & (F.col("o") == "owl:AnnotationProperty")))
    return rest.unionByName(redundant.join(declared, "s", "left_anti").select(rest.columns))
