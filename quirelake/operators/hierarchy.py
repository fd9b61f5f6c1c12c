"""Containment trees over ranges, ordered volume sets, and the statements that describe both.

Ranges are rows ``key, id, start, end``.  A range's parent is the one that contains
it, starts last and ends first; of equal ranges the smaller id contains the larger (ids
are unique in their key).

The sweep is one pass over rows in order of ``key, start, end desc, id``, dealt by
ranges of that order, so that a key of any size is spread: a partition keeps only
the stack of ranges that may still contain later ones.  What a row lacks is looked
up among the ranges that earlier partitions left open, whose stacks are composed
in order, one small row a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.operators import graph
from quirelake.sources.tables import written

_FIELDS = [("kind", pa.string()), ("part", pa.int64()), ("key", pa.string()), ("id", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("parent", pa.string()), ("root", pa.string()), ("root_end", pa.int64()), ("depth", pa.int64()), ("place", pa.int64())]
_ROWS = ", ".join(f"`{n}` {'string' if t == pa.string() else 'long'}" for n, t in _FIELDS)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their parent inside the partition, and at the end the ranges left open (``open``, bottom first) and the partition's keys (``keys``)."""
    part = first = key = None
    most = 0
    stack: list[tuple] = []

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(_FIELDS)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])

    for batch in batches:
        rows = []
        for part, own_key, own_id, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if first is None:
                first = own_key
            if own_key != key:
                key, stack, most = own_key, [], end
            most = max(most, end)
            while stack and stack[-1][2] < end:
                stack.pop()
            top = stack[0] if stack else (own_id, start, end)
            rows.append(("row", part, key, own_id, start, end, stack[-1][0] if stack else None, top[0], top[2], len(stack), None))
            stack.append((own_id, start, end))
        yield out(rows)
    if part is not None:
        yield out([("open", part, key, i, s, e, None, None, None, None, n) for n, (i, s, e) in enumerate(stack)] + [("keys", part, first, key, 0, most, None, None, None, None, -1)])


def _carried(rows: list) -> list[tuple]:
    """``part, key, id, end, depth`` of the ranges that are open before each partition."""
    by_part: dict[int, list] = {}
    for r in rows:
        by_part.setdefault(r["part"], []).append(r)
    held: list[tuple] = []  # key, id, end, depth
    out = []
    for part in sorted(by_part):
        out += [(part, *h) for h in held]
        about = next(r for r in by_part[part] if r["kind"] == "keys")
        first, last, most = about["key"], about["id"], about["end"]
        held = [h for h in held if first == last == h[0] and h[2] >= most]
        base = len(held)
        held += [(last, r["id"], r["end"], base + n) for n, r in enumerate(sorted((r for r in by_part[part] if r["kind"] == "open"), key=lambda r: r["place"]))]
    return out


def containment(ranges: DataFrame) -> DataFrame:
    """``key, id, start, end, parent, depth, position``: each range's parent (null at the top), its depth from 0, and its place from 1 among its parent's ranges."""
    spark = ranges.sparkSession
    order = [F.asc("key"), F.asc("start"), F.desc("end"), F.asc("id")]
    rows = ranges.select(F.col("key").cast("string"), F.col("id").cast("string"), F.col("start").cast("long"), F.col("end").cast("long")).where("key is not null and start is not null and end is not null")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().cast("long").alias("part"), "key", "id", "start", "end")
    swept = written(dealt.mapInArrow(_sweep, _ROWS), "containment")
    # As many rows as partitions and levels.
    open_before = _carried(swept.where("kind != 'row'").collect())
    carried = spark.createDataFrame(open_before, "part long, key string, c_id string, c_end long, c_depth long")
    stacks = carried.groupBy("part", "key").agg(F.array_sort(F.collect_list(F.struct("c_depth", "c_id", "c_end"))).alias("open"))
    own = swept.where("kind = 'row'").join(F.broadcast(stacks), ["part", "key"], "left")
    above = F.element_at(F.filter("open", lambda c: c["c_end"] >= F.col("root_end")), -1)
    held = F.size(F.filter(F.coalesce("open", F.array().cast("array<struct<c_depth:bigint,c_id:string,c_end:bigint>>")), lambda c: c["c_end"] >= F.col("root_end"))) > 0
    tree = own.withColumn("up", F.when(held, above))
    placed = tree.select("key", "id", "start", "end", F.coalesce("parent", "up.c_id").alias("parent"), (F.col("depth") + F.coalesce(F.col("up.c_depth") + 1, F.lit(0))).alias("depth"))
    return placed.withColumn("position", F.row_number().over(Window.partitionBy("key", "parent").orderBy("start", F.desc("end"), "id")))


def _unit(key: Column, unit: Column) -> Column:
    return F.concat(F.lit("unit/"), key, F.lit("/"), unit)


def hierarchy_triples(tree: DataFrame) -> DataFrame:
    """Each range as a unit of its parent, or of its manuscript at the top, with its order and depth."""
    above = F.when(F.col("parent").isNull(), graph.iri("manuscript", F.col("key"))).otherwise(_unit(F.col("key"), F.col("parent")))
    return graph.emit(tree, _unit(F.col("key"), F.col("id")), graph.link(graph.TYPE, F.lit("CodicologicalUnit")), graph.link("part_of", above), graph.literal("position", F.col("position"), "xsd:integer"), graph.literal("depth", F.col("depth"), "xsd:integer"), graph.literal("first", F.col("start"), "xsd:integer"), graph.literal("last", F.col("end"), "xsd:integer"))


def volume_sets(members: DataFrame) -> DataFrame:
    """Triples of sets ``set, record, number`` with two volumes or more; a volume of several sets belongs to the smallest."""
    own = members.where("set is not null and record is not null").groupBy("record").agg(F.min_by(F.struct("set", "number"), F.struct("set", "number")).alias("s")).select("record", "s.set", "s.number")
    sizes = own.groupBy("set").agg(F.count("*").alias("n")).where("n >= 2")
    held = own.join(sizes, "set").withColumn("place", F.row_number().over(Window.partitionBy("set").orderBy(F.asc_nulls_last("number"), "record")))
    sets = graph.emit(sizes, graph.iri("set", F.col("set")), graph.link(graph.TYPE, F.lit("MultiVolumeSet")), graph.literal("volumes", F.col("n"), "xsd:integer"))
    volumes = graph.emit(held, graph.iri("manuscript", F.col("record")), graph.link("volume_of", graph.iri("set", F.col("set"))), graph.literal("volume_number", F.col("place"), "xsd:integer"))
    return sets.unionByName(volumes)


def anthologies(works: DataFrame) -> DataFrame:
    """Triples of records ``record, pos, work`` with more than one work: the structure and each work's place."""
    counted = works.groupBy("record").agg(F.count("*").alias("n")).where("n > 1")
    placed = works.join(counted, "record").withColumn("place", F.row_number().over(Window.partitionBy("record").orderBy("pos", "work")))
    whole = F.concat(F.lit("anthology/"), F.col("record").cast("string"))
    structure = graph.emit(counted, whole, graph.link(graph.TYPE, F.lit("AnthologyStructure")), graph.link("structure_of", graph.iri("manuscript", F.col("record"))), graph.literal("works", F.col("n"), "xsd:integer"))
    parts = graph.emit(placed, F.concat(whole, F.lit("/"), F.col("place").cast("string")), graph.link("part_of", whole), graph.link("holds", graph.iri("work", F.col("work"))), graph.literal("position", F.col("place"), "xsd:integer"))
    return structure.unionByName(parts)
