"""Graphs as nested records, and back: the inverse of ``graph.emit``.

A frame lists fields: ``Field(name, predicate)`` for a literal, ``many=True`` for
all of them, ``frame=`` for a nested record behind a link.  Records are put
together from the bottom up: every frame reads its own predicates only, in one
grouping by subject, and joins the frames below it by the links' targets.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.operators import graph
from quirelake.sources.tables import written


class Field(NamedTuple):
    name: str
    predicate: str
    many: bool = False
    frame: Frame | None = None
    datatype: str = "xsd:string"
    lang: str | None = None


class Frame(NamedTuple):
    """Records of subjects of a type (of any, if None)."""

    fields: tuple[Field, ...]
    node_type: str | None = None


def _value(f: Field) -> Column:
    held = F.when((F.col("p") == f.predicate) & ((F.col("lang") == f.lang) if f.lang else F.lit(True)), F.col("o"))
    return (F.array_sort(F.collect_set(held)) if f.many else F.min(held)).alias(f.name)


def framed(triples: DataFrame, frame: Frame) -> DataFrame:
    """``id`` and one column a field; a field that a subject lacks is null, or an empty array.

    A single-valued field with several values takes the smallest.
    """
    flat = [f for f in frame.fields if f.frame is None]
    nested = [f for f in frame.fields if f.frame is not None]
    wanted = [f.predicate for f in flat]
    linked = [f.predicate for f in nested]
    rows = triples.where(F.col("p").isin(*wanted, *linked, *[graph.TYPE] * bool(frame.node_type)))
    # Types of other frames' nodes say nothing here, and would be grouped with all that is typed.
    held = F.col("p").isin(*wanted) if wanted else F.lit(False)
    if frame.node_type:
        held |= (F.col("p") == graph.TYPE) & (F.col("o") == frame.node_type)
    own = rows.where(held) if wanted or frame.node_type else rows
    typed = [F.bool_or((F.col("p") == graph.TYPE) & (F.col("o") == frame.node_type)).alias("__typed")] if frame.node_type else []
    out = own.groupBy(F.col("s").alias("id")).agg(*map(_value, flat), *typed, *([F.count("*").alias("__n")] if not flat and not typed else []))
    out = out.where("__typed").drop("__typed") if typed else out.drop("__n")
    for f in nested:
        below = framed(triples, f.frame)
        links = rows.where((F.col("p") == f.predicate) & (F.col("o_kind") != "literal")).select(F.col("s").alias("__s"), F.col("o").alias("id"))
        both = links.join(below, "id").select("__s", F.struct("id", *(x.name for x in f.frame.fields)).alias("__r"))
        held = both.groupBy("__s").agg((F.array_sort(F.collect_set("__r")) if f.many else F.min("__r")).alias(f.name))
        out = out.join(held.withColumnRenamed("__s", "id"), "id", "left")
        if f.many:
            out = out.withColumn(f.name, F.coalesce(f.name, F.array()))
    return out.select("id", *(f.name for f in frame.fields))


def _statement(f: Field):
    """A value of a field, or a nested record's id, as the statement it was read from."""
    none = F.lit(None).cast("string")
    if f.frame is None:
        return lambda v: graph.literal(f.predicate, v, f.datatype, f.lang)
    return lambda v: F.struct(F.lit(f.predicate).alias("p"), v.alias("o"), F.when(F.startswith(v, F.lit("_:")), "bnode").otherwise("iri").alias("o_kind"), none.alias("datatype"), none.alias("lang"))


def _nodes(records: DataFrame, frame: Frame) -> Iterator[tuple[Frame, DataFrame]]:
    """Each frame with its records, those of the frame itself first; records below stand in ``records`` as often as they are linked to."""
    yield frame, records
    for f in frame.fields:
        if f.frame is not None:
            below = records.select(F.explode(f.name).alias("r")).select("r.*") if f.many else records.where(F.col(f.name).isNotNull()).select(f"{f.name}.*")
            yield from _nodes(below, f.frame)


def _own(records: DataFrame, frame: Frame) -> DataFrame:
    """What a frame itself says of its subjects; nested records are their ids alone."""
    return records.select("id", *(F.col(f.name)["id"].alias(f.name) if f.frame else F.col(f.name) for f in frame.fields))


def _statements(own: DataFrame, frame: Frame, chosen: Callable[[str], bool]) -> Iterator[DataFrame]:
    """A frame's statements by the chosen predicates."""
    fields = [f for f in frame.fields if chosen(f.predicate)]
    single = [graph.link(graph.TYPE, F.lit(frame.node_type))] if frame.node_type and chosen(graph.TYPE) else []
    single += [_statement(f)(F.col(f.name)) for f in fields if not f.many]
    if single:
        yield graph.emit(own, F.col("id"), *single)
    # Values of an array are rows first: a statement made inside an array costs several times as much.
    for f in fields:
        if f.many:
            yield graph.emit(own.select("id", F.explode(f.name).alias("v")), F.col("id"), _statement(f)(F.col("v")))


def _shared(frames: list[Frame]) -> set[str]:
    """Predicates by which two frames, or two fields of one, may make the same triple."""
    made = Counter((graph.TYPE, x.node_type) for x in frames if x.node_type)
    made.update((f.predicate, None) for x in frames for f in x.fields)
    return {p for (p, _), n in made.items() if n > 1 or (p == graph.TYPE and (p, None) in made)}


def unframed(records: DataFrame, frame: Frame, unique: bool = False) -> DataFrame:
    """The triples that ``framed`` read, of the records and of all that are nested in them; each once.

    ``unique`` says that the records are as ``framed`` makes them: one for each subject,
    without a value twice, and the same wherever the subject is nested.  Then short rows
    of what is nested are made distinct, and of triples only those that two fields may share.
    """
    [first, *below] = ((x, _own(r, x)) for x, r in _nodes(written(records, "records"), frame))
    nodes = [first, *((x, own.distinct()) for x, own in below)]
    shared = _shared([x for x, _ in nodes])
    made = lambda chosen: [s for x, own in nodes for s in _statements(own, x, chosen)]
    once, again = (made(lambda p: p not in shared), made(lambda p: p in shared)) if unique else ([], made(lambda p: True))
    if again:
        once.append(reduce(DataFrame.unionAll, again).distinct())
    return reduce(DataFrame.unionAll, once)
