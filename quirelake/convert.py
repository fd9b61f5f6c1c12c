"""From files of records to a graph, a report and rows: the library's entry points.

Every function reads and writes through Spark, so that paths may be folders,
patterns or remote stores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.operators import fields, graph, quality, records, shapes
from quirelake.sources import files, marc, turtle

VERSION = "1"


def file_format(spark: SparkSession, path: str) -> dict[str, str]:
    """``format``, ``separator``, ``encoding`` and the library's ``version``."""
    kind, sep, encoding = marc.sniff(spark, path)
    return {"format": kind, "separator": sep, "encoding": encoding, "version": VERSION}


def count_records(spark: SparkSession, path: str) -> int:
    """The number of records: of separators or rows, without parsing what they hold."""
    kind, sep, encoding = marc.sniff(spark, path)
    if kind == "marc":
        return spark.read.text(path, lineSep="\x1d").where(F.trim("value") != "").count()
    if kind == "delimited":
        return spark.read.csv(path, header=True, sep=sep, encoding=encoding, multiLine=True, quote='"', escape='"').count()
    return spark.read.text(path).select(F.sum(F.regexp_count("value", F.lit(r"<(?:\w+:)?record[\s>]")))).first()[0] or 0


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One typed row for each record of a file in any known format."""
    return fields.extract(marc.read_any(spark, path))


def read_graph(spark: SparkSession, path: str, annotations: dict[str, str] | None = None) -> DataFrame:
    """The graph of a file's records, with ``annotations`` (kind to path of delimited files) merged."""
    graphs = [records.record_triples(read_records(spark, path))]
    for kind, place in (annotations or {}).items():
        columns = files.read_annotations(spark, place, kind).columns
        graphs.append(records.annotation_triples(files.read_annotations(spark, place, kind), kind, columns[0], columns[1:]))
    return graph.merge(*graphs)


def convert(spark: SparkSession, path: str, out: str, annotations: dict[str, str] | None = None, *, ontology: str | None = None, shapes_path: str | None = None, turtle_too: bool = False) -> None:
    """Write ``{out}/graph`` (N-Triples), ``{out}/violations`` and ``{out}/statistics`` (JSON).

    ``ontology`` (Turtle) is merged into the graph; ``shapes_path`` (Turtle) replaces
    the documented shapes; ``turtle_too`` writes ``{out}/turtle`` as well.
    """
    triples = read_graph(spark, path, annotations)
    if ontology:
        triples = graph.merge(triples, turtle.read_turtle(spark, ontology))
    files.write_text(files.ntriples(triples), f"{out}/graph")
    # What follows reads the written graph, not the records again.
    written = files.read_ntriples(spark, f"{out}/graph")
    if turtle_too:
        turtle.write_turtle(written, f"{out}/turtle")
    violations_of(spark, written, shapes_path).write.json(f"{out}/violations")
    graph.counts_by(written.where(F.col("p") == graph.TYPE), "o").withColumnRenamed("o", "node_type").write.json(f"{out}/statistics")


def violations_of(spark: SparkSession, triples: DataFrame, shapes_path: str | None = None) -> DataFrame:
    """What a graph breaks: of a shapes graph, or of the documented shapes."""
    if not shapes_path:
        return quality.validate(triples)
    lines = spark.read.option("wholetext", True).text(shapes_path).collect()  # a configuration file
    return shapes.validate(triples, [x for r in lines for x in shapes.read_shapes(r["value"])])


#: A stage's file, the one that a user has reviewed, and what ends the name of a review of items.
ENRICHED, REVIEWED, REVIEW_OF_ITEMS = "authority_enriched.json", "authority_enriched_reviewed.json", "_wikidata_verified.json"


def select_source(spark: SparkSession, path: str) -> tuple[str, str]:
    """The file that a graph is built from, and what it is: a reviewed file goes before the raw one beside it."""
    folder, _, name = path.rpartition("/")
    if name.endswith(REVIEW_OF_ITEMS):
        raise ValueError(f"{name} is a review of items, not a source of records")
    if name == ENRICHED:
        beside = f"{folder}/{REVIEWED}" if folder else REVIEWED
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(beside)
        found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
        return (beside, "reviewed") if found else (path, "raw")
    if name == REVIEWED:
        return path, "reviewed"
    return path, "raw" if name.lower().endswith(".json") else "records"


def convert_to_json(spark: SparkSession, path: str, out: str) -> None:
    """Write the records of a file as JSON rows."""
    read_records(spark, path).write.json(out)


def validate(spark: SparkSession, path: str, shapes_path: str | None = None) -> DataFrame:
    """``focus_node, path, severity, message`` of a file of N-Triples, or of Turtle by its ending."""
    triples = turtle.read_turtle(spark, path) if path.endswith((".ttl", "/turtle")) else files.read_ntriples(spark, path)
    return violations_of(spark, triples, shapes_path)
