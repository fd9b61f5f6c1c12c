"""``python -m quirelake``: formats, counts, conversion and validation from a command line (or under ``spark-submit``)."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from quirelake import convert


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="quirelake", description="Records to graphs, with Spark.")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, about in (("format", "what kind of file it is"), ("count", "how many records it holds")):
        commands.add_parser(name, help=about).add_argument("input")
    rows = commands.add_parser("records", help="records as JSON rows")
    whole = commands.add_parser("convert", help="graph, violations and statistics")
    for one in (rows, whole):
        one.add_argument("input")
        one.add_argument("output")
    whole.add_argument("--ontology", help="Turtle that is merged into the graph")
    whole.add_argument("--shapes", help="a shapes graph in Turtle")
    whole.add_argument("--turtle", action="store_true", help="write Turtle as well")
    whole.add_argument("--annotations", nargs="*", default=[], metavar="KIND=PATH")
    check = commands.add_parser("validate", help="violations of a graph; fails if there is one of severity Violation")
    check.add_argument("input")
    check.add_argument("--shapes")
    return parser.parse_args(given)


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.command == "format":
        print(json.dumps(convert.file_format(spark, a.input)))
    elif a.command == "count":
        print(convert.count_records(spark, a.input))
    elif a.command == "records":
        convert.convert_to_json(spark, a.input, a.output)
    elif a.command == "convert":
        source, kind = convert.select_source(spark, a.input)
        convert.convert(spark, source, a.output, dict(x.split("=", 1) for x in a.annotations), ontology=a.ontology, shapes_path=a.shapes, turtle_too=a.turtle)
        print(f"converted {source} ({kind})")
    else:
        found = convert.validate(spark, a.input, a.shapes)
        counts = {r["severity"]: r["count"] for r in found.groupBy("severity").count().collect()}
        print(json.dumps(counts))
        return int(counts.get("Violation", 0) > 0)
    return 0


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.appName("quirelake").getOrCreate(), arguments()))
