"""Entry points and command line: ontology, shapes, Turtle, sources."""

import json

import pytest

from quirelake import __main__ as command
from quirelake import convert

TABLE = '001,245$a,100$a,856$u\nr1,"First title /","Author, An",https://a.example/1\nr2,Second,,not a url\n'
SHAPES = '@prefix sh: <http://www.w3.org/ns/shacl#> . <S> a sh:NodeShape ; sh:targetClass <Manuscript> ; sh:property [ sh:path <digital_url> ; sh:pattern "^https?://" ; sh:message "not a web address" ] .'


@pytest.fixture
def table(tmp_path):
    (tmp_path / "records.csv").write_text(TABLE)
    (tmp_path / "ontology.ttl").write_text('@prefix o: <http://o/> . o:Manuscript a o:Class ; o:label "Manuscript"@en, "כתב יד"@he .')
    (tmp_path / "shapes.ttl").write_text(SHAPES)
    return tmp_path


def test_command_line(spark, table, capsys):
    run = lambda *given: command.run(spark, command.arguments([str(g) for g in given]))
    assert run("format", table / "records.csv") == 0 and json.loads(capsys.readouterr().out)["format"] == "delimited"
    assert run("count", table / "records.csv") == 0 and capsys.readouterr().out.strip() == "2"
    assert run("convert", table / "records.csv", table / "out", "--ontology", table / "ontology.ttl", "--shapes", table / "shapes.ttl", "--turtle") == 0
    found = spark.read.json(str(table / "out" / "violations")).collect()
    assert [(r["message"], r["value"]) for r in found] == [("not a web address", "not a url")]
    triples = convert.files.read_ntriples(spark, str(table / "out" / "graph"))
    assert {r["lang"] for r in triples.where("s = 'http://o/Manuscript'").collect()} == {None, "en", "he"}
    again = convert.turtle.read_turtle(spark, str(table / "out" / "turtle"), scoped=False)
    key = lambda df: sorted(str((r["s"], r["p"], r["o"], r["lang"])) for r in df.distinct().collect())
    assert key(again) == key(triples)
    capsys.readouterr()
    assert run("validate", table / "out" / "turtle", "--shapes", table / "shapes.ttl") == 1 and json.loads(capsys.readouterr().out) == {"Violation": 1}
    assert run("records", table / "records.csv", table / "rows") == 0 and spark.read.json(str(table / "rows")).count() == 2


def test_sources(spark, tmp_path):
    raw = tmp_path / convert.ENRICHED
    raw.write_text("[]")
    assert convert.select_source(spark, str(raw)) == (str(raw), "raw")
    reviewed = tmp_path / convert.REVIEWED
    reviewed.write_text("[]")
    assert convert.select_source(spark, str(raw)) == (str(reviewed), "reviewed") == convert.select_source(spark, str(reviewed))
    assert convert.select_source(spark, "x/y.mrc") == ("x/y.mrc", "records") and convert.select_source(spark, "other.json")[1] == "raw"
    with pytest.raises(ValueError):
        convert.select_source(spark, f"a{convert.REVIEW_OF_ITEMS}")
