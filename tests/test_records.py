"""Sources, field extraction and the graph of records, on small fixtures."""

from quirelake.operators import fields, quality, records
from quirelake.sources import files, marc


def iso2709(number: str, data: list[tuple[str, str]]) -> bytes:
    """A record of control fields (tag, value) and data fields (tag, ``$avalue$bvalue``)."""
    body, directory, at = b"", b"", 0
    for tag, value in [("001", number), *data]:
        raw = value.encode() if tag < "010" else b"  " + b"".join(b"\x1f" + p.encode() for p in value.split("$")[1:])
        raw += b"\x1e"
        directory += f"{tag}{len(raw):04d}{at:05d}".encode()
        body += raw
        at += len(raw)
    base = 24 + len(directory) + 1
    size = base + len(body) + 1
    return f"{size:05d}nam a22{base:05d} a 4500".encode() + directory + b"\x1e" + body + b"\x1d"


DATA = [
    ("008", "200115s1407    it            000 0 heb d"), ("100", "$aMaimonides, Moses$d1138-1204$eauthor$0n1"), ("245", "$aMishneh Torah /$bpart one :"), ("260", "$aFlorence :$c1407"), ("300", "$a120 leaves$c25 x 18 cm"), ("340", "$aparchment and paper"),
    ("500", "$aSephardic square script. Colophon: written by the scribe. f. 1r-12v"), ("505", "$aFirst tract (f. 1r-4v) ; Second tract"), ("856", "$uhttp://example.org/1"),
]


def write(tmp_path, name, content):
    path = tmp_path / name
    path.write_bytes(content)
    return str(path)


def test_marc_reader_keeps_good_records_and_names_bad_ones(spark, tmp_path):
    path = write(tmp_path, "r.mrc", iso2709("r1", DATA) + b"00030nam a22xxxxx a 4500123456\x1d" + iso2709("r2", [("245", "$aOther")]))
    got = marc.read_marc(spark, path)
    assert {r["control_number"] for r in got.where("error is null").collect()} == {"r1", "r2"}
    assert got.where("error is not null").count() == 1
    assert marc.sniff(spark, path)[0] == "marc"


def test_extraction_and_graph(spark, tmp_path):
    path = write(tmp_path, "r.mrc", iso2709("r1", DATA) + iso2709("r2", [("245", "$aOther")]))
    long = marc.read_any(spark, path)
    got = {r["control_number"]: r for r in fields.extract(long).collect()}
    r = got["r1"]
    assert (r["title"], r["subtitle"], r["place"], r["extent"]) == ("Mishneh Torah", "part one", "Florence", 120)
    assert r["fixed"]["date_start"] == 1407 and r["fixed"]["language"] == "heb"
    assert (r["dimensions"]["height_mm"], r["dimensions"]["width_mm"]) == (250, 180)
    assert r["materials"] == ["parchment", "paper"] and r["script_type"] == "Sephardic" and r["script_mode"] == "square"
    assert [c["title"] for c in r["contents"]] == ["First tract", "Second tract"] and r["contents"][0]["folio_range"] == "1r-4v"
    assert r["dates"]["start"] == 1407 and r["authors"][0]["authority_id"] == "n1"
    assert got["r2"]["title"] == "Other" and got["r2"]["authors"] == [] and got["r2"]["dates"] is None
    triples = records.record_triples(fields.extract(long))
    assert triples.count() == triples.dropDuplicates().count()
    found = {(t["s"], t["p"], t["o"]) for t in triples.collect()}
    assert ("person/n1", "birth_year", "1138") in found and ("manuscript/r1", "digital_url", "http://example.org/1") in found
    assert quality.http_urls(triples).count() == 0
    assert {v["focus_node"] for v in quality.validate(triples).where("path = 'time_span'").collect()} == {"production/r2"}
    people = records.persons(fields.extract(long), "control_number")
    assert [p["name"] for p in people.collect()] == ["Moses Maimonides"]
    assert {(s["property"], s["value"]) for s in records.statements(fields.extract(long)).collect()} >= {("P571", "+1407-00-00T00:00:00Z"), ("P186", "paper")}


def test_delimited_reader(spark, tmp_path):
    path = write(tmp_path, "r.csv", "001,245$a,700$a,odd\nc1,Title,One | Two,note\n,\"Other, quoted\",,\n".encode())
    rows = marc.read_any(spark, path).collect()
    assert {(r["tag"], r["value"]) for r in rows if r["control_number"] == "c1"} == {("001", "c1"), ("245", "Title"), ("700", "One"), ("700", "Two"), ("500", "note")}
    assert any(r["value"] == "Other, quoted" and r["control_number"].startswith("csv_row_") for r in rows)


def test_marcxml_reader(spark, tmp_path):
    xml = '<collection><record><controlfield tag="001">0012</controlfield><datafield tag="100" ind1="1" ind2=" "><subfield code="a">Cohen, David,</subfield><subfield code="d">1900-</subfield></datafield><datafield tag="400" ind1="1" ind2=" "><subfield code="a">כהן, דוד</subfield><subfield code="9">heb</subfield></datafield></record></collection>'
    long = marc.read_any(spark, write(tmp_path, "a.xml", xml.encode()))
    got = {(r["authority_id"], r["name"], r["script"], r["preferred"], r["entity_type"]) for r in marc.authority_records(long).collect()}
    assert got == {("0012", "Cohen, David", "lat", True, "person"), ("0012", "כהן, דוד", "heb", False, "person")}


def test_ntriples_round_trip(spark, tmp_path):
    rows = [("s1", "p", 'a "b" \\ c', "literal", "xsd:string", None), ("s1", "q", "o", "iri", None, None), ("_:b", "p", "שלום", "literal", None, "he")]
    triples = spark.createDataFrame(rows, "s string, p string, o string, o_kind string, datatype string, lang string")
    files.write_text(files.ntriples(triples), str(tmp_path / "nt"))
    assert sorted(map(tuple, files.read_ntriples(spark, str(tmp_path / "nt")).collect()), key=str) == sorted(rows, key=str)


def test_tagged_sentences(spark, tmp_path):
    got = files.read_tagged(spark, write(tmp_path, "t.txt", b"a B-PER\nb E-PER\n\nc O\n")).orderBy("sentence").collect()
    assert [(r["tokens"], r["tags"]) for r in got] == [(["a", "b"], ["B-PER", "E-PER"]), (["c"], ["O"])]


def test_annotations(spark, tmp_path):
    path = write(tmp_path, "f.csv", b"manuscript_id,unit_id,is_foreign,status,addition_period,folio_range\nm,u,Yes,x,y,1-2\nm,v,no,x,y,\n")
    assert [r["is_foreign"] for r in files.read_annotations(spark, path, "foreign_unit").orderBy("unit_id").collect()] == [True, False]


def test_sniff_of_a_large_file(spark, tmp_path):
    """A (sparse) file of more than 2 GB: only its head is read."""
    path = tmp_path / "large.csv"
    with open(path, "wb") as f:
        f.write("001,245$a\nא,x\n".encode())
        f.truncate(2**31 + 10)
    assert marc.sniff(spark, str(path)) == ("delimited", ",", "UTF-8")


def test_folds_number_a_label_in_groups(spark):
    import hashlib

    from quirelake.operators import evaluation

    rows = [(i, "ab"[i % 2] if i % 7 else None) for i in range(3000)]
    got = evaluation.folds(spark.createDataFrame(rows, "k long, label string"), "label", "k")
    wanted, seen = {}, {}
    for i, label in sorted(rows, key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()):
        wanted[i] = seen.setdefault(label, 0) % 5
        seen[label] += 1
    assert {r["k"]: r["fold"] for r in got.collect()} == wanted
    assert "row_number() windowspecdefinition(label" in (plan := got._jdf.queryExecution().analyzed().toString()) and "__salt" in plan.split("row_number()")[1].split("ASC")[0]


def test_convert(spark, tmp_path):
    from quirelake import convert

    table = tmp_path / "records.csv"
    table.write_text("001,245$a,260$c,650$a\n1,Song,1407,Poetry|Law\n2,Law,,\n", encoding="utf-8")
    assert convert.file_format(spark, str(table))["format"] == "delimited"
    assert convert.count_records(spark, str(table)) == 2
    convert.convert(spark, str(table), str(tmp_path / "out"))
    graph = convert.files.read_ntriples(spark, str(tmp_path / "out" / "graph"))
    assert graph.where("p = 'record_id'").count() == 2
    assert {r["node_type"]: r["n"] for r in spark.read.json(str(tmp_path / "out" / "statistics")).collect()}["Manuscript"] == 2
    assert convert.validate(spark, str(tmp_path / "out" / "graph")).columns == ["focus_node", "path", "severity", "message"]
    convert.convert_to_json(spark, str(table), str(tmp_path / "rows"))
    assert spark.read.json(str(tmp_path / "rows")).count() == 2
