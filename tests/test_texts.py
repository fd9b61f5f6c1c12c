"""Names, windows and spans in texts, and Turtle files, against plain Python."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirelake.operators import search, spans
from quirelake.plans import queries, texts
from quirelake.sources import turtle

DATA = "/root/testdata/sf0.001"


# Windows -------------------------------------------------------------------------


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def every_window(name, context, threshold=0.6):
    at = context.lower().find(name.lower())
    if at >= 0:
        return 1.0, at, at + len(name)
    words = [m.span() for m in re.finditer(r"\S+", context)]
    best = None
    wanted = name.lower().strip()
    for i in range(len(words)):
        for j in range(i, min(i + 9, len(words))):
            window = " ".join(context[a:b] for a, b in words[i : j + 1]).lower()
            score = 2 * common(wanted, window) / (len(wanted) + len(window))
            if score >= threshold and (best is None or score > best[0]):
                best = (score, words[i][0], words[j][1])
    return best


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["ab", "abc", "Xyz", "q", "é中", "de", "\n"]), min_size=1, max_size=5).map(" ".join), st.lists(st.sampled_from(["ab", "ac", "xyz", "q", "é", "中", "de", "f.", " ", "\n"]), max_size=14).map(" ".join), st.sampled_from([0.3, 0.6, 0.9]))
def test_best_window(name, context, threshold):
    got, wanted = search.best_window(name, context, threshold), every_window(name, context, threshold)
    if not name.strip():
        return
    assert (got is None) == (wanted is None)
    if wanted:
        assert got[0] == pytest.approx(wanted[0]) and got[1:] == wanted[1:]


def test_long_names():
    """More letters than one word of bits holds."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(8, 22))) for _ in range(60)]
    for k in range(0, 50, 7):
        name = " ".join(w[:-1] if n % 2 else w for n, w in enumerate(words[k : k + 8]))
        got, wanted = search.best_window(name, " ".join(words)), every_window(name, " ".join(words))
        assert got[1:] == wanted[1:] and got[0] == pytest.approx(wanted[0]) and len(name) > 64
    assert search.best_window("", "x") is None and search.best_window("x", "") is None and search.best_window("x", None) is None


def test_fuzzy_windows_query(spark):
    got = {r["doc_id"]: r for r in queries.QUERIES["fuzzy_windows"](spark, DATA).collect()}
    phrases = {r["item_id"]: re.sub("([a-z])([a-z])([a-z])", r"\1\3", " ".join(re.sub(r"\s+", " ", r["text"]).strip().split(" ")[1:5])) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    n = max(phrases) + 1
    for r in spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id % 4 = 0").collect():
        wanted = every_window(phrases[r["doc_id"] % n], r["text"] or "") if len(r["text"] or "") < 1500 else None
        if wanted:
            own = got[r["doc_id"]]
            assert (own["score"], own["start"], own["end"]) == (round(wanted[0], 6), *wanted[1:])
        elif r["text"] and len(r["text"]) < 1500:
            assert r["doc_id"] not in got


# Names ---------------------------------------------------------------------------


def plain_search(names, text):
    out = []
    for name in {n for n in names if n and len(n) >= 3}:
        if name in text:
            at = text.find(name)
            while at >= 0:
                end = at + len(name)
                if (at == 0 or text[at - 1] in search.BOUNDARIES) and (end == len(text) or text[end] in search.BOUNDARIES):
                    out.append((name, at, end, True))
                at = text.find(name, at + 1)
            continue
        words = [w for w in name.split() if len(w) > 2]
        if len(words) >= 2 and all(w in text for w in words[:2]):
            places = [text.find(w) for w in words[:2]]
            if max(places) - min(places) < 30:
                out.append((name, min(places), max(places) + len(words[-1]), False))
    return out


SIGNS = st.lists(st.sampled_from(["ben", "moses", "mos", "a", "aa", "jacob", " ", " ", ".", "(", "x", "é"]), max_size=25).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["moses", "mos", "aaa", "aa a", "moses ben", "moses ben jacob", "jacob moses", "x", "jacob aaa ben", "ben ben"]), max_size=6), SIGNS)
def test_name_search(names, text):
    own = search.NameSearch(names)
    assert sorted((own.names[k], a, b, e) for k, a, b, e in own.find(text)) == sorted(plain_search(names, text))


def test_dictionaries(spark):
    rows = [(1, "moses ben jacob wrote. moses, jacob"), (2, None), (3, ""), (4, "jacob (the scribe) son of moses"), (5, "x" * 100_000 + " moses"), (5, "moses")]
    names = ["moses", "jacob moses", "moses ben jacob", "ab", None, "moses"]
    df = spark.createDataFrame(rows, "id long, text string")
    dictionary = spark.createDataFrame([(n,) for n in names], "n string")
    wanted = sorted((i, *m) for i, t in rows for m in plain_search([n for n in names if n], t or ""))
    for block in (100, 1):  # one pass, and several
        got = search.dictionary_matches(df, "id", "text", dictionary, "n", block=block)
        assert sorted(map(tuple, got.collect())) == wanted
    assert search.dictionary_matches(df, "id", "text", dictionary.limit(0), "n").count() == 0
    own = spark.createDataFrame([(i, t, names) for i, t in rows] + [(9, "moses", None)], "id long, text string, names array<string>")
    assert sorted(map(tuple, search.record_matches(own, "id", "text", "names").collect())) == wanted


# Spans ---------------------------------------------------------------------------


def plain_votes(proposed):
    groups = []
    for s in proposed:
        for g in groups:
            if any(min(s[1], o[1]) > max(s[0], o[0]) and (min(s[1], o[1]) - max(s[0], o[0])) / min(s[1] - s[0], o[1] - o[0]) >= 0.5 for o in g):
                g.append(s)
                break
        else:
            groups.append([s])
    out = []
    for g in groups:
        votes: dict = {}
        for s in g:
            votes[s[:2]] = votes.get(s[:2], 0) + s[3]
        best = max(votes, key=lambda v: round(votes[v], 9))
        first = next(s for s in g if s[:2] == best)
        out.append((*best, first[2], round(votes[best] / sum(votes.values()), 6), len(g)))
    return out


def test_votes(spark):
    rng = random.Random(2)
    rows, wanted = [], []
    for key in range(40):
        proposed = []
        for _ in range(rng.randint(1, 40)):
            a = rng.randint(0, 60)
            proposed.append((a, a + rng.randint(1, 9), rng.choice("xyz"), rng.choice([0.4, 0.5, 0.6, 1.0])))
        rows += [(key, n, a, b, "PERSON", source, w) for n, (a, b, source, w) in enumerate(proposed)]
        wanted += [(key, a, b, source, conf, n) for a, b, source, conf, n in plain_votes(proposed)]
    df = spark.createDataFrame(rows, 'key long, ord long, start long, "end" long, label string, source string, weight double'.replace('"', "`")).repartition(3)
    got = spans.voted(df).select("key", "start", "end", "source", "confidence", "num_votes")
    assert sorted(map(tuple, got.collect())) == sorted(wanted)
    assert spans.voted(df.limit(0)).count() == 0


def test_hebrew_rules(spark):
    text = "העתיק משה בן יעקב הלוי בשנת רבי דוד"
    df = spark.createDataFrame([("r1", text, ["משה", "משה", "דוד"]), ("r2", None, None), ("r3", "no names", [])], "id string, text string, persons array<string>")
    found = spans.labelled(df, "id", "text", names="persons").collect()
    assert {r["key"] for r in found} == {"r1"}
    by_source: dict = {}
    for r in sorted(found, key=lambda r: r["ord"]):
        by_source.setdefault(r["source"], []).append(text[r["start"] : r["end"]])
    assert by_source["structured_fields"] == ["משה", "משה", "דוד"] and by_source["cross_field"] == ["משה"]
    assert by_source["title"] == ["רבי דוד"] and by_source["patronymic"] == ["העתיק משה בן יעקב הלוי"]
    assert by_source["role_keyword"][0].startswith("העתיק")
    chosen = spans.voted(spans.labelled(df, "id", "text", names="persons"))
    [sample] = spans.training_samples(df, "id", "text", chosen).collect()
    assert sample["tokens"] == text.split() and len(sample["tags"]) == len(sample["tokens"]) and "B-PERSON" in sample["tags"]


def test_rules_of_the_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").where("doc_id < 40")
    rows = {(r["key"], r["start"], r["end"], r["source"]) for r in spans.labelled(docs, "doc_id", "text", texts.RULES).collect()}
    assert rows == {(r["doc_id"], *m.span(), rule.source) for r in docs.collect() for rule in texts.RULES for m in re.finditer(rule.expression, r["text"] or "")}


# Turtle --------------------------------------------------------------------------

DOCUMENT = '''@prefix ex: <http://e/> . # a comment. with stops .
@base <http://b/> .
ex:a a ex:T ; ex:p "x.y"@en-US , "q\\"\\n\\u00e9" , 1.5, -2 , 3e4, true ; ex:q [ ex:r (1 "two" ex:c.d) ; ] ; .
PREFIX z: <http://z/>
z:s z:p """long. "quoted" # no comment .
with a stop .
and ex:a ex:b ex:c .
end""" . <rel> ex:p <#frag> .
[] ex:p _:b1. _:b1 ex:p 'a', \'\'\'b
. """ c\'\'\' .
[ ex:x .5 ] .
@prefix ex: <http://other/> .
ex:a\\.b ex:p "3"^^ex:dt, () .
'''
R = turtle.RDF


def shape(rows):
    """Triples with generated nodes renamed in order of their first place in sorted output."""
    return sorted((s if not s.startswith("_:f") else "_:x", p, o if not o.startswith("_:f") else "_:x", k, d or "", lang or "") for s, p, o, k, d, lang in rows)


WANTED = [
    ("http://e/a", R + "type", "http://e/T", "iri", "", ""), ("http://e/a", "http://e/p", "x.y", "literal", "", "en-US"), ("http://e/a", "http://e/p", 'q"\né', "literal", "", ""),
    ("http://e/a", "http://e/p", "1.5", "literal", turtle.XSD + "decimal", ""), ("http://e/a", "http://e/p", "-2", "literal", turtle.XSD + "integer", ""), ("http://e/a", "http://e/p", "3e4", "literal", turtle.XSD + "double", ""), ("http://e/a", "http://e/p", "true", "literal", turtle.XSD + "boolean", ""),
    ("http://e/a", "http://e/q", "_:x", "bnode", "", ""), ("_:x", "http://e/r", "_:x", "bnode", "", ""),
    ("_:x", R + "first", "1", "literal", turtle.XSD + "integer", ""), ("_:x", R + "first", "two", "literal", "", ""), ("_:x", R + "first", "http://e/c.d", "iri", "", ""), ("_:x", R + "rest", "_:x", "bnode", "", ""), ("_:x", R + "rest", "_:x", "bnode", "", ""), ("_:x", R + "rest", R + "nil", "iri", "", ""),
    ("http://z/s", "http://z/p", 'long. "quoted" # no comment .\nwith a stop .\nand ex:a ex:b ex:c .\nend', "literal", "", ""), ("http://b/rel", "http://e/p", "http://b/#frag", "iri", "", ""),
    ("_:x", "http://e/p", "_:b1", "bnode", "", ""), ("_:b1", "http://e/p", "a", "literal", "", ""), ("_:b1", "http://e/p", 'b\n. """ c', "literal", "", ""), ("_:x", "http://e/x", ".5", "literal", turtle.XSD + "decimal", ""),
    ("http://other/a.b", "http://other/p", "3", "literal", "http://other/dt", ""), ("http://other/a.b", "http://other/p", R + "nil", "iri", "", ""),
]


@pytest.mark.parametrize("chunk", [1, 60, 1 << 20])
def test_read_turtle(spark, tmp_path, chunk):
    """Chunks of a line, of a few lines, and of the whole file."""
    (tmp_path / "a.ttl").write_text(DOCUMENT)
    got = shape(map(tuple, turtle.read_turtle(spark, str(tmp_path / "a.ttl"), scoped=False, chunk_chars=chunk).collect()))
    assert got == sorted(WANTED)


def test_files_and_splits(spark, tmp_path):
    """Many small splits of two files, each with its own prefixes and labels."""
    text = "".join(f'ex:s{k} ex:p """line {k} .\n# {k} """, "{"z" * (k % 50)}" ; ex:q [ ex:r _:n{k % 3} ] .\n' for k in range(400))
    for name in ("one", "two"):
        (tmp_path / f"{name}.ttl").write_text(f"@prefix ex: <http://{name}/> .\n{text}")
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        rows = turtle.read_turtle(spark, str(tmp_path), chunk_chars=500).collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert len(rows) == 2 * 400 * 4
    assert {r["o"] for r in rows if r["s"] == "http://two/s7"} >= {"line 7 .\n# 7 ", "z" * 7}
    labels = {r["o"] for r in rows if r["o_kind"] == "bnode" and r["p"].endswith("/r")}
    assert len(labels) == 6  # three of each file
    assert len({r["s"] for r in rows if r["p"].endswith("/r")}) == 800


def test_not_turtle(spark, tmp_path):
    (tmp_path / "a.ttl").write_text('<s> <p> "open .\n')
    with pytest.raises(Exception, match="not Turtle|expected"):
        turtle.read_turtle(spark, str(tmp_path / "a.ttl")).collect()
    (tmp_path / "b.ttl").write_text("")
    assert turtle.read_turtle(spark, str(tmp_path / "b.ttl")).count() == 0


def test_turtle_round_trip(spark, tmp_path):
    x = "literal"
    rows = [
        ("http://e/a b", "http://e/p", 'a "quote"\\ and\na line\tand\r', x, None, None), ("http://e/a", "http://e/p", "o", x, None, "he"), ("http://e/a", "http://e/p", "5", x, turtle.XSD + "integer", None),
        ("_:n1", "http://e/p", "_:n2", "bnode", None, None), ("_:n2", "http://e/p", "http://e/x<y>", "iri", None, None), ("http://e/a", R + "type", "http://e/T", "iri", None, None), ("http://e/e", "http://e/p", "", x, None, None), ("http://e/e", "http://e/p", '"""', x, None, None), ("http://e/e", "http://e/p", 'ends with a quote\n"', x, None, None),
    ] + [("http://e/hot", "http://e/p", str(k), x, None, None) for k in range(2500)]
    triples = spark.createDataFrame(rows, "s string, p string, o string, o_kind string, datatype string, lang string")
    assert turtle.turtle_blocks(triples).where("s = 'http://e/hot'").count() == 3
    for n, prefixes in enumerate(({}, {"ex": "http://e/", "xsd": turtle.XSD})):
        turtle.write_turtle(triples, str(tmp_path / str(n)), prefixes)
        got = turtle.read_turtle(spark, str(tmp_path / str(n)), scoped=False)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)


def test_training_samples_leave_in_small_batches(spark):
    """The texts of a large batch aren't tokenised all at once."""
    texts = spark.range(500).selectExpr("id AS key", "'Ann Lee of x' AS text").coalesce(1)
    chosen = spark.range(500).selectExpr("id AS key", "0L AS start", "7L AS end", "'P' AS label").coalesce(1)
    seen = []

    class Rows:
        def __init__(self, df):
            self.df = df

        def mapInArrow(self, run, schema):
            import pyarrow as pa

            batch = pa.RecordBatch.from_pylist([r.asDict(recursive=True) for r in self.df.collect()])
            seen.extend(b.num_rows for b in run(iter([batch])))
            return self.df

    from unittest import mock

    with mock.patch("pyspark.sql.classic.dataframe.DataFrame.mapInArrow", lambda df, run, schema: Rows(df).mapInArrow(run, schema)):
        spans.training_samples(texts, "key", "text", chosen)
    assert sum(seen) == 500 and max(seen) <= 64
