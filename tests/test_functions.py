"""Column functions on small fixtures."""

from pyspark.sql import functions as F

from quirelake.functions import dates, text
from quirelake.operators import corpus, evaluation, graph, matching


def one(spark, rows, schema, *columns):
    return spark.createDataFrame(rows, schema).select(*columns).collect()


def test_dates(spark):
    cases = {"ca. 1350": (1350, 1350, "approximate"), "14th century": (1301, 1400, "century"), "12th-13th cent.": (1101, 1300, "century"), "1450?": (1450, 1450, "uncertain"), "1401-1450": (1401, 1450, "range"), "1401-": (1401, None, "open"), "1480": (1480, 1480, "single"), "תק\"ע (1810)": (1810, 1810, "hebrew with year"), "מאה ט\"ו": (1401, 1500, "hebrew century"), "": None, "no date": None}
    got = {r["s"]: r["d"] for r in one(spark, [(s,) for s in [*cases, None]], "s string", "s", dates.resolve(F.col("s")).alias("d"))}
    for s, wanted in cases.items():
        assert (got[s] and (got[s]["start"], got[s]["end"], got[s]["source"])) == wanted, s
    assert got[None] is None


def test_gematria_and_person_dates(spark):
    r = one(spark, [("תש\"ח", "1138-1204"), ("", "fl. 1500")], "h string, p string", dates.gematria(F.col("h")).alias("g"), dates.person_dates(F.col("p")).alias("d"))
    assert r[0]["g"] == 708 and tuple(r[0]["d"]) == (1138, 1204, None) and tuple(r[1]["d"]) == (None, None, 1500)


def test_names(spark):
    r = one(spark, [("Cohén,  Dávid (Rabbi)",), (None,), ("שָׁלוֹם",)], "n string", text.authority_name(F.col("n")).alias("a"), text.place_name(F.col("n")).alias("p"), text.natural_order(F.lit("Cohen, David, 1900-1950")).alias("o"))
    assert [x["a"] for x in r] == ["cohen david rabbi", None, "שלום"] and r[0]["p"] == "cohen david" and r[0]["o"] == "David Cohen"


def test_text_edges(spark):
    r = one(spark, [("",), (None,), ("short. A longer sentence here! Yet another one?",)], "t string", F.size(text.sentences(F.col("t"))).alias("n"), text.rejection(F.col("t")).alias("why"))
    assert [x["n"] for x in r][2] == 2 and [x["why"] for x in r][:2] == ["empty", "empty"]


def test_sequences(spark):
    rows = [(["a", "b", "c", "d"], ["B-P", "I-P", "O", "I-Q"])]
    r = one(spark, rows, "k array<string>, t array<string>", evaluation.bio_spans(F.col("k"), F.col("t")).alias("s"), evaluation.bio_valid(F.col("t")).alias("v"), evaluation.bmes_to_bio(F.array(F.lit("B-X"), F.lit("M-X"), F.lit("E-X"), F.lit("S-Y"), F.lit("O"))).alias("b"))[0]
    assert [tuple(x) for x in r["s"]] == [("P", 0, 2, "a b"), ("Q", 3, 4, "d")] and not r["v"] and r["b"] == ["B-X", "I-X", "I-X", "B-Y", "O"]
    e = one(spark, [([], [])], "k array<string>, t array<string>", evaluation.bio_spans(F.col("k"), F.col("t")).alias("s"), evaluation.bio_valid(F.col("t")).alias("v"))[0]
    assert e["s"] == [] and e["v"]


def test_overlap_removal(spark):
    spans = [[(0, 5), (3, 20), (18, 22), (30, 31)]]
    r = one(spark, [(spans[0],)], "s array<struct<start:int,end:int>>", evaluation.drop_overlaps(F.col("s")).alias("k"))[0]
    assert [tuple(x) for x in r["k"]] == [(3, 20), (30, 31)]


def test_training_sequences(spark):
    rows = [("x David y", 1, 2, "PER"), ("x David y", 1, 2, "PER")]
    r = corpus.sequences(spark.createDataFrame(rows, "text string, start int, end int, entity_type string"), "text").collect()
    assert [tuple(x) for x in r] == [("x David y", ["x", "David", "y"], ["O", "B-PER", "O"])]


def test_fuzzy_join_is_complete(spark):
    words = ["", "a", "ab", "abc", "abcd", "abxd", "xbcd", "bcda", "kitten", "sitting", "mitten", "written", "שלום", "שלם"]
    a = spark.createDataFrame([(w,) for w in words], "l string")
    b = spark.createDataFrame([(w,) for w in words], "r string")
    got = {(r["l"], r["r"], r["edits"]) for r in matching.within_distance(a, b, "l", "r", 2).collect()}
    wanted = {(r["l"], r["r"], r["e"]) for r in a.crossJoin(b).withColumn("e", F.levenshtein("l", "r")).where("e <= 2").collect()}
    assert got == wanted


def test_interval_join(spark):
    a = spark.createDataFrame([(0, 3), (10, 40), (41, 41)], "s int, e int")
    b = spark.createDataFrame([(3, 9), (39, 41), (100, 101)], "x int, y int")
    got = {tuple(r) for r in matching.interval_join(a, b, ("s", "e"), ("x", "y"), 8).collect()}
    assert got == {(0, 3, 3, 9), (10, 40, 39, 41), (41, 41, 39, 41)}


def test_empty_graph(spark):
    empty = spark.createDataFrame([], graph.TRIPLE)
    n, e, p = graph.node_tables(empty, ["A"])
    assert n.count() == e.count() == p.count() == graph.edge_summary(n, e).count() == 0
    assert graph.bgp(empty, [("?a", "p", "?b"), ("?b", "q", "?c")]).count() == 0


def test_stream(spark, tmp_path):
    from quirelake.streaming import stages

    spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:01:00"), ("b", "2024-01-01 02:00:00")], "k string, t string").write.json(str(tmp_path / "in"))
    stream = stages.read_stream(spark, str(tmp_path / "in"), "k string, t timestamp")
    stages.write_stream(stages.first_arrivals(stream, "k", "t"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
