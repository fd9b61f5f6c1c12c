"""Edit distances, resolution and snapshots against plain Python, and their edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from quirelake.operators import biodata, cascade, matching, resolution


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_within_distance_loses_no_pair(spark, distance):
    rng = random.Random(distance)
    draw = lambda: sorted({"".join(rng.choice("ab") for _ in range(rng.randint(0, 10))) for _ in range(250)})
    left, right = draw(), draw()
    a = spark.createDataFrame([(x, k % 3) for k, x in enumerate([*left, None, left[0]])], "x string, n int")
    b = spark.createDataFrame([(y,) for y in [*right, None]], "y string")
    got = sorted((r["x"], r["y"], r["edits"]) for r in matching.within_distance(a, b, "x", "y", distance).collect())
    assert got == sorted((x, y, e) for x in [*left, left[0]] for y in right if abs(len(x) - len(y)) <= distance and (e := edits(x, y)) <= distance)


MENTION = "record string, seq long, pos int, name string, viaf_uri string, authority_id string, role string"
ENTRY = "record string, list int, pos int, name string, viaf_uri string, authority_id string, birth int, death int, dates string, name_type string, gnd_id string, lc_id string, isni string, bnf_id string"


def test_persons(spark):
    viaf = "https://viaf.org/viaf/12345678"
    mentions = [
        ("r2", 2, 0, "Second, Form", None, "a1", "owner"), ("r1", 1, 1, "First, Form.", viaf, "a1", "scribe"), ("r1", 1, 0, '"', viaf, None, "author"), ("r3", 3, 0, "Anonymous.", None, "a2", "author"), ("r3", 3, 1, "הרב", None, "a3", "author"),
        ("r3", 3, 2, "Plain Name", None, None, "author"), ("r4", 4, 0, "Known By Entry", None, "", "author"), ("r5", 5, 0, "Town Library", None, "a5", "owner"), ("r6", 6, 0, None, None, "a6", "author"), ("r7", 7, 0, "משה בן יעקב", None, "a7", None),
    ]
    entries = [
        ("r1", 2, 0, "x", "", "a1", None, None, "1500?-1560", "", "", "", "", ""), ("r1", 0, 0, "First one", "", "", None, None, "no years", "", "", "", "", ""), ("r1", 1, 0, "Firstly", "", "", None, 1599, "", "", "", "", "", ""),
        ("r5", 2, 0, "x", "", "a5", 1400, None, "", "", "", "", "", ""), ("r7", 2, 1, "x", "", "a7", None, None, "1100 – 1170", "", "", "", "", ""), ("r7", 2, 0, "y", "", "zz", 1, 2, "", "", "", "", "", ""),
    ]
    items, keys = resolution.persons(spark.createDataFrame(mentions, MENTION), spark.createDataFrame(entries, ENTRY))
    got = {r["local_id"]: r for r in items.collect()}
    assert set(got) == {"mazal:a1", "mazal:a5", "mazal:a7"}
    one = got["mazal:a1"]
    # The first record decides; its list of authors has no year, so that of contributors does.
    assert (one["label"], one["record"], one["mentions"], one["birth"], one["death"], one["viaf_id"], one["role"]) == ("Form First", "r1", 2, None, 1599, "12345678", "scribe")
    assert got["mazal:a5"]["organisation"] and got["mazal:a5"]["birth"] is None
    assert (got["mazal:a7"]["birth"], got["mazal:a7"]["death"], got["mazal:a7"]["label_lang"]) == (1100, 1170, "he")
    reasons = {r["key"]: r["reason"] for r in keys.collect()}
    assert reasons["viaf:12345678"] == "short" and reasons["mazal:a2"] == "anonymous" and reasons["mazal:a3"] == "role or town" and reasons["name:plain_name"] == "no identifier" and reasons["mazal:a6"] == "short"
    linked = resolution.mention_items(spark.createDataFrame(mentions, MENTION), keys).collect()
    assert len(linked) == len(mentions) and {r["name_string"] for r in linked if r["reason"] == "no identifier"} == {"Plain Name", "Known By Entry"}
    empty = resolution.persons(spark.createDataFrame([], MENTION), spark.createDataFrame([], ENTRY))
    assert empty[0].count() == 0 and empty[1].count() == 0


def test_words(spark):
    rows = [("קובץ בקבלה.", True), ("קובץ ארוך מאד של חיבורים רבים ושונים", False), ("קבץ", True), ("Bible", False), (None, False)]
    df = spark.createDataFrame(rows, "t string, wanted boolean")
    assert [r[0] for r in df.select(resolution.is_placeholder_title(F.col("t")) == F.col("wanted")).collect()] == [True] * 5
    described = spark.createDataFrame([("scribe", "توفي 1013", False, "scribe (1013)"), ("", "", False, "person associated with Hebrew manuscripts"), ("OWNER", None, False, "Hebrew manuscript owner"), (None, "1200-1280", True, "organization (1200-1280)"), ("x", "1200", False, "person (1200)")], "role string, dates string, org boolean, wanted string")
    assert all(r[0] == r[1] for r in described.select(resolution.person_description(F.col("role"), F.col("dates"), F.col("org")), "wanted").collect())


def test_biodata_of_nothing(spark):
    row = spark.createDataFrame([(None,)], "json string").select(biodata.of_cluster(F.col("json")).alias("b")).first()["b"]
    assert (row["dates"], row["places"], row["names"], row["occupations"], row["notes"]) == ({}, {}, {}, [], [])
    two = spark.createDataFrame([('{"viafID":"7","birthDate":"1100","mainHeadings":{"data":[{"text":"Moses"},{"text":"משה"}]}}', '{"viafCluster":{"viafID":"8","birthDate":"1101","mainHeadings":{"data":{"text":"Moses"}}}}')], "a string, b string")
    out = two.select(biodata.compared(biodata.of_cluster(F.col("a")), biodata.of_cluster(F.col("b"))).alias("c")).first()["c"]
    assert (out["differing_dates"], out["shared_names"]) == (["birth"], ["Moses"])


def test_late_items_give_way(spark):
    mentions = spark.createDataFrame([(1, "moses", None, "author", "person", 1500), (2, "nobody here", None, "author", "person", 1500), (3, "aaron", None, "author", "person", None)], "mention long, name string, dates string, role string, kind string, year int")
    authority = spark.createDataFrame([("a1", "moses", None, "Moses"), ("a9", "aaronn", None, None)], "id string, name string, dates string, preferred_lat string")
    clusters = spark.createDataFrame([], "viaf_id string, name string, name_type string, birth int, death int, preferred_lat string")
    items = spark.createDataFrame([("Q138000001", "moses", None, "a1", "person", 1100), ("Q7", "moses", "12345678", None, "person", 1100)], "qid string, name string, viaf_id string, authority_id string, kind string, birth int")
    got = {r["mention"]: r for r in cascade.match_people(mentions, authority, clusters, items).collect()}
    assert (got[1]["qid"], got[1]["viaf_id"], got[1]["path"], got[1]["confidence"]) == ("Q7", "12345678", "strict", "high")
    assert (got[2]["source"], got[2]["confidence"], got[2]["qid"]) == ("marc_only", "low", None)
    assert (got[3]["authority_id"], got[3]["path"], got[3]["source"]) == ("a9", "near", "mazal")


def test_interval_join(spark):
    """Points, short and very long intervals, negative starts, on both sides."""
    rng = random.Random(8)

    def draw(n):
        out = []
        for k in range(n):
            a = rng.randint(-300, 300)
            out.append((k, a, a + rng.choice([0, 0, 1, 3, 7, 8, 9, 60, 500, 100_000])))
        return out

    left, right = [*draw(150), (900, 5, 4)], draw(150)
    a, b = spark.createDataFrame(left, "i int, s long, e long"), spark.createDataFrame(right, "j int, t long, u long")
    got = sorted((r["i"], r["j"]) for r in matching.interval_join(a, b, ("s", "e"), ("t", "u"), 8).collect())
    assert got == sorted((i, j) for i, s, e in left for j, t, u in right if s <= u and t <= e and s <= e)
    assert matching.interval_join(a, b.limit(0), ("s", "e"), ("t", "u"), 8).count() == 0


def test_overlapping_names(spark):
    rng = random.Random(9)
    draw = lambda: [" ".join(rng.choice(["ben", "ben", "ben", "moses", "jacob", "of", "fez", "tunis"]) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    left, right = [*draw(), "", None], [*draw(), "x"]
    got = sorted(map(tuple, matching.overlapping_names(*(spark.createDataFrame([(n,) for n in s], "name string") for s in (left, right))).collect()))

    def alike(a, b):
        x, y = ({w for w in (s or "").split() if len(w) >= 2} for s in (a, b))
        return len(x & y) >= 2 or (bool(x & y) and len(x & y) == min(len(x), len(y)))

    assert got == sorted({(a, b) for a in left for b in right if alike(a, b)})


def test_closure_and_occurrences(spark):
    from quirelake.operators import corpus, graph

    edges = [(k, k + 1) for k in range(20)] + [(30, 31), (31, 30), (5, 30), (1, None)]
    got = {tuple(r) for r in graph.closure(spark.createDataFrame(edges, "child long, parent long")).collect()}
    reach = {(a, b) for a, b in edges if b is not None}
    while more := {(a, d) for a, b in reach for c, d in reach if b == c} - reach:
        reach |= more
    assert got == reach
    rows = [(1, r"a\E b a\E b", r"a\E"), (2, "aaa", "aa"), (3, "xyx", "x"), (4, None, "x"), (5, "x", None), (6, "x", ""), (7, "😀x😀x", "x")]
    found = corpus.occurrences(spark.createDataFrame(rows, "k int, c string, n string"), "c", "n")
    assert sorted((r["k"], r["start"], r["end"]) for r in found.collect()) == [(1, 0, 3), (1, 6, 9), (2, 0, 2), (3, 0, 1), (3, 2, 3), (7, 1, 2), (7, 3, 4)]
