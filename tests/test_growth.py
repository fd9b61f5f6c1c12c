"""Work that grows no faster than the input: what is found once, and dealt to all tasks."""

from pyspark.sql import functions as F

from quirelake.operators import biodata, fields, graph, search
from quirelake.plans import queries

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cluster_body_is_found_once(spark):
    rows = spark.createDataFrame([('{"viafCluster":{"viafID":7,"mainHeadings":{"data":{"text":"A"}},"birthDate":"0","x400s":{"x400":{"datafield":{"subfield":{"#text":"B"}}}}}}',), ("no json",), (None,)], "j string")
    found = rows.select(biodata.of_cluster(F.col("j")).alias("b"))
    assert plan(found).count("get_json_object") <= 16
    one, bad, none = (r["b"] for r in found.collect())
    assert one["dates"] == {} and one["names"] == {"lat": ["A", "B"]} and one["notes"] == ["VIAF: 7"]
    assert bad == none and bad["names"] == {} and bad["notes"] == []


def test_clusters_are_dealt_to_all_tasks(spark):
    assert "REPARTITION_BY_NUM" in plan(queries.QUERIES["cluster_biodata"](spark, DATA))


def test_numbered_contents_shuffle_nothing(spark):
    assert "Exchange" not in plan(queries.QUERIES["numbered_contents"](spark, DATA))


def test_numbered_contents_search_a_text_once_for_each_form(spark):
    rows = spark.createDataFrame([("1) דף [2]א-[4]ב: one.\n\n2) דף 5-6:\n7) x",), ("1) a: b..\n2) דף 3א-4 c\n",), ("1)",), ("",), (None,)], "v string")
    found = rows.select(fields.numbered_contents(F.col("v")).alias("c"))
    assert plan(found).count("regexp_extract_all") == 2
    assert [r["c"] and [tuple(x) for x in r["c"]] for r in found.collect()] == [
        [(1, "one", "2r-4v", "2r", "4v"), (2, "7) x", "5-6", "5", "6")],
        [(1, "b", None, None, None), (2, "דף 3א-4 c", "3r-4", None, None)],
        [], [], None,
    ]


def test_windows_of_texts_side_by_side():
    """Many short texts in one block: each as if searched alone, and in steps shared by all."""
    pairs = [("rvr bank", f"{'x ' * (k % 5)}the river bank {k}") for k in range(200)] + [("", "a"), ("abc", None), ("longer name " * 8, "some longr name " * 9), ("zz", "no such"), ("Bank", "a bank")]
    alone = [search.best_window(*p) if all(p) else None for p in pairs]
    assert search.best_of_each(pairs) == alone and alone[0] == (round(16 / 18, 16), 4, 14) and alone[-2:] == [None, (1.0, 2, 6)]


def test_degrees_hold_no_whole_edges(spark):
    edges = spark.createDataFrame([("a", "b", "p"), ("a", "b", "p"), ("a", "a", "p"), ("c", "a", "q"), ("x", "y", "p")], "source string, target string, predicate string")
    found = graph.degrees(spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "uri string"), edges)
    assert "predicate" not in plan(found).split("Scan")[0] and "hashpartitioning(source" not in plan(found)
    assert sorted(map(tuple, found.collect())) == [("a", 4), ("b", 2), ("c", 1), ("d", 0)]
