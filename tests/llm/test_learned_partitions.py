"""Learned partitions: recall against brute force, exact scores, copies, edge cases."""

import numpy as np
import pytest

from quirelake.llm import learned_partitions as lp
from quirelake.llm import queries

DATA = "/root/testdata/sf0.001"


def brute(rows, every, k):
    """Row by row: for each query ``(query_id, [(score, vec_id)])``, and scores summed in order."""
    out = []
    for a, (q, x) in enumerate(rows):
        if q % every == 0:
            found = []
            for b, (i, y) in enumerate(rows):
                if a != b:
                    s = 0.0
                    for u, v in zip(x, y, strict=False):
                        s += float(u) * float(v)
                    found.append((-s, i))
            out.append((q, [(i, -s) for s, i in sorted(found)[:k]]))
    return out


def by_query(df):
    out: dict = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def recall(got, wanted):
    hits = sum(len({i for i, _ in w} & {i for _, i, _ in got[q]}) for q, w in wanted)
    return hits / sum(len(w) for _, w in wanted)


def test_query_recall(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    wanted = brute(rows, 20, 20)
    got = by_query(queries.queries()["op12_learned_partitions"](spark, DATA))
    assert set(got) == {q for q, _ in wanted} and all([r for r, _, _ in g] == list(range(1, 21)) for g in got.values())
    assert recall(got, wanted) >= 0.9
    exact = {(q, i): s for q, w in brute(rows, 20, len(rows)) for i, s in w}
    assert all(exact[q, i] == s for q, g in got.items() for _, i, s in g)  # bit by bit
    assert all([(-s, i) for _, i, s in g] == sorted((-s, i) for _, i, s in g) for g in got.values())


def test_clusters_are_pruned(spark):
    """Clustered vectors: recall with few parts searched, blocks smaller than parts, many copies of one vector."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (12, 16))
    x = (centres[rng.integers(0, 12, 1500)] + rng.normal(0, 0.15, (1500, 16))).round(3)
    x[:400] = x[0]
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = by_query(lp.search(df, every=20, k=10, block_rows=50, block_queries=8))
    wanted = brute(rows, 20, 10)
    assert recall(got, wanted) >= 0.9
    assert [i for _, i, _ in got[0]] == [i for i, _ in dict(wanted)[0]] and [i for _, i, _ in got[380]] == [i for i, _ in dict(wanted)[380]]
    model = lp.fit(np.unique(x, axis=0))
    assert model.place.shape[1] > 8 and lp.probes(model, x).mean() < 0.5


def test_small_tables_are_exact(spark):
    odd = [(0, [0.5, -0.25]), (0, [-0.5, 0.125]), (0, [0.5, -0.25]), (3, [1.0, -1.0]), (4, [-1.0, 1.0]), (20, [0.5, -0.25, 0.0]), (40, [2.0]), (7, [-0.0, 1.0])]
    out = [(None, [1.0, 1.0]), (60, None), (61, []), (62, [0.0, 0.0]), (80, [1.0, None]), (81, [float("nan"), 1.0]), (100, [float("inf"), 1.0])]
    df = spark.createDataFrame([(i, v, "clash", 1.0) for i, v in odd + out], "vec_id long, embedding array<double>, part string, score double").repartition(3)
    got = sorted(map(tuple, lp.search(df, k=3).collect()))
    wanted = sorted((q, r, i, s) for q, w in brute(odd, 20, 3) for r, (i, s) in enumerate(w, 1))
    assert got == wanted
    assert lp.search(df.limit(0)).count() == 0
    assert lp.search(df.where("vec_id = 40")).count() == 0
    two = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in lp.search(two).collect()] == [(0, 1, 1, 11.0)]


@pytest.mark.parametrize("n,parts", [(400, 8), (1000, 32)])
def test_parts_are_balanced(n, parts):
    x = np.random.default_rng(n).normal(size=(n, 8))
    x[: n // 3] = x[0] + x[: n // 3] * 1e-6
    graph = lp.neighbours(x, x, 10, np.arange(n))
    part = lp.balanced_parts(x, graph, parts)
    sizes = np.bincount(part, minlength=parts)
    assert len(sizes) == parts and sizes.max() <= np.ceil(1.05 * n / parts) and sizes.min() > 0
    start = lp.balanced_parts(x, graph, parts, rounds=0)
    inside = lambda p: (p[graph] == p[:, None]).mean()
    assert inside(part) > inside(start)
