"""Votes of spans in one sorted pass."""

import random
from unittest import mock

import pyarrow as pa

from quirelake.operators import spans

SCHEMA = "key string, ord long, start long, end long, label string, source string, weight double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def by_hand(rows, share):
    """All members of a text, each against all before it."""
    out = []
    for key in {r[0] for r in rows}:
        groups, held = [], {}
        for _, o, s, e, label, source, w in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            grp = next((g for g, own in enumerate(groups) if any(0 < min(e, y) - max(s, x) >= share * min(e - s, y - x) for x, y in own)), len(groups))
            groups += [[]] * (grp == len(groups))
            groups[grp] = [*groups[grp], (s, e)]
            held.setdefault(grp, []).append((o, s, e, label, source, w))
        for own in held.values():
            weights = {x: round(sum(v[5] for v in own if v[1:3] == x), 9) for x in {v[1:3] for v in own}}
            best = min(weights, key=lambda x: (-weights[x], min(v[0] for v in own if v[1:3] == x)))
            out.append((key, *best, *min(v for v in own if v[1:3] == best)[3:5], round(weights[best] / sum(weights.values()), 6), len(own)))
    return out


def test_votes_need_one_shuffle_and_one_sort(spark):
    found = spans.voted(spark.createDataFrame([("a", 0, 0, 5, "P", "x", 0.5)], SCHEMA))
    assert plan(found).count("Exchange") == 1 and "Aggregate" not in plan(found) and "Window" not in plan(found)


def test_votes_are_those_of_all_pairs(spark):
    r = random.Random(3)
    rows = []
    for key in ("a", "b", "c", None):
        for o in range(120):
            start = r.randrange(300)
            rows.append((key, o, start, start + r.randrange(1, 12), "P", r.choice("xyz"), r.choice((0.25, 0.5, 1.0))))
        rows += [(key, 200 + o, 1000 + 20 * o, 1010 + 20 * o, "P", "far", 0.5) for o in range(40)]
    rows.append(("one", 0, 3, 4, "P", "x", 0.5))
    for share in (0.5, 0.9):
        got = spans.voted(spark.createDataFrame([*rows, ("a", 999, None, 3, "P", "x", 1.0)], SCHEMA).repartition(5), share).collect()
        assert sorted(map(tuple, got), key=str) == sorted(by_hand(rows, share), key=str)


def test_a_text_of_many_islands_is_never_held_whole(spark, monkeypatch):
    """An island is elected as soon as the next batch shows where it ends."""
    sizes = []
    elected = spans._elected
    monkeypatch.setattr(spans, "_elected", lambda island, share: sizes.append(len(island)) or elected(island, share))

    def local(df, run, schema):
        batch = pa.RecordBatch.from_pylist([x.asDict() for x in df.collect()])
        assert sum(b.num_rows for b in run(iter([batch.slice(0, 700), batch.slice(700)]))) == 1000
        return df.selectExpr("key", "start", "end", "label", "source", "weight AS w", "weight AS total", "1L AS num_votes")

    with mock.patch("pyspark.sql.classic.dataframe.DataFrame.mapInArrow", local):
        spans.voted(spark.range(2000).selectExpr("'t' AS key", "id AS ord", "(id DIV 2) * 10 AS start", "(id DIV 2) * 10 + 10 AS end", "'P' AS label", "'x' AS source", "0.5D AS weight"))
    assert sizes == [2] * 1000
