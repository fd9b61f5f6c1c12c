"""Keyed tables that take changes: versions, untouched files, failures, lookups."""

import pytest

from quirelake.sources import store


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_changes(spark, tmp_path):
    base = spark.createDataFrame([(k, 0, f"v{k}") for k in range(100)], "id long, at int, value string")
    table = store.create(base, str(tmp_path / "t"), "id", buckets=10)
    assert table.version() == 0 and rows(table.read()) == rows(base)
    before = table.manifest()
    changes = spark.createDataFrame([(3, 2, "new"), (3, 1, "older"), (500, 1, "added"), (4, -1, "too old")], "id long, at int, value string")
    touched = table.merge(changes, "at")
    after = table.manifest()
    assert table.version() == 1 and 0 < len(touched) < 10
    assert {k for k in before if before[k] != after[k]} <= touched and all(after[k] == before[k] for k in before if k not in touched)
    got = {r["id"]: r["value"] for r in table.read().collect()}
    assert len(got) == 101 and (got[3], got[500], got[4], got[5]) == ("new", "added", "v4", "v5")
    assert rows(table.lookup(spark.createDataFrame([(3,), (777,)], "id long"))) == [(3, 2, "new")]
    assert rows(store.Store(spark, str(tmp_path / "t"), "id", 10, "id long, at int, value string").read()) == rows(table.read())
    assert table.merge(changes.limit(0), "at") == set() and len(rows(table.read())) == 101


def test_a_failed_change_leaves_the_table(spark, tmp_path):
    from pyspark.sql import functions as F

    base = spark.createDataFrame([(k, 0) for k in range(20)], "id long, at int")
    table = store.create(base, str(tmp_path / "t"), "id", buckets=4)
    bad = spark.range(5).select("id", F.when(F.col("id") < 4, F.lit(9)).otherwise(F.raise_error(F.lit("lost")).cast("int")).alias("at"))
    with pytest.raises(Exception, match="lost"):
        table.merge(bad, "at")
    assert table.version() == 0 and rows(table.read()) == rows(base)
    folders = table.manifest()
    table._publish(folders, 0)
    with pytest.raises(RuntimeError, match="another writer"):
        table._publish(folders, 0)


def test_appended_rows_stay(spark, tmp_path):
    one = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "id long, name string")
    table = store.create(one, str(tmp_path / "t"), "id", buckets=3)
    table.append(one)
    assert len(table.read().collect()) == 6
    assert store.create(one.limit(0), str(tmp_path / "e"), "id").read().count() == 0
