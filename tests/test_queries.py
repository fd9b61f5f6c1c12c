"""Every registered query with SQL, against DuckDB on the smallest tables."""

from concurrent.futures import ThreadPoolExecutor

import duckdb
import pandas as pd
import pytest

from quirelake.plans import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set temp_directory=''")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def results(spark, request):
    """The chosen queries' results, several at a time."""
    names = [i.callspec.params["name"] for i in request.session.items if i.fspath == request.fspath and hasattr(i, "callspec")]
    pool = ThreadPoolExecutor(6)
    yield {name: pool.submit(lambda name=name: queries.QUERIES[name](spark, DATA).toPandas()) for name in names}
    pool.shutdown(cancel_futures=True)


def rows(df: pd.DataFrame) -> list:
    def plain(v):
        if isinstance(v, bool) or str(type(v)) == "<class 'numpy.bool'>":
            return str(bool(v))
        return "null" if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    columns = sorted(df.columns)
    return sorted((tuple(plain(v) for v in r) for r in df[columns].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(results, duck, name):
    got = results[name].result()
    wanted = duck.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got) == rows(wanted)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["century", "n"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
