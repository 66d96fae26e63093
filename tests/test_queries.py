"""Every registered query with SQL gives what DuckDB gives."""

import os

import duckdb
import pandas as pd
import pytest

from lodestone import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if pd.isna(value):
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "item"):
        value = value.item()
    return round(value, 6) if isinstance(value, float) else str(value) if hasattr(value, "isoformat") else value


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None)), key=repr)


def same(left, right):
    assert sorted(left.columns) == sorted(right.columns)
    return [tuple(float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in r) for r in rows(left)] == [
        tuple(float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in r) for r in rows(right)
    ]


@pytest.fixture(scope="session")
def duck(data_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{data_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, data_dir, name):
    got = catalog.queries()[name](spark, data_dir).toPandas()
    want = duck.execute(catalog.oracle_sql()[name]).df()
    assert same(got, want)
    assert len(got) > 0, "a query that finds nothing shows nothing"


def test_every_query_is_named_once():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 5
