"""Every registered query that SQL can express against DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from folioloom.plans import registry

DATA = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def show(v):
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return None
        # a column of integers with nulls comes as floats from one side
        return (int(v) if v == int(v) else round(float(v), 6)) if isinstance(v, float) and abs(v) < 2**53 else v

    return sorted(tuple(str(show(v)) for v in row) for row in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in os.listdir(DATA):
        db.sql(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return db


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_is_its_sql(spark, duck, name):
    mine, theirs = registry.QUERIES[name](spark, DATA).toPandas(), duck.sql(registry.SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
