"""Every query with an oracle gives DuckDB's rows on the smallest data set; the others run and have a schema."""

import os

import duckdb
import pytest

from scoreline import oracle
from scoreline.queries import queries

ORACLE = oracle.oracle_sql()
QUERIES = queries()


@pytest.fixture(scope="module")
def duck(data):
    connection = duckdb.connect()
    for name in os.listdir(data):
        connection.sql(f"create view {name.removesuffix('.parquet')} as select * from '{data}/{name}'")
    return connection


def rows(frame):
    columns = sorted(frame.columns)
    frame = frame[columns]
    frame = frame.astype(object).where(frame.notna(), None)
    plain = [[float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") else v for v in row] for row in frame.itertuples(index=False)]
    return columns, sorted(plain, key=str)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_duckdb(name, spark, data, duck):
    got, want = rows(QUERIES[name](spark, data).toPandas()), rows(duck.sql(ORACLE[name]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(name, spark, data):
    frame = QUERIES[name](spark, data)
    assert frame.columns
    assert frame.count() >= 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
