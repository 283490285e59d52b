"""Every query with SQL gives what DuckDB gives on the smallest data."""

import duckdb
import pytest

from tempograph.queries import everything

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = everything()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return connection


@pytest.mark.parametrize("name", sorted(k for k, (_, sql) in QUERIES.items() if sql))
def test_oracle(spark, duck, name):
    query, sql = QUERIES[name]
    frame = query(spark, DATA)
    columns = sorted(frame.columns)
    got = sorted(str(tuple(r[c] for c in columns)) for r in frame.collect())
    answer = duck.execute(sql)
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    want = sorted(str(tuple(r[names.index(c)] for c in columns)) for r in answer.fetchall())
    assert got == want
