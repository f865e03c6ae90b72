"""Queries that have SQL, value by value."""

import duckdb
import pytest

from corpusloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, folder, name):
    db = duckdb.connect()
    for name_ in ("documents", "conversations"):
        db.execute(f"create view {name_} as select * from '{folder}/{name_}.parquet'")
    df = queries.REGISTRY[name](spark, folder)
    found = db.execute(queries.SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(found.fetchall())


def test_every_number_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.REGISTRY) == list(range(1, 14))
