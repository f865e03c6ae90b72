"""Every registered query against its SQL, value by value, on a small folder."""

import duckdb
import pytest

import __spark_entry__ as entry
from corpusloom.checks import oracle
from corpusloom.checks.queries import REGISTRY

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def db(folder):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def rounded(v):
    return round(v, 6) if isinstance(v, float) else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, folder, name):
    df = entry.queries()[name](spark, folder)
    columns = sorted(df.columns)
    got = [tuple(rounded(r[c]) for c in columns) for r in df.collect()]
    cur = db.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = [tuple(rounded(r[i]) for i in at) for r in cur.fetchall()]
    assert got, "the comparison must not be empty"
    assert ordered(got) == ordered(want)


# Compared with plain Python in test_markup.py, as SQL has no fold over tags; measured for recall in test_cells.py;
# compared with a dense factorisation in test_fitted.py.
WITHOUT_SQL = {"page_main_text", "page_markdown", "topk_in_cells", "embed_text_fitted"}


def test_every_query_has_its_sql():
    assert set(REGISTRY) == set(SQL) | WITHOUT_SQL
    assert set(SQL) <= set(entry.oracle_sql())


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 40 and all(r.num_hits == 5 for r in rows)
