"""Every query of the reference's operators against DuckDB on the smallest tables."""

import duckdb
import pytest

from rowloom.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(x):
    return round(x, 4) if isinstance(x, float) else x


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    expected = sorted(repr([plain(x) for x in r]) for r in want.fetchall())
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    assert got == expected
