"""Every registered query of the engine against DuckDB on the smallest tables."""
import duckdb
import pytest

from tarn.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in Q.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_against_duckdb(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in Q.ORACLE_SQL:
        assert rows
        return
    found = duck.sql(Q.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
    assert rows == want
