"""Every query of the library against its SQL in DuckDB, at the scale where none of them is empty."""

import math

import duckdb
import pytest

from terrafold.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if v is None or isinstance(v, (bool, int, str)):
        return v
    return round(float(v), 9) if hasattr(v, "as_integer_ratio") else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert rows
    if name in catalog.ORACLE_SQL:
        want = duck.sql(catalog.ORACLE_SQL[name])
        at = [want.columns.index(c) for c in columns]
        assert sorted(want.columns) == columns
        assert rows == sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=str)


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
