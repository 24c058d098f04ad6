"""Every query against its DuckDB statement on the smallest tables; queries without one must give rows."""

import math
import os

import duckdb
import pytest

from corpusloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def said(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else repr(value)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rows, columns = df.collect(), sorted(df.columns)
    if name not in catalog.ORACLES:
        assert rows
        return
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == columns
    kinds, stated = dict(df.dtypes), dict(zip(want.columns, map(str, want.types), strict=True))
    assert all(TYPES.get(kinds[c], stated[c]) == stated[c] for c in columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(said(r[c]) for c in columns) for r in rows) == sorted(tuple(said(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns == ["year", "hhi", "shannon_entropy", "n_venues", "n_papers"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
