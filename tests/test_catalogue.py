"""Every registered query of the core library runs; those with SQL agree with DuckDB."""

import math

import duckdb
import pytest

from cellgrain.plans import catalogues
from conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {name: f for c in catalogues() for name, f in c.queries.items()}
SQL = {name: sql for c in catalogues() for name, sql in c.sql.items()}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v) + 0.0:.8g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted(tuple(plain(v) for v in r) for r in got.select(*columns).collect())
    if name in SQL:
        result = duck.execute(SQL[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        expected = sorted(tuple(plain(r[k]) for k in order) for r in result.fetchall())
        assert rows == expected
