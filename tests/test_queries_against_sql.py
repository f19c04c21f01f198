"""Every core query with SQL gives DuckDB's rows on the smallest data."""

import decimal
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

DATA = Path("/root/testdata/sf0.001")
CORE = {n: (m.QUERIES[n], m.SQL.get(n)) for m in __spark_entry__.CORE for n in m.QUERIES}


def plain(x):
    if isinstance(x, (float, decimal.Decimal)):
        return None if math.isnan(x) else round(float(x), 6)
    return x


@pytest.fixture(scope="module")
def duck():
    if not DATA.exists():
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in CORE.items() if sql))
def test_same_rows(spark, duck, name):
    query, sql = CORE[name]
    got = query(spark, str(DATA))
    columns = sorted(got.columns)
    theirs = duck.execute(sql)
    names = [c[0] for c in theirs.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in theirs.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr) == want


def test_registries_are_whole():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) == sum(len(m.QUERIES) for m in __spark_entry__._registries())
