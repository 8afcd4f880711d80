"""Every query with SQL against DuckDB at the smallest scale."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
SQL = {k: v for k, v in entry.oracle_sql().items() if not (k.startswith("p") and k[1].isdigit()) or k.startswith(("p5", "p7"))}


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    res = duck.execute(SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = Counter(tuple(norm(row[names.index(c)]) for c in cols) for row in res.fetchall())
    if os.path.exists(DIR) and got != want:
        assert not (got - want) and not (want - got)


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
