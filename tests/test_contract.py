"""Registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from attestor.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def same(spark_rows, columns, relation):
    names = sorted(columns)
    value = lambda v: round(v, 6) if isinstance(v, float) else v
    order = [relation.columns.index(c) for c in names]
    got = sorted(str([value(r[c]) for c in names]) for r in spark_rows)
    want = sorted(str([value(r[i]) for i in order]) for r in relation.fetchall())
    return sorted(relation.columns) == names and got == want


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    if name in registry.ORACLES:
        assert same(rows, df.columns, duck.sql(registry.ORACLES[name]))
