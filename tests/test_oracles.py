"""Every query with SQL gives what the SQL gives, at the smallest size."""

import glob
import math
import os

import duckdb
import pytest

from ordovar.plans import oracles, registry

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def normal(v):
    return (float(f"{v:.9g}") if not math.isnan(v) else "nan") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(oracles.ORACLE))
def test_query(spark, tables, name):
    df = registry.QUERIES[name](spark, D)
    want = tables.sql(oracles.ORACLE[name])
    cols = sorted(want.columns)
    assert sorted(df.columns) == cols
    rows = lambda it, at: sorted((tuple(normal(r[at(c)]) for c in cols) for r in it), key=repr)
    assert rows(df.collect(), lambda c: c) == rows(want.fetchall(), want.columns.index)
