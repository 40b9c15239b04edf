"""Every registered engine query against DuckDB on the smallest tables."""

import glob
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
from quillstone import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(x):
        return None if x is None or isinstance(x, float) and math.isnan(x) else repr(float(x)) if isinstance(x, float) else str(x)

    return sorted(([cell(r[i]) for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_same_rows(spark, con, name):
    got = Q.queries()[name](spark, SF)
    want = con.sql(Q.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got.columns, [tuple(r) for r in got.collect()]) == canonical(want.columns, want.fetchall())


def test_filters_and_columns_reach_the_scan(spark):
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    plan = Q.queries()["filter_eq_F1"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in plan and "c_acctbal" not in plan.split("ReadSchema")[1]
