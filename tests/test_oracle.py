"""Every registered query against its DuckDB twin (value hash, like the driver's gate)."""

import duckdb
import pytest

import __spark_entry__ as E
from check_oracle import TABLES, digest
from conftest import SF_SMALL
from refinespark.plans.registry import QUERIES as LIBRARY

# the library's own queries; optional parts hold theirs to account in their own tests
QUERIES = {k: v for k, v in E.queries().items() if k in LIBRARY}
SQL = {k: v for k, v in E.oracle_sql().items() if k in LIBRARY}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(SQL[name])
    cols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(cols) == sorted(df.columns)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows) == digest(cols, orows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["utt_id", "pid", "score", "reply"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_plan(spark, name):
    """No registered query plans a cartesian product or a nested-loop join."""
    df = QUERIES[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
