"""Every core query against its SQL, as the driver compares them."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from tracemill.plans.oracle import ORACLE_SQL
from tracemill.plans.queries import QUERIES
from tracemill.plans.views import TABLES


@pytest.fixture(scope="module")
def tables(small):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{small}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, small, tables, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    found = tables.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(str(tuple(r[i] for i in at)) for r in found.fetchall())
    assert got


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scan_is_pruned(spark, small):
    plan = QUERIES["stats_macro"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
