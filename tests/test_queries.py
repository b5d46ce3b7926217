"""Every registered query that has an SQL twin gives the same rows in DuckDB."""

import math

import duckdb
import pytest

from gapscan.plans import catalog
from gapscan.plans.adapters import BASE

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    if name not in SQL:
        assert got
        return
    twin = duck.sql(SQL[name])
    at = [twin.columns.index(c) for c in columns]
    assert sorted(twin.columns) == columns
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in twin.fetchall())
    assert not any("HUGE" in str(k) for k in twin.types)


def test_hot_paths_stay_in_the_jvm(spark):
    for name in ("w02_plan", "j02_coverage_delta", "w07_stall_streak", "j11_affected_tests"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


def test_columns_are_pruned_at_the_scan(spark):
    plan = QUERIES["w01_target_ids"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    read = plan[plan.index("ReadSchema") :]
    assert "l_tax" not in read and "l_shipdate" not in read
