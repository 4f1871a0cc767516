"""Every registered mobility query against its SQL on the same tables."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb
import pytest

from skylane.plans.registry import ORACLE_SQL, QUERIES

SF = os.environ.get("SKYLANE_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{SF}/events.parquet'")
    return con


def _plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v + 0.0 if isinstance(v, float) else v


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    key = lambda row: tuple((v is None, "" if v is None else str(type(v)), 0 if v is None else v) for v in row)
    got = sorted((tuple(_plain(r[c]) for c in order) for r in df.collect()), key=key)
    want = sorted((tuple(_plain(r[names.index(c)]) for c in order) for r in cur.fetchall()), key=key)
    assert got == want


def test_forward_fill_windows_hold_a_day_of_a_station(spark):
    plan = QUERIES["win_ffill"](spark, SF)._jdf.queryExecution().analyzed().toString()
    rows = [line for line in plan.splitlines() if "Window [last(precip#" in line]
    assert rows and all("[station#" in line and ", __day#" in line for line in rows)
