"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import numpy as np
import pytest

from redpen.plans.catalog import ORACLE_SQL, QUERIES


def plain(v):
    if v is None or isinstance(v, (bool, np.bool_)):
        return v
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    try:
        x = float(v) if not isinstance(v, str) else None
    except TypeError:
        x = None
    if x is None:
        return str(v)
    return None if math.isnan(x) else float(f"{x:.9g}")


def table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, small, name):
    found = QUERIES[name](spark, small)
    wanted = duck.sql(ORACLE_SQL[name])
    names, rows = list(wanted.columns), wanted.fetchall()
    assert sorted(found.columns) == sorted(names)
    assert table(found.collect(), found.columns) == table(rows, names)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
