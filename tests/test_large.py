"""What only large tables show: grids in sums, sums beyond a long, edit scripts of long texts."""

from __future__ import annotations

import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from redpen.functions import align
from redpen.operators import replay
from redpen.plans.catalog import ORACLE_SQL, QUERIES
from tests.test_queries import table


def outcomes(spark, n):
    r = random.Random(5)
    share = lambda: r.choice([None, 0.1, 0.5, 0.5, 0.5, r.random()])
    rows = [(i * 7 - 900, *(share() for _ in range(5)), r.choice([None, 10.0, 20.0, r.random()]), r.choice([None, 3, 8]), r.randint(0, 4), r.randint(0, 4), 5, r.random() < 0.5, r.random() < 0.5, r.random() < 0.5) for i in range(n)]
    return spark.createDataFrame(rows, "row_idx long, conf double, mean_conf double, min_conf double, drop double, r_d double, latency_ms double, token_usage int, ed_ocr int, ed_up int, gt_len int, changed boolean, ok_ocr boolean, ok_up boolean")


@pytest.mark.parametrize("n", [1, 7, 400])
def test_grid_in_sums_is_the_grid_by_rows(spark, n):
    """Many equal scores and null ones, budgets that select nothing, all, or more than all."""
    rows, names, budgets = outcomes(spark, n).cache(), ["GCR", "WUR"], [0.0, 0.001, 0.3, 0.31, 1.0, 1.5]
    keys = ["router_name", "budget"]
    wanted = replay.summary(replay.grid(rows, names, budgets), keys, F.col("budget"))
    found = replay.grid_summary(rows, rows, names, budgets)
    assert found.columns == wanted.columns
    assert table(found.collect(), found.columns) == table(wanted.collect(), wanted.columns)


@pytest.mark.parametrize("name", ["j10_content_signature_join", "u3_pools_by_budget"])
def test_ids_add_up_beyond_a_long(spark, tmp_path, name):
    con = duckdb.connect()
    con.sql(f"copy (select 40000000000 + 7 * i as doc_id, repeat('ab' || i, 300) as text, 'en' as lang, 's' as source, 900 as n_chars from range(40) t(i)) to '{tmp_path}/documents.parquet' (format parquet)")
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    wanted = con.sql(ORACLE_SQL[name])
    rows = {c: [] for c in wanted.columns}
    exact = sorted(tuple(r) for r in wanted.fetchall())
    found = QUERIES[name](spark, str(tmp_path)).select(*rows).collect()
    assert sorted(tuple(r) for r in found) == exact
    assert max(r[-1] for r in exact) > 2**63


def by_whole_table(a, b):
    d = [[i + j for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            d[i][j] = min(d[i - 1][j - 1] + (x != y), d[i - 1][j] + 1, d[i][j - 1] + 1)
    i, j, ops = len(a), len(b), []
    while i or j:
        if i and j and d[i][j] == d[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            ops += [("replace", i, j)] if a[i] != b[j] else []
        elif i and d[i][j] == d[i - 1][j] + 1:
            i -= 1
            ops.append(("delete", i, j))
        else:
            j -= 1
            ops.append(("insert", i, j))
    return ops[::-1]


def test_banded_scripts_are_those_of_the_whole_table():
    r = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 12))) for _ in "ab")
        assert align.edit_script(a, b) == by_whole_table(a, b), (a, b)


def test_script_of_long_near_texts_is_quick():
    a = "abcdefghij" * 400
    b = a[1:2000] + "#" + a[2001:-1]
    began = time.process_time()
    assert align.edit_script(a, b) == [("delete", 0, 0), ("replace", 2000, 1999), ("delete", 3999, 3998)]
    assert time.process_time() - began < 1
