from __future__ import annotations

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from redpen.llm import lines, mixing
from redpen.llm.common import documents as read
from tests.llm.helpers import ODD, documents

NAV = "home | about us | contact | imprint"
OWN = "this is a line of its own, and long enough, number {}"


def test_spread_lines_stay_in_their_first_document(spark):
    rows = [(i, "\n".join([NAV, OWN.format(i), OWN.format(i + 1000)]), f"site{i % 12}") for i in range(40)]
    rows.append((99, NAV, "site1"))  # all its text is boilerplate
    rows.append((97, rows[0][1], "site2"))  # a copy of the first document stays like it
    rows += [(200 + i, f"Read more\n \n{OWN.format(300 + i)}\n{OWN.format(400 + i)}", f"site{i}") for i in range(9)]  # short lines count, blank ones do not
    rows.append((98, None, "site1"))
    core = [OWN.format(f"core {k}") for k in range(6)]
    rows += [(600 + i, "\n".join([*core[: 6 - i % 2], OWN.format(600 + i)]), f"site{i}") for i in range(10)]  # near copies
    found = {r.doc_id: r for r in lines.dedup_lines(documents(spark, rows)).collect()}
    assert found[0].text.startswith(NAV) and found[0].n_removed == 0
    assert all(NAV not in found[i].text and found[i].n_removed == 1 for i in range(1, 40))
    assert all(found[600 + i].n_removed == 0 for i in range(10))
    assert found[99].text == "" and found[97].text == rows[0][1]
    assert found[200].n_removed == 0 and all(found[200 + i].text.startswith(" \n") and found[200 + i].n_removed == 1 for i in range(1, 9))
    assert found[98].text is None and found[5].fp == "x"


def test_made_columns_keep_clear_of_given_ones(spark, tmp_path):
    docs = documents(spark, [(1, "a\nb"), (2, None)]).withColumn("n_lines", F.lit("x")).withColumn("N_REMOVED", F.lit("y"))
    lines.dedup_lines(docs).write.parquet(str(tmp_path / "out"))
    found = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert (found[1].n_lines, found[1].N_REMOVED, found[1].n_lines_, found[1].n_removed_) == ("x", "y", 2, 0)


def test_near_threshold_counts_are_exact(spark):
    rows = [(1000 * k + i, "\n".join([OWN.format(-k), OWN.format(1000 * k + i), OWN.format(7)[::-1] + str(1000 * k + i)]), f"site{i}") for k in range(5, 12) for i in range(k)]
    bad = lines.boilerplate(documents(spark, rows), min_sites=8)
    hashes = {r.line for r in bad.collect()}
    want = {k: spark.range(1).select(F.xxhash64(F.lit(OWN.format(-k)))).first()[0] for k in range(5, 12)}
    assert {k for k, h in want.items() if h in hashes} == {8, 9, 10, 11} and len(hashes) == 4


def test_line_sql(spark, small):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{small}/documents.parquet'")
    found = lines.op6_line_dedup(spark, small)
    assert sorted(map(tuple, found.collect())) == sorted(con.sql(f"select {', '.join(found.columns)} from ({lines.OP6_SQL})").fetchall())


def test_odd_lines(spark):
    found = lines.dedup_lines(documents(spark, ODD))
    assert found.count() == len(ODD) and lines.dedup_lines(documents(spark, [])).count() == 0


def skewed(spark):
    rows = [(i, "w " * (5 + i % 9), "big") for i in range(900)] + [(1000 + i, "w " * (3 + i % 7), f"small{i % 6}") for i in range(300)]
    return documents(spark, rows)


def test_exponent_meets_entropy_or_repetition(spark):
    tokens = {"a": 1000.0, "b": 100.0, "c": 50.0}
    table = spark.createDataFrame(list(tokens.items()), "mix_source string, tokens double")
    total = sum(tokens.values())

    def entropy(t):
        w = [(v / total) ** t for v in tokens.values()]
        return -sum(x / sum(w) * math.log(x / sum(w)) for x in w)

    t = mixing.exponent(table, entropy=0.9, repeat=1e9)
    assert entropy(t) >= 0.9 * math.log(3) > entropy(t + 1e-6)
    t = mixing.exponent(table, entropy=1.0, repeat=2.0)
    assert (1000 / 50) ** (1 - t) <= 2.0 < (1000 / 50) ** (1 - t + 1e-6)
    assert mixing.exponent(table, entropy=0.0, repeat=1e9) == 1.0


def test_every_document_is_used_and_small_sources_are_repeated(spark):
    rows, sources = mixing.plan(skewed(spark), repeat=1.5, entropy=1.0)
    found = rows.join(sources, "mix_source").select("*", mixing.copies().alias("copies")).collect()
    assert all(r.copies >= 1 for r in found) and {r.copies for r in found if r.source == "big"} == {1}
    by = {}
    for r in found:
        n, c, e = by.get(r.source, (0, 0, 0))
        by[r.source] = (n + r.n_tokens, c + r.copies * r.n_tokens, r.epochs)
    for n, c, e in by.values():  # a budget of e epochs, short of it by less than a document
        assert n * e - 15 <= c <= n * e + 1e-6


def test_budget_below_one_epoch(spark):
    rows, sources = mixing.plan(skewed(spark), budget=2000.0)
    found = rows.join(sources, "mix_source").select("n_tokens", mixing.copies().alias("c"), (F.col("weight") * 2000).alias("b"), "mix_source").collect()
    for s in {r.mix_source for r in found}:
        used = sum(r.c * r.n_tokens for r in found if r.mix_source == s)
        budget = next(r.b for r in found if r.mix_source == s)
        assert budget - 16 <= used <= budget + 1e-6


def test_mixed_rows_and_odd_ones(spark):
    docs = skewed(spark)
    out = mixing.mixed(docs, repeat=1.5, entropy=1.0)
    assert out.columns == docs.columns and out.count() > docs.count() and out.select("doc_id").distinct().count() == docs.count()
    odd = [(i, t, [None, "a", "b"][k % 3]) for k, (i, t) in enumerate(ODD)]
    assert mixing.mixed(documents(spark, odd)).count() >= len(odd)
    assert mixing.mixed(documents(spark, [])).count() == 0


@pytest.mark.parametrize("name", ["op3"])
def test_query_covers_all(spark, small, name):
    assert mixing.op3_source_mixing(spark, small).count() == read(spark, small).count()
