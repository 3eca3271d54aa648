from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from redpen.llm import quality, simhash
from redpen.llm.common import documents
from tests.llm.test_simhash import classes_of, plain_fingerprint


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    """The documents after each stage."""
    docs, out = documents(spark, small), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, small).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_columns_stay(spark, small, stages):
    assert [s.columns for s in stages[:-1]] == [documents(spark, small).columns] * 4
    assert stages[-1].columns == ["doc_id", "source", "n_tokens", "ids", "round_trip"]


def test_quality_keeps_what_the_model_keeps(spark, small, stages):
    docs = documents(spark, small)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = quality.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    keep = {i for (i, _), s in zip(rows, model.score([t for _, t in rows]), strict=True) if s >= quality.CUT}
    assert {r.doc_id for r in stages[0].select("doc_id").collect()} == keep
    good = duckdb.sql(f"select doc_id from '{small}/labels.parquet' where quality = 1").fetchall()
    assert len({i for (i,) in good} & keep) >= 0.97 * len(good)


def test_lines_keep_all_documents(stages):
    assert stages[1].count() == stages[0].count()
    assert all(r.n_chars == len(r.text) for r in stages[1].collect())


def test_one_of_each_class_stays(stages):
    """Classes by few bits or by similar shingles, by brute force over all pairs."""
    texts = {r.doc_id: r.text for r in stages[1].collect()}
    bits = classes_of({i: plain_fingerprint(t) for i, t in texts.items()}, simhash.RADIUS)
    sets = {i: simhash.shingles(t) for i, t in texts.items()}
    of = dict(bits)
    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if of[i] != of[j] and simhash.jaccard(sets[i], sets[j]) >= simhash.SIMILAR:
                a, b = of[i], of[j]
                of = {k: min(a, b) if c in (a, b) else c for k, c in of.items()}
    kept = {r.doc_id for r in stages[2].select("doc_id").collect()}
    assert set(of.values()) <= kept <= set(bits.values()) and len(kept) <= len(set(of.values())) + 1


def test_mix_and_tokens(stages):
    assert {r.doc_id for r in stages[3].collect()} == {r.doc_id for r in stages[2].collect()}
    rows = stages[4].collect()
    assert len(rows) == stages[3].count() and all(r.round_trip for r in rows)


def test_registered(spark, small, stages):
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, small).count() == stages[-1].count()
    assert {n.split("_")[0] for n in entry.queries() if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}
