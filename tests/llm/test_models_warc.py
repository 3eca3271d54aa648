from __future__ import annotations

import gzip
import random
import time

import pytest
from pyspark.sql import functions as F

from redpen.llm import quality, secrets, warc
from tests.llm.helpers import ODD, documents

# -- quality -------------------------------------------------------------------------------------


def labelled(n, seed):
    random.seed(seed)
    syllables = ["ra", "ti", "on", "el", "mo", "ne", "sta", "ver"]
    word = lambda: "".join(random.choice(syllables) for _ in range(random.randint(1, 3)))
    out = []
    for _ in range(n):
        words = [word() for _ in range(random.randint(3, 80))]
        kind = random.random()
        if kind < 0.7:
            out.append((" ".join(words).capitalize() + ".", 1))
        elif kind < 0.8:
            out.append((" ".join(w + "###" for w in words), 0))
        elif kind < 0.9:
            out.append((" ".join(w.upper() + "!!" for w in words), 0))
        else:
            out.append((" ".join([words[0]] * len(words)), 0))
    return out


def test_held_out_accuracy():
    train, test = labelled(600, 1), labelled(300, 2)
    model = quality.Model([t for t, _ in train], [y for _, y in train])
    score = model.score([t for t, _ in test])
    assert ((score >= quality.CUT) == [y == 1 for _, y in test]).mean() > 0.97
    assert ((score >= 0) & (score <= 1)).all()


def test_calibration_and_determinism():
    train = labelled(400, 3)
    a, b = (quality.Model([t for t, _ in train], [y for _, y in train]) for _ in range(2))
    assert (a.score(["some words here."]) == b.score(["some words here."])).all()
    assert 0.25 <= a.net.temperature <= 8


def test_fit_leaves_out_the_held_fold(spark):
    data = labelled(300, 4)
    docs = documents(spark, [(i, t) for i, (t, _) in enumerate(data)])
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(data)] + [(None, 1), (3, None)], "doc_id long, quality int")
    shuffled = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    x, y = quality.fit(docs, labels), quality.fit(docs, shuffled)
    assert (x.score([t for t, _ in data[:20]]) == y.score([t for t, _ in data[:20]])).all()
    rows = quality.scored(docs, x, docs.columns)
    assert rows.select("row.*").columns == docs.columns and rows.count() == 300


def test_odd_rows_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(documents(spark, ODD), none)
    assert {r.score for r in quality.scored(documents(spark, ODD), model, ["doc_id"]).collect()} == {0.5}
    train = labelled(200, 5)
    model = quality.Model([t for t, _ in train], [y for _, y in train])
    assert quality.scored(documents(spark, ODD), model, ["doc_id"]).count() == len(ODD)
    assert quality.scored(documents(spark, []), model, ["doc_id"]).count() == 0


# -- secrets -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def forest(spark):
    return secrets.train(secrets.labelled_findings(spark, 3000))


def test_forest_on_findings_it_did_not_see(spark, forest):
    rows = secrets.labelled_findings(spark, 6000).where("id >= 3000")
    found = secrets.scored(rows, forest)
    ok, n = found.agg(F.count_if(F.col("is_secret") == (F.col("label") == 1)), F.count("*")).first()
    assert ok / n > 0.93


def test_candidates_have_places_and_neighbours(spark):
    text = 'x é token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and id 1234567890123456, twice 1234567890123456 abcdefghijklmnopqrst'
    rows = secrets.candidates(documents(spark, [(1, text), (2, None), (3, ""), (4, "a1" * 20)])).collect()
    assert [(r.doc_id, r.nth) for r in rows] == [(1, 0), (1, 1), (1, 2), (4, 0)]
    assert all(text[r.start : r.start + len(r.candidate)] == r.candidate for r in rows if r.doc_id == 1)
    assert rows[0].before.endswith('token = "') and rows[0].after.startswith('" and id')


def test_secrets_are_told_from_false_alarms(spark, forest):
    texts = ['token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "api_key: ghp_" + "aB3dE5gH7jK9mN1pQ3sT5vX7zA2cD4fG6hJ8", "paid with 4785380592391139 today", "see static/media/upload/image2021 there", "commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff"]
    found = secrets.scored(secrets.candidates(documents(spark, list(enumerate(texts)))), forest)
    assert {r.doc_id: r.is_secret for r in found.collect()} == {0: True, 1: True, 2: False, 3: False, 4: False}


def test_odd_secret_rows(spark, forest):
    assert secrets.scored(secrets.candidates(documents(spark, ODD)), forest).count() == 0
    assert secrets.scored(secrets.candidates(documents(spark, [])), forest).count() == 0


# -- WARC ----------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html lang="de-AT"><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head>
<body><!-- not me --><p>First &eacute;<b>bold</b></p><a href="/x?a=1&amp;b=2">link</a><br>next   line<noscript>off</noscript></body></html>"""


def test_records_link_to_their_source():
    source = warc.response("http://a.example/p q", PAGE)
    assert source.headers["WARC-Target-URI"] == "http://a.example/p%20q"
    meta, text = warc.derive(next(warc.parse(source.to_bytes())))
    for r in (meta, text):
        assert r.headers["WARC-Refers-To"] == source.headers["WARC-Record-ID"]
        assert r.headers["WARC-Source-Payload-Digest"] == warc.digest(PAGE.encode()) == source.headers["WARC-Payload-Digest"]
        assert r.headers["WARC-Block-Digest"] == warc.digest(r.block) and r.headers["WARC-Date"] == source.headers["WARC-Date"]
    assert meta.headers["WARC-Concurrent-To"] == text.headers["WARC-Record-ID"]
    assert text.block.decode().split("\n") == ["A & B", "First ébold", "link", "next line"]
    assert b"title: A & B\r\nlanguage: de-AT\r\nlinks: 1\r\noutlink: /x?a=1&b=2\r\nhttp-content-type: text/html" in meta.block


def test_parse_reads_what_is_written_and_refuses_the_rest():
    made = [*warc.derive(warc.response("u", PAGE)), warc.response("v", "")]
    data = b"".join(r.to_bytes() for r in made)
    assert [(r.headers, r.block) for r in warc.parse(data)] == [(r.headers, r.block) for r in made]
    for broken in (data[:-5], b"x" + data, data.replace(b"WARC/1.1", b"WARC/9.9", 1)):
        with pytest.raises(ValueError):
            list(warc.parse(broken))


def test_pages_table(spark):
    rows = [(1, "http://a", PAGE), (2, None, None), (None, "http://b", ""), (3, "http://a", PAGE)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("block", F.lit("clash"))
    found = warc.derivatives(pages).collect()
    assert len(found) == 8 and {r.warc_type for r in found} == {"metadata", "conversion"}
    assert {r.record_id for r in found if r.page_id == 1} == {r.record_id for r in found if r.page_id == 3}
    assert {r.target_uri for r in found if r.page_id == 2} == {"urn:page:2"}
    assert all(r.content_length == len(r.block.encode()) for r in found)
    assert warc.derivatives(pages.limit(0)).count() == 0


def test_repeated_headers_gzip_and_chunks(spark, tmp_path):
    body = gzip.compress(PAGE.encode())
    chunks = b"".join(f"{len(body[i : i + 7]):x};x=1\r\n".encode() + body[i : i + 7] + b"\r\n" for i in range(0, len(body), 7)) + b"0\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nset-cookie: b=2\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n" + chunks
    source = warc.response("http://a", "x")
    source = warc.Record(source.headers.without("WARC-Payload-Digest"), block)
    again = next(warc.parse(source.to_bytes()))
    assert again.payload == PAGE.encode() and again.headers == source.headers
    meta, text = warc.derive(again)
    assert b"http-set-cookie: a=1\r\nhttp-set-cookie: b=2\r\n" in meta.block
    assert text.block.decode() == warc.plain_text(PAGE)
    assert meta.headers["WARC-Source-Payload-Digest"] == warc.digest(PAGE.encode())
    records = [warc.response(f"http://{i}", PAGE) for i in range(5)] + [warc.Record(warc.Fields([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<a>")]), b"x")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r.to_bytes()) for r in records))
    (tmp_path / "b.warc").write_bytes(b"".join(r.to_bytes() for r in records))
    found = warc.derivatives_of_files(spark, str(tmp_path)).collect()
    assert len(found) == 20 and len({r.record_id for r in found}) == 10 and {r.target_uri for r in found} == {f"http://{i}" for i in range(5)}
    with pytest.raises(ValueError):
        list(warc.parse(gzip.compress(records[0].to_bytes())[:-9]))


@pytest.mark.parametrize("piece", ["<script>a", "<!-- b", "<a href=c ", "<", "<title>d", "<html <html", "</"])
def test_broken_pages_take_one_pass(piece):
    began = time.perf_counter()
    text = warc.plain_text("start " + piece * 100_000 + " end")
    assert text.startswith("start") and time.perf_counter() - began < 5
    warc.read_page(piece * 100_000 + ">")
    assert time.perf_counter() - began < 10


def test_many_candidates_have_their_places(spark):
    text = " ".join(f"é{i:04d}abcdef0123456789" for i in range(3000))
    rows = secrets.candidates(spark.createDataFrame([(1, text), (1, "x " + text), (None, text), (2, None)], "doc_id long, text string")).collect()
    assert len(rows) == 9000
    for r in rows:
        assert r.candidate in (text[r.start : r.start + len(r.candidate)], ("x " + text)[r.start : r.start + len(r.candidate)])
