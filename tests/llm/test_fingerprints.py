from __future__ import annotations

import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from redpen.llm import syncmers
from tests.llm.helpers import ODD, documents


def test_edited_texts_and_incremental_fingerprints(spark):
    random.seed(3)
    words = ["alpha", "beta", "gäma", "del ta", "ep\nsilon", "zeta中"]
    rows = [(i * 3, " ".join(random.choice(words) for _ in range(random.choice([0, 1, 2, 5, 40, 300])))) for i in range(60)]
    rows.append((7, rows[20][1]))
    docs = documents(spark, rows)
    found = {r.doc_id: r for r in syncmers.edit_fingerprints(docs, 7).collect()}
    ordered = sorted(rows)
    wanted = []
    for k, (i, t) in enumerate(ordered):
        cut = len(t) // 4
        wanted.append((i, len(t), t[: len(t) - cut] + ordered[(k + 1) % len(ordered)][1][:cut]))
    whole = spark.createDataFrame([(i, e) for i, _, e in wanted], "doc_id long, e string")
    whole = {r.doc_id: r.f for r in whole.select("doc_id", syncmers.as_string(syncmers.fingerprint(F.col("e"))).alias("f")).collect()}
    assert len(found) == len(rows)
    for i, n, e in wanted:
        assert found[i].n_chars == n
        assert found[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert found[i].edited_fingerprint == whole[i]  # taken over in part, equal to the whole one
    assert found[7].fingerprint == found[60].fingerprint
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found.values())


def test_closed_syncmers_against_plain_python(spark):
    text = "the quick brown fox jumps over the lazy dog, and then over the other dog again"
    data = text.encode()
    k, s = syncmers.K, syncmers.S
    hashes = [r[0] for r in spark.createDataFrame([(bytes(data[i : i + s]),) for i in range(len(data) - s + 1)], "b binary").coalesce(1).select(F.xxhash64("b")).collect()]
    wanted = [i + 1 for i in range(len(data) - k + 1) if min(h := hashes[i : i + k - s + 1]) in (h[0], h[-1])]
    row = spark.createDataFrame([(text,)], "t string").select(syncmers.anchor_places(F.col("t").cast("binary")).alias("p")).first()
    assert list(row.p) == wanted


def test_odd_rows(spark):
    rows = syncmers.edit_fingerprints(documents(spark, ODD), 5).collect()
    assert len(rows) == len(ODD)
    empty = [r for r in rows if r.n_chars == 0]
    assert len(empty) == 2 and all(r.fingerprint == "" for r in empty)
    assert len({r.fingerprint for r in rows if r.doc_id in (4, 8)}) == 1


@pytest.mark.parametrize("rows", [[], [(5, "only one document here, and it is followed by itself")]])
def test_no_or_one_row(spark, rows):
    assert syncmers.edit_fingerprints(documents(spark, rows), 4).count() == len(rows)


def plain_hash(data):
    h = xxhash.xxh64_intdigest(data, 42)
    return h - (1 << 64) if h >> 63 else h


def plain_anchors(data):
    """{place: hash} of the anchors of some bytes."""
    k, s = syncmers.K, syncmers.S
    if len(data) < k:
        return {1: plain_hash(data) >> 32} if data else {}
    smers = [plain_hash(data[i : i + s]) for i in range(len(data) - s + 1)]
    kmers = {i + 1: plain_hash(data[i : i + k]) >> 32 for i in range(len(data) - k + 1)}
    closed = {i: h for i, h in kmers.items() if min(w := smers[i - 1 : i + k - s]) in (w[0], w[-1])}
    return closed or dict([min(kmers.items(), key=lambda x: x[1])])


def plain_likeness(a, b):
    if not a and not b:
        return 1.0
    union = sorted(a | b)[: syncmers.SKETCH]
    return len(a & b & set(union)) / len(union)


def test_all_against_brute_force(spark):
    random.seed(12)
    rows = [(i, "".join(random.choice("abcdeé ") for _ in range(i % 41))) for i in range(400)]
    rows += [(400 + i, "".join(random.choice("abcdefgh ") for _ in range(random.randint(100, 3000)))) for i in range(30)] + [(500, "different yy")]
    found = {r.doc_id: r for r in syncmers.edit_fingerprints(documents(spark, rows), 6).collect()}
    of = lambda t: set(sorted(set(plain_anchors(t.encode()).values()))[: syncmers.SKETCH])
    text = lambda f: "".join(f"{h & 0xFFFFFFFF:08x}" for h in sorted(f))
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c, r = of(t), of(edited), of(after), found[i]
        assert (r.fingerprint, r.edited_fingerprint) == (text(a), text(b))
        assert r.near_edited == pytest.approx(plain_likeness(a, b)) and r.near_next == pytest.approx(plain_likeness(a, c))
        assert (r.fingerprint == "") == (t == "")
        if len(edited.encode()) > 200:
            x, y = plain_anchors(edited.encode()), plain_anchors(t.encode())
            assert r.edited_placed == pytest.approx(len(x.items() & y.items()) / len(x))
