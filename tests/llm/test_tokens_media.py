from __future__ import annotations

import base64
import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from redpen.llm import avi, bpe, repair
from tests.llm.helpers import ODD, documents

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
PIECES = ["a", "b", " ", "  ", "\n", "é", "中", "1", "'s", "\t", "!", ",", "<|endoftext|>", "th", "e", "　", "the", "ſ", "\x85", "😀", "́"]


def texts(n=1500):
    random.seed(9)
    made = ["".join(random.choice(PIECES) for _ in range(random.randint(0, 40))) for _ in range(n)]
    return [*made, "", "a" * 900, "ab" * 500, "".join(random.choice("abcdeé") for _ in range(2000)), " " * 300, "!?" * 200, "plain words, and marks. More words, too."]


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(reference):
    code = bpe.ByteBPE(RANKS)
    ts = texts()
    for got, t in zip(code.encode_batch(ts), ts, strict=True):
        assert got == reference.encode_ordinary(t)
        assert code.decode(got) == t.encode()


def test_generations_of_words_change_nothing(reference, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    code = bpe.ByteBPE(RANKS)
    for t in texts(200):
        assert code.encode(t) == reference.encode_ordinary(t)


def test_bpe_queries(spark, reference):
    found = {r.doc_id: r for r in bpe.digests(documents(spark, ODD), RANKS).collect()}
    for i, t in ODD:
        ids = reference.encode_ordinary(t or "")
        assert (found[i].n_tokens, found[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert found[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    rows = bpe.encoded(documents(spark, ODD), RANKS, ["doc_id", "source"]).collect()
    assert len(rows) == len(ODD) and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    assert bpe.digests(documents(spark, []), RANKS).count() == 0


# -- shards --------------------------------------------------------------------------------------


def test_grammar_round_trip_and_random_access():
    random.seed(1)
    draw = np.random.default_rng(2)
    docs = [draw.zipf(1.3, n).clip(0, 50_256).astype(np.int32) for n in (0, 1, 2, 5000, 300, 0)] + [np.zeros(777, np.int32), np.array([5, 5, 5] * 50 + [6], np.int32)]
    ids = [1, None, 3, 4, 5, 6, 7, 8]
    data = repair.pack(ids, docs)
    shard = repair.Shard(data)
    assert len(data) < sum(4 * len(d) for d in docs) and len(shard.rules)
    for i, d in enumerate(docs):
        assert shard.document(i).tolist() == [*d.tolist(), 0]
        assert [shard.token(i, p) for p in range(0, len(d) + 1, 7)] == [*d.tolist(), 0][::7]
    assert shard.nulls.tolist() == [0, 1, 0, 0, 0, 0, 0, 0]
    for i, r in enumerate(shard.rules.tolist()):
        assert max(r >> 16, r & 0xFFFF) < repair.TERMINALS + i and shard.lengths[i] == len(plain_expansion(shard.rules.tolist(), repair.TERMINALS + i))


def test_library_words_equal_whole_texts():
    code = repair.encoder(P.path("byte_bpe_50k.json"))
    ts = texts()
    assert [x.tolist() for x in code.encode_batch(ts)] == code.ids(ts)
    assert 50_256 in code.encode_batch(["a <|endoftext|> b"])[0].tolist()
    words = ["one", "Two,", "thrée.\nFour", "'s", "it's", "x1", "12", "end###", "a\nb\nc", "\n", "a\n\nb", "中文", "\u0870\u088e", "(in)", "q\"", "\u2028", "tab\there", "\U00031350"]
    random.seed(3)
    mixed = [" ".join(random.choice(words) for _ in range(random.randint(0, 30))) for _ in range(2000)]
    assert [x.tolist() for x in code.encode_batch(mixed)] == code.ids(mixed)


def test_few_remembered_words_change_nothing(monkeypatch):
    monkeypatch.setattr(repair, "REMEMBERED", 3)
    code = repair.LibraryEncoder(P.path("byte_bpe_50k.json"))
    for start in range(0, 200, 20):
        part = texts(200)[start : start + 20]
        assert [x.tolist() for x in code.encode_batch(part)] == code.ids(part)


def plain_expansion(rules, symbol):
    if symbol < repair.TERMINALS:
        return [symbol]
    r = rules[symbol - repair.TERMINALS]
    return plain_expansion(rules, r >> 16) + plain_expansion(rules, r & 0xFFFF)


def test_grammar_ends_when_no_pair_pays():
    draw = np.random.default_rng(4)
    docs = [draw.zipf(1.4, n).clip(0, 400).astype(np.int32) for n in (3000, 1, 700)] + [np.full(1000, 9, np.int32), np.tile(np.array([1, 2, 3], np.int32), 90)]
    symbols, per_doc, rules = repair.compress(docs)
    assert len(set(rules.tolist())) == len(rules)
    out = [x for s in symbols.tolist() for x in plain_expansion(rules.tolist(), s)]
    assert out == np.concatenate(docs).tolist()
    cut = np.split(symbols, np.cumsum(per_doc)[:-1])
    left = Counter()
    for d in cut:
        d, i = d.tolist(), 0
        while i + 1 < len(d):  # places that do not overlap
            left[d[i], d[i + 1]] += 1
            i += 2 if d[i : i + 1] * 2 == d[i : i + 2] else 1
    assert max(left.values()) < repair.LEAST
    shard = repair.Shard(repair.pack(list(range(len(docs))), docs))
    assert shard.checksums() == [zlib.crc32(np.append(d, 0).astype("<u4").tobytes()) for d in docs]


def test_shards_of_a_table(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [r for r in ODD if r[0] is not None] + [(20 + i, t) for i, t in enumerate(texts(60))]
    shards = repair.write_shards(documents(spark, rows), path, 3, shard=500)
    found = sorted(repair.read_shards(shards).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted(i for i, _ in rows)
    at = 0
    by = dict(rows)
    for r in found:
        ids = [*library.encode(by[r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    nothing = repair.write_shards(documents(spark, []), path, 2)
    assert repair.read_shards(nothing).count() == 0
    assert repair.read_shards(repair.write_shards(documents(spark, ODD), path, 2)).count() == len(ODD)


# -- media ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 3072, 3073, 20_000])
def test_avi_round_trip(n):
    payload = avi.pad(os.urandom(n))
    assert len(payload) % avi.UNIT == 0 and len(payload) >= max(n, avi.UNIT)
    media = avi.encode(payload)
    assert avi.decode(media) == payload and avi.decode(avi.encode(avi.pad(b"x" * n))) == avi.pad(b"x" * n)


def test_broken_media_raise():
    media = avi.encode(avi.pad(b"hello"))
    with pytest.raises(ValueError):
        avi.read_index(b"RIFX" + media[4:])
    place, size = avi.read_index(media)[1][0]
    spoilt = bytearray(media)
    spoilt[place + size - 20] ^= 0xFF
    with pytest.raises(ValueError):
        avi.decode(bytes(spoilt))


def test_shots_split_where_the_histogram_jumps():
    frame = avi.UNIT * avi.ROWS
    payload = b"a" * frame * 4 + b"\xe4\xb8\xad" * (frame) + b"a" * frame * 2
    decoded = list(avi.frames(avi.encode(payload)))
    clips = avi.shots(decoded, 40_000)
    assert [(c["first"], c["frames"]) for c in clips] == [(0, 4), (4, 3), (7, 2)]
    assert [c["start_ms"] for c in clips] == [0, 160, 280] and clips[-1]["end_ms"] == 360


def test_media_queries(spark):
    found = {r.doc_id: r for r in avi.digests(documents(spark, ODD)).collect()}
    for i, t in ODD:
        payload, r = avi.pad((t or "").encode()), found[i]
        media = avi.encode(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest())
    assert found[4].feature == found[8].feature
    table = spark.createDataFrame([(1, avi.encode(avi.pad(b"a" * 9000))), (2, None)], "k long, media binary")
    rows = avi.clip_rows(table, "k", "media").collect()
    assert [(r.k, r.clip, r.frames) for r in rows] == [(1, 0, 3)]
    assert avi.digests(documents(spark, [])).count() == 0
