"""Byte-level BPE encoding and decoding on padded numpy matrices.

A text is cut into pieces by the pattern, every distinct piece is encoded once per batch, and pieces
are encoded together: bucketed by length into padded id matrices, in which every row merges its
leftmost pair of lowest rank each round. Ranks come from a hash table over pairs (open addressing in
two arrays), and a round closes the gaps its merges leave, so rows shrink together. Rows without a
pair to merge leave the matrix. Pieces longer than `WIDEST` bytes take a heap over a linked list
instead, which does the same merges in n log n steps.

Null text counts as empty; an empty text has no ids. Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import documents, spread

WIDEST = 256
#: Distinct words in each of the two generations a worker remembers; when the young one is full it
#: becomes the old one, so memory is bounded and frequent words stay.
REMEMBERED = 150_000
_INT = struct.Struct("=i")
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """rank -> merged id of an id pair, by open addressing; absent pairs give -1."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 3))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(key)
        todo = np.arange(len(key))
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.keys[slot[todo]] == -1
            _, winner = np.unique(slot[todo[free]], return_index=True)
            put = todo[free][winner]
            self.keys[slot[put]], self.values[slot[put]] = key[put], merged[put]
            done = np.zeros(len(key), bool)
            done[put] = True
            todo = todo[~done[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(key)
        out = np.full(key.shape, -1, np.int32)
        open_ = np.ones(key.shape, bool)
        for _ in range(self.probes):
            found = self.keys[slot]
            hit = open_ & (found == key)
            out[hit] = self.values[slot[hit]]
            open_ &= ~hit & (found != -1)
            if not open_.any():
                break
            slot = (slot + 1) & ((1 << self.bits) - 1)
        return out


class ByteBPE:
    """A rank file's encoder and decoder. A pair's rank is the id of its joined bytes."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.bytes_of[i] = b
        self.pieces = regex.compile(pattern).findall
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        splits = [(ranks[a], ranks[b[n:]], i) for b, i in ranks.items() for n in range(1, len(b)) if (a := b[:n]) in ranks and b[n:] in ranks]
        self.pairs = PairTable(*(np.array(x, np.int64) for x in zip(*splits, strict=True)))
        self.marks = {m: _INT.pack(ranks[m.encode()]) for m in ",."}
        self.decimal = [str(i) for i in range(len(self.bytes_of))]
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    # -- pieces ---------------------------------------------------------------------------------

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as 32-bit integers in a byte string."""
        out = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[i] = _INT.pack(whole)
            elif len(p) > WIDEST:
                out[i] = array("i", self._by_heap(p)).tobytes()
            else:
                buckets.setdefault((len(p) + 3) // 4, []).append(i)
        for places in buckets.values():
            for start in range(0, len(places), 8192):
                block = places[start : start + 8192]
                for i, ids in zip(block, self._merge([pieces[i] for i in block]), strict=True):
                    out[i] = ids
        return out

    def _merge(self, pieces: list[bytes]) -> list[bytes]:
        n, width = len(pieces), max(map(len, pieces))
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        size = np.fromiter(map(len, pieces), np.int64, n)
        ids = np.where(np.arange(width) < size[:, None], self.byte_id[raw], -1)
        out = [b""] * n
        row = np.arange(n)
        none = np.int32(2**31 - 1)

        def ranked(m: np.ndarray) -> np.ndarray:
            r = self.pairs.get(m[:, :-1], m[:, 1:])
            r[(r < 0) | (m[:, 1:] < 0)] = none
            return r

        rank = ranked(ids)
        while True:
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(ids), np.int64)
            best = rank[np.arange(len(ids)), at] if rank.shape[1] else np.full(len(ids), none)
            done = best == none
            if done.any():
                raw, width = np.ascontiguousarray(ids[done]).tobytes(), 4 * ids.shape[1]
                for j, (i, k) in enumerate(zip(row[done].tolist(), size[done].tolist(), strict=True)):
                    out[i] = raw[j * width : j * width + 4 * k]
                go = ~done
                ids, rank, at, best, row, size = ids[go], rank[go], at[go], best[go], row[go], size[go]
                if not len(ids):
                    return out
            # The pair's left place takes the merged id; what stands right of it moves up by one.
            col = np.arange(ids.shape[1] - 1)
            moved = np.where(col > at[:, None], ids[:, 1:], ids[:, :-1])
            k = np.arange(len(ids))
            moved[k, at] = best
            size = size - 1
            ids = moved[:, : int(size.max())]
            at = np.minimum(at, ids.shape[1] - 1)
            # Ranks move along; only the pairs that touch the merged id are looked up.
            rank = np.where(col[:-1] > at[:, None], rank[:, 1:], rank[:, :-1])[:, : ids.shape[1] - 1] if rank.shape[1] > 1 else rank[:, :0]
            for step in (-1, 0):
                left = at + step
                ok = (left >= 0) & (left < ids.shape[1] - 1)
                r = self.pairs.get(ids[k[ok], left[ok]], ids[k[ok], left[ok] + 1])
                r[(r < 0) | (ids[k[ok], left[ok] + 1] < 0)] = none
                rank[k[ok], left[ok]] = r

    def _rank(self, a: int, b: int) -> int | None:
        return self.ranks.get(self.bytes_of[a] + self.bytes_of[b])

    def _by_heap(self, piece: bytes) -> list[int]:
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := self._rank(ids[i], ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else -1
            if j < 0 or self._rank(ids[i], ids[j]) != r:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (x := self._rank(r, ids[k])) is not None:
                    heapq.heappush(heap, (x, i))
            if (h := before[i]) >= 0 and (x := self._rank(ids[h], r)) is not None:
                heapq.heappush(heap, (x, h))
        return [i for i in ids if i >= 0]

    # -- texts ----------------------------------------------------------------------------------

    def learn(self, words: set[str]) -> None:
        """Encode words not met before. A word is text whose ends are ends of pieces; known words map
        to their ids as 32-bit integers."""
        if len(self.known) > REMEMBERED:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        new = []
        stems = []
        for w in words - known.keys():
            if (x := old.get(w)) is not None:
                known[w] = x
            elif w[-1] in self.marks and w[1:-1].isalpha():
                stems.append(w)  # letters and a mark are two pieces
            else:
                new.append(w)
        for w in {w[:-1] for w in stems} - known.keys():
            if (x := old.get(w)) is not None:
                known[w] = x
            else:
                new.append(w)
        cut = [self.pieces(w) for w in new]
        distinct = list({p for c in cut for p in c})
        ids = dict(zip(distinct, self.encode_pieces([p.encode() for p in distinct]), strict=True))
        for w, c in zip(new, cut, strict=True):
            known[w] = ids[c[0]] if len(c) == 1 else b"".join([ids[p] for p in c])
        for w in stems:
            known[w] = known[w[:-1]] + self.marks[w[-1]]

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text."""
        cut = [split_words(t) for t in texts]
        self.learn(set().union(*cut))
        known = self.known
        for c in cut:
            yield np.frombuffer(b"".join([known[w] for w in c]), np.int32).tolist()

    def encode(self, text: str | None) -> list[int]:
        return next(self.encode_batch([text or ""]))

    def as_text(self, ids: list[int]) -> str:
        """Decimal ids joined by commas."""
        return ",".join([self.decimal[i] for i in ids])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_UNSAFE = regex.compile(r"\s \s")


def split_words(text: str) -> list[str]:
    """`text` cut before single spaces, where the pattern always ends a piece: a space starts a piece
    unless it stands inside a longer run of white space with more of the run on both sides. A text
    with such a run stays whole."""
    if not text:
        return []
    if _UNSAFE.search(text):
        return [text]
    first, *rest = text.split(" ")
    rest = [" " + w for w in rest]
    return [first, *rest] if first else rest


@functools.cache
def tokenizer(path: str) -> ByteBPE:
    """The encoder of a rank file, built once per worker process."""
    return ByteBPE(path)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the ids (decimal, joined by commas) and of the decoded bytes."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in batches:
            for part in range(0, b.num_rows, 256):
                rows = b.slice(part, 256)
                counts, of_ids, of_bytes = [], [], []
                for ids in bpe.encode_batch([t or "" for t in rows.column(1).to_pylist()]):
                    counts.append(len(ids))
                    of_ids.append(hashlib.sha256(bpe.as_text(ids).encode()).hexdigest())
                    of_bytes.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return spread(docs.select("doc_id", "text")).mapInArrow(per_batch, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """`columns` of docs (doc_id, text and others) with ids and round_trip: whether they decode to the text."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in batches:
            for part in range(0, b.num_rows, 256):
                rows = b.slice(part, 256)
                texts = [t or "" for t in rows.column(len(columns)).to_pylist()]
                ids = list(bpe.encode_batch(texts))
                same = [bpe.decode(i) == t.encode() for i, t in zip(ids, texts, strict=True)]
                made = [pa.array(list(map(len, ids)), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(columns)], *made], [*columns, "n_tokens", "ids", "round_trip"])

    fields = docs.select(*columns).schema.add("n_tokens", "long").add("ids", ArrayType(IntegerType())).add("round_trip", "boolean")
    return spread(docs.select(*columns, F.col("text").alias("encoded_text"))).mapInArrow(per_batch, fields)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
