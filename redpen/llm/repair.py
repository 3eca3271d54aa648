"""Token ids as Re-Pair compressed shards.

Texts are encoded with the tokenizers library, an end id closes each document, and documents in
ascending doc_id order are gathered into shards. Each shard is compressed by its own grammar: again
and again the frequent id pairs are replaced by nonterminals, until none is frequent enough to pay for
a rule or all symbols are used. A round counts all pairs and replaces the most frequent ones at once.
Symbols are 16-bit: `TERMINALS` ids, then the rules.

A shard is a byte string:

    "RPG1", then 8 little-endian u32: documents, tokens, rules, symbols, end id, 0, 0, 0
    rules:      rules x (u16 left, u16 right); rule i makes symbol TERMINALS + i from earlier ones
    expansions: rules x u32, ids that the rule expands to
    documents:  documents x (i64 doc_id, u32 ids with the end id, u32 symbols)
    nulls:      documents x u8, 1 where doc_id is null
    symbols:    symbols x u16, without the end ids

so a document is decoded from its own symbols alone, and expansion lengths let a reader skip to any
place in it. Shards are rows of a Parquet table in the shared folder (part, shard, tokens before it
in its part, data), which any file store can hold.

Null text counts as empty and has the end id only. Null doc_ids come first; ties go by text, so rows
that repeat are documents of their own, side by side. A text that holds an added token's literal gets
that token's id, as the library gives it. A document longer than a shard is a shard of its own. An
empty table gives no shard. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialise

TERMINALS, FENCE, END, SHARD = 50_257, 65_535, 0, 1 << 18
#: A rule takes 8 bytes and saves 2 at each use; a pair of fewer than LEAST uses would save less than its rule takes.
LEAST, SHARE = 8, 1 / 16
#: Words after which a worker forgets all of them.
REMEMBERED = 1_000_000
#: Where a space may stand inside a piece; without this every space begins one.
SPACES = re.compile(r" (?=\s)(?<=\s )")


# -- ids -----------------------------------------------------------------------------------------


#: Marks that follow a word: with it they are two pieces of the tokenizer's pattern.
MARKS = b'.,!?;:#%&*$)"'
#: Longer words are not remembered.
WORD = 64


class WordTable:
    """Ids of words by two 64-bit hashes, looked up for all words at once. Open addressing leads to a word's
    number; what is known of a word lies by number, so the words of the first texts, most of them common
    ones, lie together."""

    def __init__(self, bits: int):
        self.bits, self.words, self.used = bits, 0, 0
        self.number = np.zeros(1 << bits, np.int32)  # 0 in a free slot
        self.key, self.check = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.begin, self.size = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
        self.ids = np.zeros(1 << bits, np.int32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for words not here and -2 for one whose first hash another word has."""
        slot = self._slot(key)
        out = self.number[slot]
        open_ = np.flatnonzero((self.key[out] != key) & (out != 0))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & (len(self.number) - 1)
            out[open_] = found = self.number[slot]
            go = (self.key[found] != key[open_]) & (found != 0)
            open_, slot = open_[go], slot[go]
        other = (self.check[out] != check) & (out != 0)
        out[out == 0] = -1
        out[other] = -2
        return out

    def add(self, key: np.ndarray, check: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        """Put in words that are not here, whose keys differ; `flat` has their ids one after another."""
        first, last = self.words + 1, self.words + 1 + len(key)  # number 0 is no word
        if 2 * last > len(self.number):
            self._deal(max(self.bits + 1, (4 * last).bit_length()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.int32)])
        while last > len(self.key):
            self.key, self.check, self.begin, self.size = (np.concatenate([x, np.zeros(len(x), x.dtype)]) for x in (self.key, self.check, self.begin, self.size))
        self.key[first:last], self.check[first:last], self.size[first:last] = key, check, size
        self.begin[first:last] = self.used + np.cumsum(size) - size
        self.ids[self.used : self.used + len(flat)] = flat
        self.used, self.words = self.used + len(flat), last - 1
        self._place(np.arange(first, last, dtype=np.int32))

    def _deal(self, bits: int) -> None:
        self.bits, self.number = bits, np.zeros(1 << bits, np.int32)
        self._place(np.arange(1, self.words + 1, dtype=np.int32))

    def _place(self, numbers: np.ndarray) -> None:
        slot = self._slot(self.key[numbers])
        while len(numbers):
            free = self.number[slot] == 0
            self.number[slot[free]] = numbers[free]  # the last one of a slot stays
            left = self.number[slot] != numbers
            numbers, slot = numbers[left], (slot[left] + 1) & (len(self.number) - 1)


class LibraryEncoder:
    """The tokenizers library, asked once for each distinct word a worker remembers.

    Texts are cut where the library's pattern always ends a piece: before spaces, before marks that end
    a word of letters, and around single line ends. Words are hashed and looked up as
    arrays. Of new ones, those of letters only are one piece and go to the library's model together,
    told apart by the bytes that ids cover; others go through the whole library. So do texts that hold
    an added token, which the library finds before any word, and texts with longer runs of white space.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.pieces = Tokenizer.from_file(path)
        self.pieces.pre_tokenizer, self.pieces.post_processor = pre_tokenizers.CharDelimiterSplit("\n"), None
        # The library writes a byte as one character: printable ones as themselves, the rest from 256 on.
        plain = np.zeros(256, bool)
        plain[33:127] = plain[161:173] = plain[174:] = True
        self.written = np.where(plain, np.arange(256), 255 + np.cumsum(~plain)).astype("<u2")
        self.written[0] = ord("\n")  # between words
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token)
        self.is_letter, self.is_print = np.zeros(256, bool), np.zeros(256, bool)
        self.is_letter[65:91] = self.is_letter[97:123] = self.is_print[33:127] = True
        # First bytes of the letters from U+00C0 to U+024F.
        self.is_lead, self.is_mark = np.zeros(256, bool), np.zeros(256, bool)
        self.is_lead[0xC3:0xCA] = True
        self.is_mark[list(MARKS)] = True
        self.table = WordTable(12)
        self.powers: list[tuple[np.ndarray, np.ndarray]] = []

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def letters(self, data: np.ndarray, size: np.ndarray, block: int = 1000) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each): of words of letters, which may start with a space, given as their bytes
        one after another."""
        end = np.cumsum(size)
        raw = np.zeros(len(data) + len(size), np.uint8)
        raw[np.arange(len(data)) + np.repeat(np.arange(len(size)), size)] = data
        place = np.r_[0, end + np.arange(1, len(size) + 1)]  # where each word starts, with what is between
        parts = [self.written[raw[place[i] : place[min(i + block, len(size))] - 1]].tobytes().decode("utf-16-le") for i in range(0, len(size), block)]
        found = [np.array(e.ids, np.int32) for e in self.pieces.encode_batch_fast(parts, add_special_tokens=False)]
        ids = np.concatenate([*found, np.zeros(0, np.int32)])
        cut = np.searchsorted(np.cumsum(self.n_bytes[ids]), end, "right")
        return ids, np.diff(np.r_[0, cut])

    def hashes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """Two polynomial hashes, modulo 2 ** 64, of each span of `data`."""
        if not self.powers or len(self.powers[0][0]) < len(data):
            self.powers = []
            for base in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93):
                grown = [np.cumprod(np.full(max(1 << 18, len(data)) + 1, b, np.uint64)) for b in (base, pow(base, -1, 1 << 64))]
                self.powers.append((grown[0], grown[1]))
        out = []
        for up, down in self.powers:
            sums = np.r_[np.uint64(0), np.cumsum((data + np.uint64(1)) * up[: len(data)])]
            out.append((sums[end] - sums[start]) * down[start])
        out[0][out[0] == 0] = 1  # of a free slot
        return out

    def encode_batch(self, texts: list[str], block: int = 1 << 17) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        held: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            if not t or "\0" in t or any(x in t for x in self.added) or SPACES.search(t):
                out[i] = self.whole(t)
                continue
            if held and size + len(t) > block:
                self._together(texts, held, out)
                held, size = [], 0
            held.append(i)
            size += len(t)
        if held:
            self._together(texts, held, out)
        return out

    def _together(self, texts: list[str], held: list[int], out: list) -> None:
        raw = ("\0".join([texts[i] for i in held]) + "\0").encode()
        data = np.frombuffer(raw, np.uint8)
        space, stop, line = data == 32, data == 0, data == 10
        before = np.r_[np.uint8(0), data[:-1]]
        sign = (before == 0xC3) & ((data == 0x97) | (data == 0xB7))  # two signs among the letters
        letter = self.is_letter[data] | ((data & 0xC0) == 0x80) & self.is_lead[before] & ~sign
        ends_letter = np.r_[False, letter[:-1]]
        begins = space | stop | np.r_[True, stop[:-1]]
        # Marks from the end of a word of letters up to white space.
        mark = self.is_mark[data]
        other = np.flatnonzero(~mark)
        run = np.flatnonzero(mark & ends_letter)
        after = data[other[np.searchsorted(other, run)]]
        begins[run[(after == 32) | (after == 0) | (after == 10)]] = True
        # Single line ends between other characters.
        line &= (self.is_print[before] | ends_letter) & np.r_[(self.is_print | self.is_lead)[data[1:]], False]
        begins |= line | np.r_[False, line[:-1]]
        start = np.flatnonzero(begins)
        end = np.r_[start[1:], len(data)]
        key, check = self.hashes(data, start, end)
        if self.table.words > REMEMBERED:
            self.table = WordTable(12)
        slot = self.table.find(key, check)
        short = end - start <= WORD
        missing = np.flatnonzero((slot == -1) & short)
        if missing.size:
            new = missing[np.unique(key[missing], return_index=True)[1]]
            odd = np.r_[0, np.cumsum(~letter & ~self.is_lead[data])]
            head = start[new] + space[start[new]]
            plain = (odd[end[new]] == odd[head]) & (head < end[new])
            some, rest = new[plain], new[~plain]
            length = end[some] - start[some]
            self.table.add(key[some], check[some], *self.letters(data[_spans(start[some], length)], length))
            found = [self.whole(raw[a:b].decode()) if raw[a] else np.zeros(0, np.int32) for a, b in zip(start[rest].tolist(), end[rest].tolist(), strict=True)]
            self.table.add(key[rest], check[rest], np.concatenate([*found, np.zeros(0, np.int32)]), np.fromiter(map(len, found), np.int64, len(found)))
            slot[missing] = self.table.find(key[missing], check[missing])
        table, alone = self.table, np.flatnonzero((slot < 0) | ~short)
        begin, size = table.begin[slot], table.size[slot]
        ids = table.ids
        if alone.size:  # long words, and any whose hash another one has
            found = [self.whole(raw[start[i] : end[i]].decode()) for i in alone.tolist()]
            size[alone] = [len(x) for x in found]
            begin[alone] = len(ids) + np.cumsum(size[alone]) - size[alone]
            ids = np.concatenate([ids, *found])
        ids = ids[_spans(begin, size)]
        cut = np.cumsum(size)[stop[start]].tolist()
        for i, a, b in zip(held, [0, *cut[:-1]], cut, strict=True):
            out[i] = ids[a:b]


@functools.cache
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


# -- the grammar ---------------------------------------------------------------------------------


def _spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the spans that start at `begin`, one after another."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


#: Bits of a pair's hash, and a value that stands for no pair: it is one of two fences.
HASH, NONE = 16, 0xFFFFFFFF


def _hash(pair: np.ndarray) -> np.ndarray:
    return (pair * np.uint32(0x9E3779B1) >> np.uint32(32 - HASH)).astype(np.int64)


def _frequent(pair: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(pair, number) of those that stand `least` times or more and have no fence, in ascending order."""
    ordered = np.sort(pair)
    if len(ordered) < least:
        return ordered[:0], np.zeros(0, np.int64)
    # Where a pair stands `least` times, what is `least` - 1 places on is the same pair.
    same = np.zeros(len(ordered) - least + 3, bool)
    same[1:-1] = ordered[least - 1 :] == ordered[: len(ordered) - least + 1]
    edge = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
    found, count = ordered[edge[:, 0]], edge[:, 1] - edge[:, 0] + least - 1
    inside = (found >> 16 != FENCE) & (found & 0xFFFF != FENCE)
    return found[inside], count[inside]


def compress(docs: list[np.ndarray], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, symbols of each document, rules): Re-Pair over documents of ids below TERMINALS, until no
    pair stands `least` times or the symbols are used up.

    A round takes the pairs at least `SHARE` times as often as the most frequent one. Where two of them
    overlap the more frequent one is replaced, in a run of equal symbols every second place from its
    left. A pair that wins too few places waits for a later round; one with a rule already needs none.
    """
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    seq = np.full(int(sizes.sum()) + len(docs), FENCE, np.uint32)  # a fence after each document
    seq[_spans(np.cumsum(sizes + 1) - sizes - 1, sizes)] = np.concatenate([*docs, np.zeros(0, np.int32)])
    rules: list[int] = []
    symbol_of: dict[int, int] = {}
    while len(seq) > 1 and len(rules) < FENCE - TERMINALS:
        pair = seq[:-1] << 16 | seq[1:]
        chosen, count = _frequent(pair, least)
        if not len(chosen):
            break
        often = count >= SHARE * count.max()
        chosen, count = chosen[often], count[often]
        order = np.lexsort((chosen, -count))
        rank = np.empty(len(chosen), np.int32)
        rank[order] = np.arange(len(chosen))
        # Of pairs with one hash the most frequent is looked for, the others wait.
        place = _hash(chosen)
        wanted, number = np.full(1 << HASH, NONE, np.uint32), np.zeros(1 << HASH, np.int32)
        wanted[_hash(np.array([NONE], np.uint32))] = NONE - 1
        wanted[place[order[::-1]]], number[place[order[::-1]]] = chosen[order[::-1]], order[::-1]
        place = _hash(pair)
        at = np.flatnonzero(np.take(wanted, place) == pair)
        slot = number[place[at]]
        # Every second place of a run of one pair, then places that no better pair overlaps.
        touch = np.diff(at) == 1
        goes_on = touch & (slot[1:] == slot[:-1])
        if goes_on.any():
            begin = np.maximum.accumulate(np.where(np.r_[False, goes_on], 0, np.arange(len(at))))
            even = (np.arange(len(at)) - begin) % 2 == 0
            at, slot = at[even], slot[even]
            touch = np.diff(at) == 1
        better = rank[slot[1:]] < rank[slot[:-1]]
        won = ~(np.r_[touch & better, False] | np.r_[False, touch & ~better])
        at, slot = at[won], slot[won]
        uses = np.bincount(slot, minlength=len(chosen))
        symbol = np.zeros(len(chosen), np.int64)
        used = np.flatnonzero(uses)
        found = []
        for p, n in zip(chosen[used].tolist(), uses[used].tolist(), strict=True):
            if p not in symbol_of and 2 * n >= least and len(rules) < FENCE - TERMINALS:
                symbol_of[p] = TERMINALS + len(rules)
                rules.append(p)
            found.append(symbol_of.get(p, 0))
        symbol[used] = found
        new = symbol[slot]
        at, new = at[new > 0], new[new > 0]
        seq[at] = new
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
    fences = np.flatnonzero(seq == FENCE)
    return seq[seq != FENCE].astype(np.uint16), np.diff(np.r_[-1, fences]) - 1, np.array(rules, np.uint32)


def expansions(rules: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, begin, size): what every symbol stands for, end to end, with its place and length."""
    size = np.r_[np.ones(TERMINALS, np.int64), lengths]
    begin = np.cumsum(size) - size
    flat = np.zeros(int(size.sum()), np.int32)
    flat[:TERMINALS] = np.arange(TERMINALS)
    left, right = (rules >> 16).astype(np.int64), (rules & 0xFFFF).astype(np.int64)
    depth = np.zeros(TERMINALS + len(rules), np.int64)
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True), TERMINALS):
        depth[i] = max(depth[a], depth[b]) + 1
    # Rules of one depth are filled together, from those below.
    for d in range(1, int(depth.max()) + 1):
        i = np.flatnonzero(depth == d)
        a, b = left[i - TERMINALS], right[i - TERMINALS]
        flat[_spans(begin[i], size[a])] = flat[_spans(begin[a], size[a])]
        flat[_spans(begin[i] + size[a], size[b])] = flat[_spans(begin[b], size[b])]
    return flat, begin, size


# -- shards --------------------------------------------------------------------------------------


def pack(doc_ids: list[int | None], docs: list[np.ndarray]) -> bytes:
    """A shard of documents given as ids without their end id."""
    symbols, per_doc, rules = compress(docs)
    size = np.ones(65_536, np.uint32)
    for i, r in enumerate(rules.tolist()):
        size[TERMINALS + i] = size[r >> 16] + size[r & 0xFFFF]
    table = np.zeros(len(docs), "<i8,<u4,<u4")
    table["f0"] = [0 if i is None else i for i in doc_ids]
    table["f1"] = [len(d) + 1 for d in docs]
    table["f2"] = per_doc
    nulls = np.array([i is None for i in doc_ids], np.uint8)
    pairs = np.stack([rules >> 16, rules & 0xFFFF], 1).astype("<u2")
    head = b"RPG1" + struct.pack("<8I", len(docs), int(table["f1"].sum()), len(rules), len(symbols), END, 0, 0, 0)
    return b"".join([head, pairs.tobytes(), size[TERMINALS : TERMINALS + len(rules)].astype("<u4").tobytes(), table.tobytes(), nulls.tobytes(), symbols.astype("<u2").tobytes()])


class Shard:
    """Reader of a packed shard."""

    def __init__(self, data: bytes):
        if data[:4] != b"RPG1":
            raise ValueError("not a shard")
        docs, self.tokens, rules, symbols, self.end, *_ = struct.unpack_from("<8I", data, 4)
        at = 36

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        pairs = take("<u2", 2 * rules).reshape(-1, 2).astype(np.uint32)
        self.rules, self.lengths = pairs[:, 0] << 16 | pairs[:, 1], take("<u4", rules)
        self.table, self.nulls, self.symbols = take("<i8,<u4,<u4", docs), take("u1", docs), take("<u2", symbols)
        self.first = np.r_[0, np.cumsum(self.table["f2"], dtype=np.int64)]
        self.flat, self.begin, self.size = expansions(self.rules, self.lengths.astype(np.int64))

    def __len__(self) -> int:
        return len(self.table)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        return self.flat[_spans(self.begin[symbols], self.size[symbols])]

    def checksums(self) -> list[int]:
        """The CRC-32 of all ids of each document, as little-endian 32-bit integers, from one expansion."""
        raw = self.expand(self.symbols).astype("<u4").tobytes()
        end = struct.pack("<I", self.end)
        cut = (4 * np.r_[0, np.cumsum(self.table["f1"].astype(np.int64) - 1)]).tolist()
        return [zlib.crc32(end, zlib.crc32(raw[a:b])) for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def document(self, i: int) -> np.ndarray:
        """All ids of document i, the end id included."""
        return np.append(self.expand(self.symbols[self.first[i] : self.first[i + 1]]), np.int32(self.end))

    def token(self, i: int, place: int) -> int:
        """One id of document i, by skipping over whole expansions."""
        symbols = self.symbols[self.first[i] : self.first[i + 1]]
        ends = np.cumsum(self.size[symbols])
        k = int(np.searchsorted(ends, place, "right"))
        if k >= len(symbols):
            return self.end
        return int(self.flat[self.begin[symbols[k]] + place - (ends[k] - self.size[symbols[k]])])


def write_shards(docs: DataFrame, path: str, parts: int, shard: int = SHARD) -> DataFrame:
    """The table of shards of `docs` (doc_id, text): part, shard, before, tokens, data; written and
    reread. Parts are ranges of doc_id; a shard has `shard` ids or one document at least."""

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, code = TaskContext.get().partitionId(), encoder(path)
        ids: list[int | None] = []
        held: list[np.ndarray] = []
        count = before = number = 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([count], pa.int64()), pa.array([pack(ids, held)], pa.binary())], ["part", "shard", "before", "tokens", "data"])

        for b in batches:
            for start in range(0, b.num_rows, 2048):
                rows = b.slice(start, 2048)
                for i, x in zip(rows.column(0).to_pylist(), code.encode_batch(rows.column(1).to_pylist()), strict=True):
                    ids.append(i), held.append(x)
                    count += len(x) + 1
                    if count >= shard:
                        yield full()
                        before, number, count = before + count, number + 1, 0
                        ids, held = [], []
        if ids:
            yield full()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return materialise(dealt.mapInArrow(per_partition, "part int, shard int, before long, tokens long, data binary"), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the shards."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = Shard(data.as_py())
                n = s.table["f1"].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(s.table["f0"], mask=s.nulls.astype(bool)), pa.array(base + np.cumsum(n) - n), pa.array(n), pa.array(s.checksums(), pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # One row per part, and parts are at most as many as partitions.
    sums = shards.groupBy("part").agg(F.sum("tokens").alias("n")).orderBy("part").collect()
    bases, total = [], 0
    for r in sums:
        bases += [F.lit(r.part), F.lit(total)]
        total += r.n
    base = F.element_at(F.create_map(*bases), F.col("part")) if bases else F.lit(0)
    placed = shards.select((base.cast("long") + F.col("before")).alias("base"), "data")
    return placed.mapInArrow(per_batch, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_repair_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return read_shards(write_shards(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), parts))
