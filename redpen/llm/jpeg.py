"""Baseline JPEG frames: markers, Huffman decoding, dequantisation, inverse DCT.

Reads sequential Huffman-coded JPEGs of 8-bit samples (SOF0 and SOF1) with any tables, up to four
components of any sampling, interleaved or one scan each, with or without restart intervals. A frame
without DHT segments gets the tables of Annex K, which motion-JPEG files leave out. Progressive,
arithmetic-coded and lossless frames, heights given by DNL, and two fields in a frame raise
ValueError, as do broken streams. Planes are those of the components: not upsampled, no colours made.

Many frames are read at once: each restart interval begins at a whole byte, so the intervals of all
frames are decoded in lockstep, a symbol of each in a step. What a frame gives does not depend on the
frames beside it: all arithmetic is on whole numbers, below 2**53 where it runs in doubles.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np

#: Bytes of JPEG frames that are decoded together.
TOGETHER = 1 << 19

#: Row-major place of each coefficient in coding order.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))

_SCALE = 1 << 20
_MARKER = re.compile(rb"\xff+([\x01-\xcf\xd8-\xfe])")
_END = 100  # coefficients that an end-of-block symbol moves on; more than any run
_MASK = (1 << np.arange(16)) - 1


class Picture(NamedTuple):
    coefficients: np.ndarray  # quantised, a row per block in coding (zigzag) order; component after component
    planes: list[np.ndarray]  # 8-bit samples of each component


def _inverse() -> np.ndarray:
    """Coefficients in zigzag order times this are 64 samples, row by row, times _SCALE."""
    u, x = np.arange(8)[:, None], np.arange(8)
    wave = np.cos((2 * x + 1) * u * np.pi / 16) / 2
    wave[0] /= np.sqrt(2)
    return np.rint(np.einsum("uy,vx->uvyx", wave, wave).reshape(64, 64)[ZIGZAG] * _SCALE)


_IDCT = _inverse()


# -- tables --------------------------------------------------------------------------------------


def _annex_k() -> dict[tuple[int, int], bytes]:
    light = "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a"
    light += "3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a"
    light += "92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
    hue = "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a"
    hue += "35363738393a434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a"
    hue += "92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"
    sizes = bytes(range(12))
    return {
        (0, 0): bytes.fromhex("00010501010101010100000000000000") + sizes,
        (0, 1): bytes.fromhex("00030101010101010101010000000000") + sizes,
        (1, 0): bytes.fromhex("0002010303020403050504040000017d" + light),
        (1, 1): bytes.fromhex("00020102040403040705040400010277" + hue),
    }


#: (0 for DC or 1 for AC, table number): 16 counts of codes by length, then symbols.
ANNEX_K = _annex_k()


@lru_cache(64)
def _lookup(ac: int, table: bytes) -> np.ndarray:
    """By the next 16 bits: bits of the code and its value, | bits of the value << 5, | coefficients
    that it moves on << 9; 0 where no code begins so."""
    found, code, at = np.zeros(1 << 16, np.uint16), 0, 16
    for length, n in enumerate(table[:16], 1):
        for symbol in table[at : at + n]:
            run, size = symbol >> 4, symbol & 15
            if code >> length or (run and not ac) or (ac and not size and run not in (0, 15)):
                raise ValueError("not a Huffman table of a sequential JPEG")
            found[code << 16 - length : code + 1 << 16 - length] = length + size | size << 5 | (_END if ac and not symbol else run + 1) << 9
            code += 1
        at, code = at + n, code << 1
    return found


# -- headers -------------------------------------------------------------------------------------


class _Scan(NamedTuple):
    order: np.ndarray  # row among the frame's coefficients of each coded block
    part: np.ndarray  # its component's place in the scan
    dc: list[bytes]  # tables by place in the scan
    ac: list[bytes]
    first: np.ndarray  # by restart interval: its first block
    count: np.ndarray  # and how many it has


class _Component(NamedTuple):
    first: int  # row of its first block
    rows: int  # of blocks, with those that fill the last unit
    columns: int
    height: int  # of samples
    width: int


class _Layout(NamedTuple):
    blocks: int
    components: list[_Component]
    scans: list[_Scan]
    quantisers: list[bytes]  # by component: 64 numbers of 16 bits


def _split(jpeg: bytes) -> tuple[tuple[bytes, ...], list[bytes]]:
    """The segments before each scan's data, and the data of each scan."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    heads, data, at, start = [], [], 2, 2
    while True:
        m = _MARKER.match(jpeg, at)
        if not m:
            raise ValueError("a JPEG frame without its end")
        mark, at = m[1][0], m.end()
        if mark == 0xD9:
            break
        at += int.from_bytes(jpeg[at : at + 2], "big")
        if mark == 0xDA:
            m = _MARKER.search(jpeg, at)
            if not m:
                raise ValueError("a JPEG frame without its end")
            heads.append(jpeg[start:at])
            data.append(jpeg[at : m.start()])
            at = start = m.start()
    if b"\xff\xd8\xff" in jpeg[at:]:
        raise ValueError("a frame of two fields")
    return tuple(heads), data


@lru_cache(64)
def _layout(heads: tuple[bytes, ...]) -> _Layout:
    try:
        return _read_heads(heads)
    except (IndexError, KeyError, TypeError, struct.error, ZeroDivisionError) as e:
        raise ValueError("broken JPEG headers") from e


def _read_heads(heads: tuple[bytes, ...]) -> _Layout:
    tables, quantisers, restart, blocks = dict(ANNEX_K), {}, 0, 0
    components, used, scans = {}, {}, []
    for head in heads:
        at = 0
        while at < len(head):
            at = _MARKER.match(head, at).end()
            mark, size = head[at - 1], int.from_bytes(head[at : at + 2], "big")
            body, at = head[at + 2 : at + size], at + size
            if mark == 0xDB:
                while body:
                    n = 64 << (body[0] >> 4)
                    quantisers[body[0] & 15] = struct.pack("=64H", *struct.unpack(">64H" if n == 128 else ">64B", body[1 : 1 + n]))
                    body = body[1 + n :]
            elif mark == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    tables[body[0] >> 4, body[0] & 15] = body[1:n]
                    body = body[n:]
            elif mark == 0xDD:
                restart = int.from_bytes(body, "big")
            elif mark in (0xC0, 0xC1):
                precision, height, width, n = struct.unpack(">BHHB", body[:6])
                given = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * n, 3)]
                if precision != 8 or not height or not width or components:
                    raise ValueError("not one frame of 8-bit samples whose size is in its header")
                across, down = max(g[1] for g in given), max(g[2] for g in given)
                units_x, units_y = -(-width // (8 * across)), -(-height // (8 * down))
                for c, h, v, q in given:
                    components[c] = _Component(blocks, units_y * v, units_x * h, -(-height * v // down), -(-width * h // across)), h, v, q
                    blocks += units_y * v * units_x * h
            elif 0xC2 <= mark <= 0xCF:
                raise ValueError("not a sequential Huffman-coded JPEG")
            elif mark == 0xDA:
                n = body[0]
                if n > 4 or body[1 + 2 * n : 4 + 2 * n] != b"\0\x3f\0":
                    raise ValueError("not a sequential scan")
                chosen = [(body[i], body[i + 1] >> 4, body[i + 1] & 15) for i in range(1, 1 + 2 * n, 2)]
                grids = []
                for c, _, _ in chosen:
                    p, h, v, q = components[c]
                    used[c] = quantisers[q]
                    grid = p.first + np.arange(p.rows * p.columns).reshape(p.rows, p.columns)
                    if n == 1:  # without the blocks that fill units
                        grids.append(grid[: -(-p.height // 8), : -(-p.width // 8)].reshape(-1, 1))
                    else:
                        grids.append(grid.reshape(units_y, v, units_x, h).transpose(0, 2, 1, 3).reshape(-1, v * h))
                order = np.concatenate(grids, axis=1)
                part = np.broadcast_to(np.repeat(np.arange(n), [g.shape[1] for g in grids]), order.shape)
                first = np.arange(0, len(order), restart or len(order)) * order.shape[1]
                scans.append(_Scan(order.ravel(), part.ravel(), [tables[0, d] for _, d, _ in chosen], [tables[1, a] for _, _, a in chosen], first, np.diff(np.append(first, order.size))))
    if not components or used.keys() != components.keys():
        raise ValueError("a component without a scan")
    return _Layout(blocks, [c[0] for c in components.values()], scans, [used[c] for c in components])


# -- decoding ------------------------------------------------------------------------------------


def _intervals(data: list[bytes], wanted: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The data without stuffed bytes and markers, and the first and last place of each interval."""
    raw = np.frombuffer(b"".join(x for d in data for x in (d, b"\xff\xd9")), np.uint8)
    ff = np.flatnonzero(raw == 0xFF)
    after = raw[ff + 1]
    marks = ff[(after != 0) & (after != 0xFF)]
    ends = np.cumsum(wanted)
    expected = 0xD0 + (np.arange(ends[-1]) - np.repeat(ends - wanted, wanted)) % 8
    expected[ends - 1] = 0xD9
    if not np.array_equal(raw[marks + 1], expected):
        raise ValueError("restart markers are missing or out of order")
    drop = np.sort(np.concatenate([ff[after == 0xFF], ff[after == 0] + 1, marks, marks + 1]))
    keep = np.ones(len(raw), bool)
    keep[drop] = False
    stops = marks - np.searchsorted(drop, marks)
    return raw[keep], np.append(0, stops[:-1]), stops


def _symbols(window: np.ndarray, codes: np.ndarray, bit: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The next symbol at each `bit`: its value, coefficients moved on, and the bit after it."""
    off, ahead = bit & 7, window[bit >> 3]
    found = codes[table + (ahead >> 24 - off & 0xFFFF)].astype(np.int64)
    if not found.all():
        raise ValueError("bits that are no code")
    used, mask = found & 31, _MASK[found >> 5 & 15]
    value = ahead >> 40 - off - used & mask
    value -= mask * (2 * value <= mask)
    return value, found >> 9, bit + used


def _coefficients(split: list[tuple[tuple[bytes, ...], list[bytes]]], layouts: list[_Layout]) -> np.ndarray:
    """Quantised coefficients of the frames' blocks, in zigzag order."""
    number, scans, done = {}, [], 0
    for (_, data), f in zip(split, layouts, strict=True):
        if len(data) != len(f.scans):
            raise ValueError("a scan without data")
        scans += [(s, d, done) for s, d in zip(f.scans, data, strict=True)]
        done += f.blocks
    placed = {}
    for s, _, _ in scans:
        if id(s) not in placed:
            placed[id(s)] = [np.array([number.setdefault((i, t), len(number)) << 16 for t in ts])[s.part] for i, ts in enumerate((s.dc, s.ac))]
    codes = np.concatenate([_lookup(*k) for k in number])
    order = np.concatenate([s.order + base for s, _, base in scans])
    part = np.concatenate([s.part for s, _, _ in scans])
    dc, ac = (np.concatenate([placed[id(s)][i] for s, _, _ in scans]) for i in (0, 1))
    before = np.cumsum([0, *(len(s.order) for s, _, _ in scans)])
    first = np.concatenate([s.first + b for (s, _, _), b in zip(scans, before[:-1].tolist(), strict=True)])
    count = np.concatenate([s.count for s, _, _ in scans])
    clean, starts, stops = _intervals([d for _, d, _ in scans], [len(s.first) for s, _, _ in scans])
    padded = np.concatenate([clean, np.full(512, 0xFF, np.uint8)])
    window = np.ndarray((len(clean) + 500,), ">i8", padded, strides=(1,)).astype(np.int64) >> 24 & (1 << 40) - 1

    out = np.zeros(done * 64, np.int32)
    at, last = starts * 8, np.zeros((len(first), 4), np.int64)
    for j in range(int(count.max())):
        live = np.flatnonzero(count > j)
        block = first[live] + j
        row, table = order[block] * 64, ac[block]
        value, k, bit = _symbols(window, codes, at[live], dc[block])
        last[live, part[block]] += value
        out[row] = last[live, part[block]]
        while len(live):
            value, move, bit = _symbols(window, codes, bit, table)
            k = k + move
            out[row + np.minimum(k, 64) - 1] = value  # a block's end writes 0 where nothing was
            over = k >= 64
            if over.any():
                if ((k > 64) & (k < _END)).any() or (bit[over] > 8 * stops[live[over]]).any():
                    raise ValueError("a block beyond its 64 coefficients or its data")
                at[live[over]] = bit[over]
                left = np.flatnonzero(~over)
                live, row, table, k, bit = live[left], row[left], table[left], k[left], bit[left]
    return out.reshape(-1, 64)


def _samples(values: np.ndarray) -> np.ndarray:
    """8-bit samples of dequantised blocks, by the inverse DCT."""
    found = values @ _IDCT
    found *= 1 / _SCALE
    found += 128.5
    return np.clip(found, 0, 255, out=found).astype(np.uint8)


def _pictures(jpegs: list[bytes]) -> Iterator[Picture]:
    split = [_split(j) for j in jpegs]
    layouts = [_layout(heads) for heads, _ in split]
    coefficients = _coefficients(split, layouts)
    number, kind, blocks = {}, [], []
    for f in layouts:
        kind += [number.setdefault(q, len(number)) for q in f.quantisers]
        blocks += [c.rows * c.columns for c in f.components]
    kind = np.repeat(kind, blocks)
    samples = np.empty(coefficients.shape, np.uint8)
    for i, q in enumerate(number):
        rows = np.flatnonzero(kind == i) if len(number) > 1 else slice(None)
        samples[rows] = _samples(np.multiply(coefficients[rows], np.frombuffer(q, np.uint16), dtype=np.float64))
    done = 0
    for f in layouts:
        planes = []
        for c in f.components:
            blocks = samples[done + c.first : done + c.first + c.rows * c.columns].reshape(c.rows, c.columns, 8, 8)
            planes.append(blocks.transpose(0, 2, 1, 3).reshape(8 * c.rows, 8 * c.columns)[: c.height, : c.width])
        yield Picture(coefficients[done : done + f.blocks], planes)
        done += f.blocks


def pictures(jpegs: Iterable[bytes]) -> Iterator[Picture]:
    """The decoded frames, in order."""
    some, size = [], 0
    for j in jpegs:
        some.append(j)
        size += len(j)
        if size >= TOGETHER:
            yield from _pictures(some)
            some, size = [], 0
    if some:
        yield from _pictures(some)
