"""AVI motion-JPEG media columns: write, index, decode, and cut into shots.

A payload is stored as the quantised coefficients of baseline JPEG frames, which are lossless where
pixels are not: a byte b below 128 is the coefficient b - 128, any other b - 127, so none is zero. A
coefficient of s bits has a Huffman code of 9 - s bits, which makes every coefficient 9 bits, and with
a restart marker after each block every block is 64 coefficients in exactly 72 bytes, before zeros are
stuffed behind bytes 0xFF. Frames are 24 pixels wide (three blocks, 192 bytes) and up to `ROWS` block
rows high; the last frame has the rows that are left.
The file has the RIFF lists of an AVI with an `idx1` index, by which frames are found.

Frames are read by `jpeg.py`, which decodes any baseline JPEG: Huffman codes to quantised coefficients,
from which the payload comes back, then dequantisation and inverse DCT to pixels, from which histograms
come. The pixels of our frames are the inverse DCT of text, which looks like noise.

Shots: a frame starts a new one when the L1 distance of its 16-bin pixel histogram from the frame
before exceeds both a floor and the mean plus twice the deviation of the last distances within the shot.

Null text counts as empty; an empty text is one block row of spaces, and so one clip.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, spread
from .jpeg import TOGETHER, Picture, pictures

UNIT, ROWS, FPS = 192, 16, 25
_BINS, _MEMORY, _FLOOR = 16, 8, 0.35


def pad(data: bytes) -> bytes:
    """`data` with spaces up to a positive multiple of UNIT bytes."""
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b" ")


# -- JPEG frames ---------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(rows: int) -> bytes:
    table = bytes([1] * 8 + [0] * 8 + [8, 7, 6, 5, 4, 3, 2, 1])  # codes 0, 10, 110, ...
    return b"".join([
        b"\xff\xd8",
        _segment(0xDB, b"\0" + b"\1" * 64),
        _segment(0xC0, struct.pack(">BHHB3B", 8, 8 * rows, 24, 1, 1, 0x11, 0)),
        _segment(0xC4, b"\x00" + table),
        _segment(0xC4, b"\x10" + table),
        _segment(0xDD, struct.pack(">H", 1)),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ])


_HEADS = [_head(r) for r in range(ROWS + 1)]


def _unit(byte: int) -> int:
    """The 9 bits of a byte's coefficient: Huffman code, then the value."""
    value = byte - 128 if byte < 128 else byte - 127
    size = abs(value).bit_length()
    code = (1 << 9 - size) - 2
    return code << size | (value if value > 0 else value + (1 << size) - 1)


_UNITS = np.array([_unit(b) for b in range(256)], np.uint16)


def _pack(samples: np.ndarray) -> np.ndarray:
    """Blocks of 64 samples as 72 bytes: eight units of 9 bits in nine bytes."""
    units = _UNITS[samples].reshape(-1, 8)
    out = np.empty((len(units), 9), np.uint8)
    out[:, 0] = units[:, 0] >> 1
    for i in range(1, 8):
        out[:, i] = (units[:, i - 1] & (1 << i) - 1) << 8 - i | units[:, i] >> i + 1
    out[:, 8] = units[:, 7] & 0xFF
    return out.reshape(-1, 72)


def _encode_frame(samples: np.ndarray) -> bytes:
    blocks = _pack(samples)
    n = len(blocks)
    with_marks = np.empty((n, 74), np.uint8)
    with_marks[:, :72] = blocks
    with_marks[:, 72] = 0xFF
    with_marks[:, 73] = 0xD0 + np.arange(n) % 8
    stuffed = with_marks == 0xFF
    stuffed[:, 72] = False
    data = np.insert(with_marks.reshape(-1), np.flatnonzero(stuffed) + 1, 0)
    return _HEADS[n // 3] + data[:-2].tobytes() + b"\xff\xd9"


def _payload(coefficients: np.ndarray) -> np.ndarray:
    """The bytes that a frame's quantised coefficients hold."""
    if not coefficients.all() or np.abs(coefficients).max() > 128:
        raise ValueError("a coefficient that holds no byte")
    return (coefficients + 128 - (coefficients > 0)).astype(np.uint8).reshape(-1)


# -- AVI -----------------------------------------------------------------------------------------


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def encode(payload: bytes) -> bytes:
    """An AVI file whose frames hold `payload` (a positive multiple of UNIT bytes)."""
    samples = np.frombuffer(payload, np.uint8)
    return file_of([_encode_frame(samples[i : i + UNIT * ROWS]) for i in range(0, len(samples), UNIT * ROWS)], 24, 8 * min(ROWS, len(samples) // UNIT))


def file_of(frames: list[bytes], width: int, height: int) -> bytes:
    """An AVI file of JPEG frames, with its index."""
    n, largest = len(frames), max(map(len, frames))
    chunks = [_chunk(b"00dc", f) for f in frames]
    places = np.cumsum([4, *map(len, chunks)])[:-1]
    index = b"".join(struct.pack("<4sIII", b"00dc", 0x10, p, len(f)) for p, f in zip(places.tolist(), frames, strict=True))
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, n, 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", largest, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    return _chunk(b"RIFF", b"AVI " + hdrl + _chunk(b"LIST", b"movi" + b"".join(chunks)) + _chunk(b"idx1", index))


def read_index(avi: bytes) -> tuple[int, list[tuple[int, int]]]:
    """Microseconds per frame, and (place, size) of each frame by the file's idx1."""
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, end, movi, period, index = 12, 8 + int.from_bytes(avi[4:8], "little"), None, 0, b""
    while at + 8 <= end:
        kind, size = avi[at : at + 4], int.from_bytes(avi[at + 4 : at + 8], "little")
        if kind == b"LIST" and avi[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif kind == b"LIST" and avi[at + 12 : at + 16] == b"avih":
            period = int.from_bytes(avi[at + 20 : at + 24], "little")
        elif kind == b"idx1":
            index = avi[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if movi is None or not index:
        raise ValueError("no movi list or index")
    return period, [(movi + p + 8, size) for kind, _, p, size in struct.iter_unpack("<4sIII", index) if kind[2:] == b"dc"]


def _jpegs(avi: bytes) -> list[bytes]:
    return [avi[place : place + size] for place, size in read_index(avi)[1]]


def frames(avi: bytes) -> Iterator[np.ndarray]:
    """The pixels of each frame: its grey plane, or luma."""
    for p in pictures(_jpegs(avi)):
        yield p.planes[0]


def decode(avi: bytes) -> bytes:
    """The payload of a file that `encode` made."""
    return b"".join(_payload(p.coefficients).tobytes() for p in pictures(_jpegs(avi)))


def _counts(frame: np.ndarray) -> np.ndarray:
    """Pixels of a frame by bin."""
    return np.bincount((frame >> 4).reshape(-1), minlength=_BINS)


def shots(decoded: Iterable[np.ndarray], period: int) -> list[dict]:
    """Timed clips of the decoded frames, in order; they cover all frames."""
    return _clips(np.stack([_counts(f) / f.size for f in decoded]), period)


def _clips(hist: np.ndarray, period: int) -> list[dict]:
    far = np.abs(np.diff(hist, axis=0)).sum(1).tolist()
    cuts, recent = [0], []
    for i, x in enumerate(far, 1):
        if recent and x > max(_FLOOR, float(np.mean(recent) + 2 * np.std(recent))):
            cuts.append(i)
            recent = []
        else:
            recent = [*recent[1 - _MEMORY :], x]
    return [
        {"first": a, "frames": b - a, "start_ms": a * period // 1000, "end_ms": b * period // 1000, "histogram": np.round(hist[a:b].mean(0) * 255).astype(int).tolist()}
        for a, b in zip(cuts, [*cuts[1:], len(hist)], strict=True)
    ]


def clip_rows(media: DataFrame, key: str, column: str) -> DataFrame:
    """One row per clip of an AVI column: key, clip, first, frames, start_ms, end_ms, histogram."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, avi in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if avi:
                    rows += [{"key": k, "clip": i, **c} for i, c in enumerate(shots(frames(avi), read_index(avi)[0]))]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("key", pa.int64()), ("clip", pa.int32()), ("first", pa.int32()), ("frames", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("histogram", pa.list_(pa.int32()))])
    return media.selectExpr(f"cast({key} as long) key", column).mapInArrow(per_batch, f"key long, clip int, first int, frames int, start_ms long, end_ms long, histogram array<int>").withColumnRenamed("key", key)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _groups(texts: pa.Array) -> Iterator[list[bytes]]:
    """The UTF-8 texts in order, as many together as jpeg.TOGETHER bytes hold, one at least."""
    group, size = [], 0
    for t in texts:
        data = (t.as_py() or "").encode()
        if group and size + len(data) > TOGETHER:
            yield group
            group, size = [], 0
        group.append(data)
        size += max(len(data), UNIT)
    if group:
        yield group


def _describe(data: bytes, avi: bytes, period: int, read: Iterator[Picture]) -> tuple:
    """The digest columns of a text from its file and the pictures read from it."""
    sha, n, tail, counts = hashlib.sha256(), 0, b"", []
    for p in read:
        back = _payload(p.coefficients)
        sha.update(back)
        n, tail = n + len(back), back[-16:].tobytes()
        counts.append(_counts(p.planes[0]))
    counts = np.stack(counts)
    pixels = counts.sum(1, keepdims=True)
    clips = _clips(counts / pixels, period)
    mean = np.round(counts.sum(0) * 255 / pixels.sum()).astype(np.uint8)
    feature = f"{len(counts)} frames, clips " + " ".join(f"{c['start_ms']}-{c['end_ms']}" for c in clips) + ", histogram " + mean.tobytes().hex()
    return len(data), n, sha.hexdigest(), zlib.crc32(tail), len(avi), hashlib.sha256(avi).hexdigest(), feature


def digests(docs: DataFrame) -> DataFrame:
    """Store each text as an AVI, read it back, and describe both."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for group in _groups(b.column(1)):
                files = [encode(pad(data)) for data in group]
                indexes = [read_index(f) for f in files]
                read = pictures(f[place : place + size] for f, (_, index) in zip(files, indexes, strict=True) for place, size in index)
                rows += [_describe(data, f, period, islice(read, len(index))) for data, f, (period, index) in zip(group, files, indexes, strict=True)]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(_SCHEMA)[1:], strict=True))], schema=_SCHEMA)

    return spread(docs.selectExpr("cast(doc_id as long) doc_id", "text")).mapInArrow(per_batch, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op5_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
