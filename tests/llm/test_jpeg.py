from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from redpen.llm import avi, jpeg
from tests.llm.helpers import ODD, documents

# -- a plain writer and a plain reader, both bit by bit and by the definitions --------------------

ZIGZAG, (y, x), up = [], (0, 0), True
while len(ZIGZAG) < 64:
    ZIGZAG.append(8 * y + x)
    if up:
        y, x, up = (y + 1, x, False) if x == 7 else (0, x + 1, False) if y == 0 else (y - 1, x + 1, True)
    else:
        y, x, up = (y, x + 1, True) if y == 7 else (y + 1, 0, True) if x == 0 else (y + 1, x - 1, False)


def codes(table):
    found, code, at = {}, 0, 16
    for length in range(1, 17):
        for symbol in table[at : at + table[length - 1]]:
            found[symbol] = f"{code:0{length}b}"
            code += 1
        at += table[length - 1]
        code *= 2
    return found


def coded(value, size):
    return f"{value if value > 0 else value + 2**size - 1:0{size}b}" if size else ""


def block_bits(values, before, dc, ac):
    diff = values[0] - before
    size = abs(diff).bit_length()
    out, run = dc[size] + coded(diff, size), 0
    for v in values[1:]:
        if v == 0:
            run += 1
            continue
        out += ac[0xF0] * (run // 16)
        size = abs(v).bit_length()
        out += ac[run % 16 << 4 | size] + coded(v, size)
        run = 0
    return out + (ac[0] if run else "")


def segment(mark, body):
    return bytes([0xFF, mark]) + (len(body) + 2).to_bytes(2, "big") + bytes(body)


def write(width, height, parts, quantisers, restart=0, together=True, tables=True):
    """parts: (h, v, number of its quantiser and of its tables, blocks[rows][columns][64])."""
    out = b"\xff\xd8" + segment(0xE0, b"AVI1\0") + b"".join(segment(0xDB, bytes([i, *q])) for i, q in enumerate(quantisers))
    out += segment(0xC0, [8, *height.to_bytes(2, "big"), *width.to_bytes(2, "big"), len(parts), *(x for i, (h, v, q, _) in enumerate(parts) for x in (i + 1, h << 4 | v, q))])
    if tables:
        out += b"".join(segment(0xC4, bytes([c << 4 | i]) + t) for (c, i), t in jpeg.ANNEX_K.items())
    if restart:
        out += segment(0xDD, restart.to_bytes(2, "big"))
    across, down = max(p[0] for p in parts), max(p[1] for p in parts)
    for scan in [range(len(parts))] if together else [[i] for i in range(len(parts))]:
        out += segment(0xDA, [len(scan), *(x for i in scan for x in (i + 1, parts[i][2] * 0x11)), 0, 63, 0])
        if len(scan) == 1:
            h, v, _, blocks = parts[scan[0]]
            rows, columns = (math.ceil(math.ceil(n * a / b) / 8) for n, a, b in ((height, v, down), (width, h, across)))
            units = [[(scan[0], r, c)] for r in range(rows) for c in range(columns)]
        else:
            units = [
                [(i, uy * parts[i][1] + r, ux * parts[i][0] + c) for i in scan for r in range(parts[i][1]) for c in range(parts[i][0])]
                for uy in range(math.ceil(height / 8 / down))
                for ux in range(math.ceil(width / 8 / across))
            ]
        step = restart or len(units)
        for k, start in enumerate(range(0, len(units), step)):
            bits, before = "", dict.fromkeys(scan, 0)
            for i, r, c in (b for u in units[start : start + step] for b in u):
                _, _, q, blocks = parts[i]
                bits += block_bits(blocks[r][c], before[i], codes(jpeg.ANNEX_K[0, q]), codes(jpeg.ANNEX_K[1, q]))
                before[i] = blocks[r][c][0]
            bits += "1" * (-len(bits) % 8)
            data = bytes(int(bits[b : b + 8], 2) for b in range(0, len(bits), 8))
            out += (bytes([0xFF, 0xD0 + (k - 1) % 8]) if k else b"") + data.replace(b"\xff", b"\xff\0")
    return out + b"\xff\xd9"


def plain_pixels(values, quantiser):
    """The inverse DCT of a zigzag block by its definition, before it is rounded."""
    grid = np.zeros((8, 8))
    for place, v, q in zip(ZIGZAG, values, quantiser, strict=True):
        grid[place // 8, place % 8] = int(v) * q
    wave = np.array([[(math.sqrt(0.5) if u == 0 else 1) / 2 * math.cos((2 * i + 1) * u * math.pi / 16) for u in range(8)] for i in range(8)])
    return np.clip(wave @ grid @ wave.T + 128, 0, 255)


def plain_blocks(data):
    """Coefficients of a grey frame with a restart marker behind each block."""
    tables, at = {}, 2
    while True:
        mark, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xC4:
            tables[body[0] >> 4] = {c: s for s, c in codes(body[1:]).items()}
        if mark == 0xDA:
            break
    parts, i = [b""], at
    while data[i : i + 2] != b"\xff\xd9":
        if data[i] == 0xFF and data[i + 1]:
            parts.append(b"")
            i += 2
        else:
            parts[-1] += data[i : i + 1]
            i += 2 if data[i] == 0xFF else 1
    blocks = []
    for p in parts:
        bits, values, i = "".join(f"{b:08b}" for b in p), [], 0
        while len(values) < 64:
            table, n = tables[min(len(values), 1)], 1
            while bits[i : i + n] not in table:
                n += 1
            symbol = table[bits[i : i + n]]
            run, size = symbol >> 4, symbol & 15
            v, i = bits[i + n : i + n + size], i + n + size
            values += [0] * run + [int(v, 2) if v[0] == "1" else int(v, 2) - 2**size + 1]
        blocks.append(values)
    return blocks


# -- tests ---------------------------------------------------------------------------------------


def made(seed, width, height, samplings, **how):
    random.seed(seed)
    across, down = max(h for h, _ in samplings), max(v for _, v in samplings)
    quantisers = [[random.randint(1, 60) for _ in range(64)] for _ in range(2)]
    parts = []
    for i, (h, v) in enumerate(samplings):
        rows, columns = math.ceil(height / 8 / down) * v, math.ceil(width / 8 / across) * h
        shares = [[random.choice((0, 0.03, 0.3, 1)) for _ in range(columns)] for _ in range(rows)]
        blocks = [[[random.randint(-300, 300) // (1 + k // 4) if random.random() < share else 0 for k in range(64)] for share in line] for line in shares]
        parts.append((h, v, min(i, 1), blocks))
    return write(width, height, parts, quantisers, **how), parts, quantisers


CASES = [
    (1, 17, 35, [(1, 1)], {}),
    (2, 40, 24, [(2, 2)], {"restart": 1}),
    (3, 50, 37, [(2, 2), (1, 1), (1, 1)], {}),
    (4, 33, 70, [(2, 2), (1, 1), (1, 1)], {"restart": 2, "tables": False}),
    (5, 41, 19, [(2, 1), (1, 1), (1, 1)], {"together": False, "restart": 3}),
    (6, 9, 90, [(1, 2), (1, 1), (1, 1), (1, 2)], {"restart": 5}),
]


def check(picture, case, parts, quantisers):
    _, width, height, samplings, how = case
    across, down = max(h for h, _ in samplings), max(v for _, v in samplings)
    done = 0
    for plane, (h, v, q, blocks) in zip(picture.planes, parts, strict=True):
        inside = [math.ceil(height * v / down), math.ceil(width * h / across)]
        assert list(plane.shape) == inside
        alone = not how.get("together", True) or len(parts) == 1
        for r, line in enumerate(blocks):
            for c, b in enumerate(line):
                if not alone or (8 * r < inside[0] and 8 * c < inside[1]):
                    assert picture.coefficients[done].tolist() == b
                found = plane[8 * r : 8 * r + 8, 8 * c : 8 * c + 8]
                assert (np.abs(found - plain_pixels(b, quantisers[q])[: found.shape[0], : found.shape[1]]) < 0.501).all()
                done += 1
    assert done == len(picture.coefficients)


def test_any_baseline_frame_in_one_file(monkeypatch):
    """Grey and coloured, sampled, interleaved or not, with and without restarts and tables."""
    frames = [made(*c[:4], **c[4]) for c in CASES]
    file = avi.file_of([f[0] for f in frames], 64, 96)
    for together in (1, 3000, 1 << 20):
        monkeypatch.setattr(jpeg, "TOGETHER", together)
        read = list(jpeg.pictures(f[0] for f in frames))
        for p, c, (_, parts, quantisers) in zip(read, CASES, frames, strict=True):
            check(p, c, parts, quantisers)
        assert all((a == p.planes[0]).all() for a, p in zip(avi.frames(file), read, strict=True))
    with pytest.raises(ValueError):
        avi.decode(file)  # they hold no payload


def test_tables_of_annex_k():
    for (kind, _), t in jpeg.ANNEX_K.items():
        assert len(t) == 16 + sum(t[:16]) and sorted(t[16:]) == (sorted([0, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 11))]) if kind else list(range(12)))


def test_other_frames_raise():
    good = made(*CASES[2][:4])[0]
    sof = good.index(b"\xff\xc0")
    for bad in (good[: sof + 1] + b"\xc2" + good[sof + 2 :], good[:-2], good[:-9] + good[-2:], good[: sof + 4] + b"\x0c" + good[sof + 5 :], good[: sof + 5] + b"\0\0" + good[sof + 7 :], good + good, good[1:], b""):
        with pytest.raises(ValueError):
            list(jpeg.pictures([bad]))
    frames = [made(*c[:4], **c[4])[0] for c in CASES]
    random.seed(8)
    for _ in range(600):  # broken bytes raise nothing else
        spoilt = bytearray(random.choice(frames))
        for _ in range(random.randint(1, 3)):
            spoilt[random.randrange(len(spoilt))] = random.randrange(256)
        try:
            list(jpeg.pictures([bytes(spoilt)]))
        except ValueError:
            continue


def plain_feature(text):
    """The digest columns' feature by the plain reader."""
    media = avi.encode(avi.pad(text.encode()))
    period, index = avi.read_index(media)
    payload, hists = b"", []
    for place, size in index:
        blocks = plain_blocks(media[place : place + size])
        payload += bytes(v + 128 if v < 0 else v + 127 for b in blocks for v in b)
        pixels = np.floor(np.array([plain_pixels(b, [1] * 64) for b in blocks]) + 0.5).astype(int)
        hists.append(np.bincount(pixels.ravel() // 16, minlength=16))
    assert payload == avi.pad(text.encode())
    shares = [h / h.sum() for h in hists]
    cuts, recent = [0], []
    for i in range(1, len(shares)):
        d = np.abs(shares[i] - shares[i - 1]).sum()
        if recent and d > max(0.35, np.mean(recent) + 2 * np.std(recent)):
            cuts.append(i)
            recent = []
        else:
            recent = [*recent, d][-8:]
    times = [c * period // 1000 for c in [*cuts, len(shares)]]
    mean = bytes(np.round(sum(hists) * 255 / sum(h.sum() for h in hists)).astype(int).tolist())
    return f"{len(hists)} frames, clips " + " ".join(f"{a}-{b}" for a, b in zip(times, times[1:])) + ", histogram " + mean.hex()  # noqa: B905


def test_features_come_from_pixels(spark):
    rows = [*((i, t) for i, t in ODD if t is None or len(t) < 1000), (9, "ab\x7f~}|z ÿÿ" * 700), (10, "one word after the other " * 400 + "中文字" * 3000 + "!" * 7000)]
    found = {r.doc_id: r for r in avi.digests(documents(spark, rows)).collect()}
    for i, t in rows:
        assert found[i].feature == plain_feature(t or "")
        assert found[i].payload_sha256 == hashlib.sha256(avi.pad((t or "").encode())).hexdigest()
    assert " " in found[10].feature.split("clips ")[1].split(",")[0]  # more than one clip


def test_copies_agree_wherever_they_stand(spark):
    rows = [(i, "a copy of a text, " * 300 if i % 3 == 0 else "x" * (i * 37 % 5000)) for i in range(120)]
    found = {r.feature for r in avi.digests(documents(spark, rows)).collect() if r.doc_id % 3 == 0}
    assert len(found) == 1
