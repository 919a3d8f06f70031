"""The JPEG reader against a plain one, and the payload round trip."""

import hashlib
import struct
import zlib

import numpy as np
import pytest

from tacgrid.llm import media as M


def huffman(spec):
    """Codes by symbol, of 16 counts and symbols."""
    code, at, out = 0, 16, {}
    for length in range(1, 17):
        for _ in range(spec[length - 1]):
            out[spec[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return out


# Two of the standard's tables are long; these are short ones of our own that cover the symbols used below.
DC = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1] + [0] * 7) + bytes(range(12))
SYMBOLS = bytes([0x00, 0x01, 0x02, 0x11, 0x03, 0xF0, 0x21, 0x12, 0x31, 0x41, 0x04, 0x51, 0x05])
AC = bytes([0, 2, 1, 2, 1, 3, 2, 2, 0, 0, 0, 0, 0, 0, 0, 0]) + SYMBOLS


class Bits:
    def __init__(self):
        self.text = ""

    def put(self, value, n):
        self.text += f"{value:0{n}b}" if n else ""

    def bytes(self):
        padded = self.text + "1" * (-len(self.text) % 8)
        return bytes(int(padded[i : i + 8], 2) for i in range(0, len(padded), 8)).replace(b"\xff", b"\xff\x00")


def magnitude(v):
    n = abs(v).bit_length()
    return n, (v if v >= 0 else v + (1 << n) - 1)


def encode(dcs, acs, across, sampling, width, height, step, interval=0):
    """A JPEG of given coefficients. dcs, acs: by MCU, lists by block in scan order; sampling: (h, v) of each component."""
    dc_codes, ac_codes = huffman(DC), huffman(AC)
    parts, bits, before = [], Bits(), [0] * len(sampling)
    owners = [c for c, (h, v) in enumerate(sampling) for _ in range(h * v)]
    for m, (own_dc, own_ac) in enumerate(zip(dcs, acs, strict=True)):
        if interval and m and m % interval == 0:
            parts.append(bits.bytes())
            bits, before = Bits(), [0] * len(sampling)
        for c, d, a in zip(owners, own_dc, own_ac, strict=True):
            n, extra = magnitude(d - before[c])
            before[c] = d
            bits.put(*dc_codes[n])
            bits.put(extra, n)
            for run, v in a:
                if v is None:
                    bits.put(*ac_codes[0xF0])
                    continue
                n, extra = magnitude(v)
                bits.put(*ac_codes[run << 4 | n])
                bits.put(extra, n)
            bits.put(*ac_codes[0])
    parts.append(bits.bytes())
    body = parts[0]
    for k, p in enumerate(parts[1:]):
        body += bytes([0xFF, 0xD0 + k % 8]) + p
    comps = b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(sampling))
    seg = lambda marker, data: struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data
    return b"".join(
        [
            b"\xff\xd8",
            seg(0xFE, b"a comment \xff\xd9"),
            seg(0xDB, bytes([0, step] + [3] * 63)),
            seg(0xC0, struct.pack(">BHHB", 8, height, width, len(sampling)) + comps),
            seg(0xC4, b"\x00" + DC),
            seg(0xC4, b"\x10" + AC),
            seg(0xDD, struct.pack(">H", interval)) if interval else b"",
            seg(0xDA, bytes([len(sampling)]) + b"".join(bytes([c + 1, 0]) for c in range(len(sampling))) + b"\0\x3f\0"),
            body,
            b"\xff\xd9",
        ]
    )


def picture(seed, sampling, across, down, step=5, interval=0):
    rng = np.random.default_rng(seed)
    blocks = sum(h * v for h, v in sampling)
    dcs = [[int(x) for x in rng.integers(-120, 120, blocks)] for _ in range(across * down)]
    choices = [[], [(0, 1), (1, -1)], [(3, 1), (0, -3)], [(0, None), (2, 1)], [(5, -1), (0, 16)], [(4, 1), (0, None), (0, 2)]]
    acs = [[choices[int(k)] for k in rng.integers(0, len(choices), blocks)] for _ in range(across * down)]
    hmax, vmax = (max(s[k] for s in sampling) for k in (0, 1))
    width, height = across * hmax * 8 - 3, down * vmax * 8 - 5
    data = encode(dcs, acs, across, sampling, width, height, step, interval)
    h, v = sampling[0]
    if len(sampling) == 1:
        h = v = 1
    thumb = np.zeros((down * v, across * h), int)
    for m, own in enumerate(dcs):
        for k in range(h * v):
            thumb[m // across * v + k // h, m % across * h + k % h] = min(255, max(0, int(np.floor(own[k] * step / 8 + 128.5))))
    return data, width, height, thumb[: -(-height // 8), : -(-width // 8)]


CASES = [
    ([(1, 1)], 7, 5, 0),
    ([(1, 1)], 7, 5, 7),
    ([(1, 1)], 4, 9, 5),
    ([(2, 2), (1, 1), (1, 1)], 3, 4, 0),
    ([(2, 1), (1, 1), (1, 1)], 5, 3, 2),
    ([(1, 1), (1, 1), (1, 1)], 1, 1, 0),
]


@pytest.mark.parametrize(("sampling", "across", "down", "interval"), CASES)
def test_dc_thumbnails(sampling, across, down, interval):
    data, width, height, want = picture(across, sampling, across, down, 5, interval)
    w, h, n, got = M.read_all([data])[0]
    assert (w, h, n) == (width, height, 1) and (got == want).all()


def test_many_at_once_and_broken_ones():
    good = [picture(s, *CASES[s % len(CASES)][:3], 5, CASES[s % len(CASES)][3]) for s in range(12)]
    streams = [g[0] for g in good]
    broken = [b"", b"GIF89a", streams[0][:40], streams[1][: len(streams[1]) // 2], streams[2].replace(b"\xff\xc0", b"\xff\xc2"), b"\xff\xd8\xff\xd9", None, streams[3][:-2]]
    got = M.read_all([*broken, *streams, streams[0] + streams[0]])
    assert got[: len(broken)] == [None] * len(broken)
    for g, (_, _, _, want) in zip(got[len(broken) : -1], good, strict=True):
        assert (g[3] == want).all()
    assert got[-1][2] == 2 and got[-1][1] == 2 * good[0][2]


def test_truncated_scans_never_crash():
    data = picture(3, [(2, 2), (1, 1), (1, 1)], 3, 4)[0]
    rng = np.random.default_rng(0)
    for k in range(0, len(data), 7):
        M.read_all([data[:k], data[:k] + b"\xff\xd9"])
    for _ in range(100):
        raw = bytearray(data)
        raw[int(rng.integers(2, len(raw)))] = int(rng.integers(256))
        M.read_all([bytes(raw)])


def plain_hash(pixels):
    h, w = pixels.shape
    cell = lambda i, n, size: range(min(i * size // n, size - 1), max((i + 1) * size // n, min(i * size // n, size - 1) + 1))
    mean = [[np.mean([pixels[r, c] for r in cell(i, 8, h) for c in cell(j, 9, w)]) for j in range(9)] for i in range(8)]
    bits = "".join("1" if mean[i][j] > mean[i][j + 1] + 1e-9 else "0" for i in range(8) for j in range(8))
    return int(bits, 2)


@pytest.mark.parametrize("shape", [(24, 24), (1, 1), (8, 9), (3, 50), (100, 7)])
def test_thumbnail_hash(shape):
    pixels = np.random.default_rng(sum(shape)).integers(0, 256, shape).astype(np.uint8)
    assert M.thumbnail_hash(pixels) == plain_hash(pixels)


TEXTS = [None, "", "x", "é" * 288, "y" * 576, "z" * 577, "🙂 mixed \n text " * 400, "long " * 60_000, "x"]


def test_payload_comes_back(spark):
    df = spark.createDataFrame([(i, t, b"m", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, media binary, width int")
    stored = {r["doc_id"]: bytes(r["media"]) for r in M.store_texts(df).collect()}
    found = {r["doc_id"]: r for r in M.read_features(M.store_texts(df)).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = found[i]
        assert r["n_content"] == len(raw) and r["width"] * r["height"] == 64 * len(payload)
        assert r["thumb_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert r["media_sha256"] == hashlib.sha256(stored[i]).hexdigest() and r["media_bytes"] == len(stored[i])
    assert stored[2] == stored[8] and found[7]["images"] == 2
    assert M.store_texts(df.limit(0)).count() == 0


def test_features_of_null_and_bad_media(spark):
    df = spark.createDataFrame([(1, None), (2, b"no image"), (None, b"")], "doc_id long, media binary")
    rows = {r["doc_id"]: r for r in M.read_features(df).collect()}
    assert rows[1]["media_bytes"] is None and rows[2]["media_bytes"] == 8 and rows[None]["media_bytes"] == 0
    assert all(r["width"] is None and r["thumb_hash"] is None for r in rows.values())
