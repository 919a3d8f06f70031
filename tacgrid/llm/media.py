"""Media columns: baseline JPEG read in numpy, for DC-only luminance thumbnails and their hashes.

The reader parses markers, decodes Huffman-coded scans and keeps of each 8 x 8 luminance block its DC value, a thumbnail
at an eighth of the size. Stretches between restart markers decode independently, so all stretches of a batch of images
that have the same tables advance together, one numpy operation for all of them; an image without restart markers is
one stretch. Sampling factors, several components and scans of one component are read; progressive files are not.

The writer stores bytes as the DC coefficients of flat blocks, the format's own unit: with a DC quantiser of 8 a block
of value v has the coefficient v - 128, and the thumbnail gives each byte back. Its Huffman table gives a code of 15 - c
bits to a difference of c bits, so that each block takes 16 bits with its end-of-block mark and no byte is ever 255.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tacgrid.llm.base import as_bytes, chunked, ids, map_arrow, table

SIDE = 24
UNIT = SIDE * SIDE
#: Block rows in one image, a multiple of 8 so that restart numbers start anew; more go to further images of the stream.
MAX_ROWS = 8184
CHUNK = 1 << 20


class MediaError(ValueError):
    """The bytes aren't a baseline JPEG stream that can be read to its end."""


_tables: dict[bytes, np.ndarray] = {}


def decoding_table(spec: bytes) -> np.ndarray:
    """For each 16 bits, length << 8 | symbol of the code that they begin with; 0 if there is none. spec: 16 counts, symbols."""
    if spec not in _tables:
        if len(_tables) >= 256:
            _tables.clear()
        _tables[spec] = _build_table(spec)
    return _tables[spec]


def _build_table(spec: bytes) -> np.ndarray:
    out = np.zeros(1 << 16, np.int32)
    code, at = 0, 16
    for length in range(1, 17):
        for _ in range(spec[length - 1]):
            begin = code << (16 - length)
            if at >= len(spec) or begin >= 1 << 16:
                raise MediaError("bad Huffman table")
            out[begin : begin + (1 << (16 - length))] = length << 8 | spec[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


@dataclass
class Scan:
    """One image's scan that has luminance: what its blocks look like, and its stretches between restart markers."""

    width: int
    height: int
    step: int  # DC quantiser
    blocks: tuple[tuple[int, bytes, bytes], ...]  # component, DC and AC table of each block of an MCU; luminance is 0
    across: int  # MCUs in a row
    mcus: int
    interval: int
    h: int
    v: int
    parts: list[bytes]


def _segments(data: bytes, at: int):
    """(marker, payload, place after it) up to the end of the image."""
    while True:
        if at + 2 > len(data) or data[at] != 0xFF:
            raise MediaError("marker expected")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            yield marker, b"", at + 2
            return
        if at + 4 > len(data):
            raise MediaError("cut off")
        n = struct.unpack_from(">H", data, at + 2)[0]
        if n < 2 or at + 2 + n > len(data):
            raise MediaError("cut off")
        told = yield marker, data[at + 4 : at + 2 + n], at + 2 + n
        at = told if told is not None else at + 2 + n


def _entropy(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The stretches of a scan, without stuffed zeros, and where the scan ends."""
    parts, begin, look = [], at, at
    while True:
        k = data.find(b"\xff", look)
        if k < 0 or k + 1 >= len(data):
            raise MediaError("scan without end")
        m = data[k + 1]
        if m == 0 or m == 0xFF:
            look = k + 1 + (m == 0)
        else:
            parts.append(data[begin:k].rstrip(b"\xff").replace(b"\xff\x00", b"\xff"))
            if not 0xD0 <= m <= 0xD7:
                return parts, k
            begin = look = k + 2


def parse(data: bytes) -> list[Scan]:
    """The luminance scans of a stream of one or more images."""
    if not data:
        raise MediaError("no image")
    out, at = [], 0
    while at < len(data):
        if data[at : at + 2] != b"\xff\xd8":
            raise MediaError("no image")
        quant, tables, frame, interval, scan = {}, {}, None, 0, None
        walk = _segments(data, at + 2)
        told = None
        while True:
            try:
                marker, body, at = walk.send(told)
            except StopIteration:
                break
            told = None
            if marker == 0xDB:
                k = 0
                while k < len(body):
                    wide = body[k] >> 4
                    if len(body) < k + 1 + 64 * (1 + wide):
                        raise MediaError("bad quantiser")
                    quant[body[k] & 15] = struct.unpack_from(">H" if wide else ">B", body, k + 1)[0]
                    k += 1 + 64 * (1 + wide)
            elif marker == 0xC4:
                k = 0
                while k < len(body):
                    n = 17 + sum(body[k + 1 : k + 17])
                    if len(body) < k + n:
                        raise MediaError("bad Huffman table")
                    tables[body[k]] = body[k + 1 : k + n]
                    k += n
            elif marker in (0xC0, 0xC1):
                if len(body) < 6 or body[0] != 8 or len(body) < 6 + 3 * body[5]:
                    raise MediaError("bad frame")
                height, width = struct.unpack_from(">HH", body, 1)
                frame = height, width, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
                if not (height and width and frame[2]) or any(not (1 <= c[1] <= 4 and 1 <= c[2] <= 4) for c in frame[2]):
                    raise MediaError("bad frame")
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise MediaError("not baseline")
            elif marker == 0xDD:
                interval = struct.unpack(">H", body)[0] if len(body) == 2 else 0
            elif marker == 0xDA:
                if not frame or not body or len(body) < 1 + 2 * body[0]:
                    raise MediaError("scan without frame")
                parts, told = _entropy(data, at)
                chosen = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
                scan = scan or _scan(frame, chosen, quant, tables, interval, parts)
        if scan is None:
            raise MediaError("no luminance scan")
        out.append(scan)
    return out


def _scan(frame, chosen, quant, tables, interval, parts) -> Scan | None:
    height, width, comps = frame
    by = {c[0]: (i, *c[1:]) for i, c in enumerate(comps)}
    if any(c not in by or t >> 4 not in tables or 0x10 | t & 15 not in tables for c, t in chosen):
        raise MediaError("scan names what isn't there")
    if comps[0][0] not in [c for c, _ in chosen]:
        return None
    _, h, v, q = by[comps[0][0]]
    if q not in quant:
        raise MediaError("no quantiser")
    hmax, vmax = max(c[1] for c in comps), max(c[2] for c in comps)
    if len(chosen) == 1:  # one block is an MCU
        across, down, h, v = -(-(-(-width * h // hmax)) // 8), -(-(-(-height * v // vmax)) // 8), 1, 1
        blocks = ((0, tables[chosen[0][1] >> 4], tables[0x10 | chosen[0][1] & 15]),)
    else:
        across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
        blocks = tuple((by[c][0], tables[t >> 4], tables[0x10 | t & 15]) for c, t in chosen for _ in range(by[c][1] * by[c][2]))
    mcus = across * down
    if len(parts) != (-(-mcus // interval) if interval else 1):
        raise MediaError("restart markers don't fit")
    return Scan(width, height, quant[q], blocks, across, mcus, interval or mcus, h, v, parts)


def thumbnails(scans: list[Scan]) -> list[np.ndarray | None]:
    """DC-only luminance of each scan, an eighth of the size; None where the data run out or have no code."""
    out: list[np.ndarray | None] = [None] * len(scans)
    alike: dict[tuple, list[int]] = {}
    for i, s in enumerate(scans):
        alike.setdefault(s.blocks, []).append(i)
    for blocks, own in alike.items():
        parts = [p for i in own for p in scans[i].parts]
        owner = np.repeat(np.arange(len(own)), [len(scans[i].parts) for i in own])
        counts = np.concatenate([np.minimum(scans[i].interval, scans[i].mcus - scans[i].interval * np.arange(len(scans[i].parts))) for i in own])
        values, good = decode_lanes(parts, counts, blocks)
        luma = sum(b[0] == 0 for b in blocks)
        bad = set(owner[~good].tolist())
        ends = np.cumsum(counts * luma)
        first = np.concatenate([[0], ends])[np.searchsorted(owner, np.arange(len(own) + 1))]
        for k, i in enumerate(own):
            if k in bad:
                continue
            s = scans[i]
            dc = values[first[k] : first[k + 1]].reshape(s.mcus // s.across, s.across, s.v, s.h).transpose(0, 2, 1, 3).reshape(-1, s.across * s.h)
            pixels = np.clip(np.floor(dc * s.step / 8 + 128.5), 0, 255).astype(np.uint8)
            out[i] = pixels[: -(-s.height // 8), : -(-s.width // 8)] if len(blocks) > 1 else pixels
    return out


def decode_lanes(parts: list[bytes], counts: np.ndarray, blocks: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Luminance DC values of all stretches, one after the other, and which stretches were sound."""
    n = len(parts)
    sizes = np.array([len(p) for p in parts], np.int64)
    data = np.frombuffer(b"".join([*(p + b"\0\0\0\0" for p in parts), b"\0\0\0\0"]), np.uint8).astype(np.uint32)
    wide = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    begin = (np.cumsum(sizes + 4) - sizes - 4) * 8
    bit, end = begin.copy(), begin + sizes * 8
    good = np.ones(n, bool)
    luma = sum(b[0] == 0 for b in blocks)
    steps = int(counts.max()) if n else 0
    values = np.zeros((n, steps * luma), np.int32)
    before = np.zeros((max(b[0] for b in blocks) + 1, n), np.int32)

    def peek(at: np.ndarray) -> np.ndarray:
        return (wide[at >> 3] >> (16 - (at & 7)).astype(np.uint32)) & 0xFFFF

    def symbol(lanes, lut: np.ndarray) -> np.ndarray:
        found = lut[peek(bit[lanes])]
        bit[lanes] += found >> 8
        over = (bit[lanes] > end[lanes]) | (found == 0)
        if over.any():
            at = (np.arange(n) if isinstance(lanes, slice) else lanes)[over]
            good[at] = False
            bit[at] = end[at]
        return found & 0xFF

    for mcu in range(steps):
        live = counts > mcu
        lanes = slice(None) if live.all() and good.all() else np.flatnonzero(live & good)
        seen = 0
        for comp, dc, ac in blocks:
            size = symbol(lanes, decoding_table(dc)).astype(np.int32)
            size = np.minimum(size, 11)
            extra = (peek(bit[lanes]) >> (16 - size).astype(np.uint32)).astype(np.int32)
            bit[lanes] += size
            low = (extra < (1 << np.maximum(size - 1, 0))) & (size > 0)
            before[comp, lanes] += extra - np.where(low, (1 << size) - 1, 0)
            if comp == 0:
                values[lanes, mcu * luma + seen] = before[0, lanes]
                seen += 1
            lut = decoding_table(ac)
            going, k = lanes, None
            while True:
                s = symbol(going, lut)
                more = s != 0
                if not more.any() and k is None:
                    break  # nothing but ends of blocks
                if k is None:
                    going = np.arange(n) if isinstance(going, slice) else going
                    k = np.ones(len(going), np.int64)
                run, size = (s >> 4).astype(np.int64), (s & 15).astype(np.int64)
                k = np.where(size > 0, k + run + 1, np.where(run == 15, k + 16, 64))
                bit[going] += size
                on = (k < 64) & good[going]
                going, k = going[on], k[on]
                if not len(going):
                    break
    good &= bit <= end
    flat = values.reshape(-1) if n == 0 or (counts == steps).all() else values[np.arange(steps * luma) < (counts * luma)[:, None]]
    return flat, good


def thumbnail_hash(pixels: np.ndarray) -> int:
    """64 bits: whether the mean grey falls from left to right, in 8 rows of 9 cells."""
    h, w = pixels.shape
    rows, cols = np.arange(9) * h // 8, np.arange(10) * w // 9
    sums = np.zeros((h + 1, w + 1), np.int64)
    sums[1:, 1:] = pixels.astype(np.int64).cumsum(0).cumsum(1)
    r0, r1 = np.minimum(rows[:-1], h - 1), np.maximum(rows[1:], np.minimum(rows[:-1], h - 1) + 1)
    c0, c1 = np.minimum(cols[:-1], w - 1), np.maximum(cols[1:], np.minimum(cols[:-1], w - 1) + 1)
    total = sums[np.ix_(r1, c1)] - sums[np.ix_(r0, c1)] - sums[np.ix_(r1, c0)] + sums[np.ix_(r0, c0)]
    area = (r1 - r0)[:, None] * (c1 - c0)
    falls = total[:, :-1] * area[:, 1:] > total[:, 1:] * area[:, :-1]
    return int.from_bytes(np.packbits(falls.ravel()).tobytes(), "big")


# The writer.
_DC = bytes([0] * 6 + [1] * 9 + [0]) + bytes(range(8, -1, -1))
_AC = bytes([1] + [0] * 15) + b"\0"


_code_cache: list[np.ndarray] = []


def _codes() -> np.ndarray:
    """The 16 bits of a block, big-endian, by difference + 255."""
    if _code_cache:
        return _code_cache[0]
    lut, out = decoding_table(_DC), np.zeros(511, ">u2")
    first = {int(lut[k]) & 0xFF: k for k in np.flatnonzero(np.diff(lut, prepend=-1)).tolist()[::-1] if lut[k]}
    for diff in range(-255, 256):
        size = abs(diff).bit_length()
        extra = diff if diff >= 0 else diff + (1 << size) - 1
        out[diff + 255] = first[size] | extra << 1
    _code_cache.append(out)
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def write_image(rows: np.ndarray) -> bytes:
    """rows: n x SIDE bytes, n up to MAX_ROWS; one flat block for each byte."""
    n = len(rows)
    diff = np.diff(rows.astype(np.int16) - 128, axis=1, prepend=0)
    body = np.empty((n, 2 * SIDE + 2), np.uint8)
    body[:, : 2 * SIDE] = _codes()[diff + 255].view(np.uint8).reshape(n, 2 * SIDE)
    body[:, -2] = 0xFF
    body[:, -1] = 0xD0 + np.arange(n) % 8
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"),
            _segment(0xDB, bytes([0, 8] + [1] * 63)),
            _segment(0xC0, struct.pack(">BHHB3B", 8, 8 * n, 8 * SIDE, 1, 1, 0x11, 0)),
            _segment(0xC4, b"\x00" + _DC + b"\x10" + _AC),
            _segment(0xDD, struct.pack(">H", SIDE)),
            _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
            body.tobytes()[:-2],
            b"\xff\xd9",
        ]
    )


def write_stream(content: bytes) -> bytes:
    """content, filled up with bytes 255 to a positive multiple of UNIT, as one or more images."""
    payload = content + b"\xff" * (-len(content) % UNIT if content else UNIT)
    rows = np.frombuffer(payload, np.uint8).reshape(-1, SIDE)
    return b"".join(write_image(rows[i : i + MAX_ROWS]) for i in range(0, len(rows), MAX_ROWS))


def store_texts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text; further columns are ignored) -> (doc_id, media), one row for each row; null texts count as empty. doc_id: whole numbers, ValueError for others."""

    def kernel(batches):
        for b in batches:
            texts = as_bytes(b.column("text"))
            for i, k in chunked([len(t or b"") for t in texts], 4 * CHUNK):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, k - i), pa.array([write_stream(t or b"") for t in texts[i:k]], pa.binary())], ["doc_id", "media"])

    return map_arrow(docs.select(ids(docs), "text"), kernel, "doc_id long, media binary")


def read_all(streams: list[bytes | None]) -> list[tuple[int, int, int, np.ndarray] | None]:
    """(width, height of all images together, images, luminance thumbnail) of each stream; None if it can't be read.

    Images of one stream stand below each other; those of unequal width can't be read as one.
    """
    scans, of, out = [], [], []
    for i, s in enumerate(streams):
        try:
            own = parse(s or b"")
        except MediaError:
            own = []
        scans += own
        of += [i] * len(own)
    found = thumbnails(scans)
    at = 0
    for i in range(len(streams)):
        begin = at
        while at < len(of) and of[at] == i:
            at += 1
        own, pixels = scans[begin:at], found[begin:at]
        if not own or any(p is None for p in pixels) or len({s.width for s in own}) > 1:
            out.append(None)
        else:
            out.append((own[0].width, sum(s.height for s in own), len(own), np.concatenate(pixels)))
    return out


COLUMNS = "doc_id long, media_bytes long, media_sha256 string, width int, height int, images int, thumb_hash string, thumb_sha256 string, n_content long, tail_crc32 long"


def read_features(media: DataFrame) -> DataFrame:
    """media (doc_id, media) -> COLUMNS, one row for each row.

    n_content is the thumbnail's size without bytes 255 at its end, tail_crc32 belongs to its last 32 bytes. Null media
    and what isn't readable baseline JPEG give nulls from width on (and null size and digest for null). Equal media
    give equal values.
    doc_id: whole numbers, ValueError for others.
    """

    def kernel(batches):
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        for b in batches:
            streams = as_bytes(b.column("media"))
            rows = []
            for i, k in chunked([len(s or b"") for s in streams], 2 * CHUNK):
                for s, found in zip(streams[i:k], read_all(streams[i:k]), strict=True):
                    own = [None, None] if s is None else [len(s), hashlib.sha256(s).hexdigest()]
                    if found is None:
                        rows.append([*own, *[None] * 7])
                    else:
                        width, height, images, pixels = found
                        raw = pixels.tobytes()
                        rows.append([*own, width, height, images, f"{thumbnail_hash(pixels):016x}", hashlib.sha256(raw).hexdigest(), len(raw.rstrip(b"\xff")), zlib.crc32(raw[-32:])])
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds))], names)

    return map_arrow(media.select(ids(media), "media"), kernel, COLUMNS)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_features(store_texts(table(spark, sf_dir, "documents")))
    return found.select(
        "doc_id",
        F.col("n_content").alias("n_bytes"),
        (F.col("width") / 8 * (F.col("height") / 8)).cast("long").alias("payload_bytes"),
        F.col("thumb_sha256").alias("payload_sha256"),
        "tail_crc32",
        "media_bytes",
        "media_sha256",
        F.format_string("%dx%d/%d:%s", "width", "height", "images", "thumb_hash").alias("feature"),
    )
