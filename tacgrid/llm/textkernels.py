"""Numpy kernels over batches of texts: words, 64-bit word hashes, hashed n-grams."""

from __future__ import annotations

import numpy as np

U = np.uint64
_rng = np.random.default_rng(20240229)
#: Random odd multipliers by place in a word, and random values by byte.
PLACE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
A, B, C = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
SPACE = 32


def separator_table(is_word) -> bytes:
    """A translation that lower-cases A-Z and turns each byte that is in no word into a space."""
    return bytes((b + 32 if 65 <= b <= 90 else b) if is_word(b + 32 if 65 <= b <= 90 else b) else SPACE for b in range(256))


#: Digits, ASCII letters and whatever is not ASCII.
ALNUM = separator_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
#: All but white space.
VISIBLE = separator_table(lambda b: b != 32 and not 9 <= b <= 13)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h = h * A
    h = h ^ (h >> U(29))
    h = h * B
    return h ^ (h >> U(32))


class Words:
    """The words of several texts. starts, ends: places in buf; doc: number of the text; hashes: 64 bits each."""

    def __init__(self, texts: list[bytes | None], separators: bytes) -> None:
        texts = [t or b"" for t in texts]
        data = b" ".join([b"", *texts, b""]).translate(separators)
        self.n = len(texts)
        self.buf = np.frombuffer(data, np.uint8)
        self.first = np.cumsum([1, *(len(t) + 1 for t in texts)])[:-1]
        inside = self.buf != SPACE
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.starts, self.ends = edges[::2], edges[1::2]
        self.doc = np.searchsorted(self.first, self.starts, "right") - 1
        self._inside = inside

    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lens = self.ends - self.starts
        begin = np.cumsum(lens) - lens
        place = np.arange(int(lens.sum())) - np.repeat(begin, lens)
        values = BYTE[self.buf[self._inside]] * PLACE[place & 255]
        return mix(np.add.reduceat(values, begin) + lens.astype(np.uint64) * C)


def pairs_at(doc: np.ndarray, h: np.ndarray, gap: int, salt: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of (word, word gap places on) within a text, and the texts' numbers."""
    if len(h) <= gap:
        return np.zeros(0, np.uint64), np.zeros(0, doc.dtype)
    same = doc[gap:] == doc[:-gap]
    return mix(h[:-gap] * salt + h[gap:])[same], doc[gap:][same]


def char_grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the strings of n characters within words, a space marking a word's begin and end; and their places in buf."""
    chars = np.frombuffer(words.buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    places = np.flatnonzero((words.buf & 0xC0) != 0x80)  # where characters begin
    if len(chars) != len(places):  # not UTF-8: bytes are characters
        chars, places = words.buf.astype(np.uint32), np.arange(len(words.buf))
    if len(chars) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(chars) - n + 1
    code, inner = np.zeros(m, np.uint64), np.ones(m, bool)
    for k in range(n):
        part = chars[k : k + m]
        code = code * B + part
        if 0 < k < n - 1:
            inner &= part != SPACE
    at = np.flatnonzero(inner)
    return mix(code[at] * C + U(n)), places[at]
