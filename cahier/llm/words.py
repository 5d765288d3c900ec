"""Words of whole texts and hashes of words and word n-grams as numpy arrays, straight from Arrow buffers.

Word hashes have 64 bits: polynomials over the bytes (random odd base, random value per byte) taken as differences of
one running sum, then mixed. Texts that differ get equal hashes with a chance of about 5e-20 per pair.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_rng = np.random.default_rng(20240517)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Not white space: everything but \x20 and \x09-\x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Letters and digits of ASCII in lower case, and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 1 << 16)
        p, q = np.full(size, _BASE), np.full(size, _BASE_INVERSE)
        p[0] = q[0] = 1
        _powers, _inverses = np.multiply.accumulate(p), np.multiply.accumulate(q)


def _sums(v: np.ndarray) -> np.ndarray:
    out = np.zeros(len(v) + 1, np.uint64)
    np.cumsum(v, out=out[1:])
    return out


class Words:
    """The words of a few texts: ``start`` and ``end`` (bytes), ``first`` (index of each text's first word, and the total), ``hash``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = NOT_SPACE, lower: bool = False):
        n = len(data)
        if lower:
            data = LOWER[data]
        m = is_word[data]
        edge = offsets[(offsets > 0) & (offsets < n)]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = m[:-1], m[1:]
        before[edge], after[edge - 1] = False, False
        self.data = data
        self.start = np.flatnonzero(m & ~before)
        self.end = np.flatnonzero(m & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = spans(data, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def room(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.start))


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], byte strings."""
    _grow(len(data) + 1)
    s = _sums(_BYTE[data] * _powers[: len(data)])
    return mix((s[end] - s[start]) * _inverses[start] + (end - start).astype(np.uint64))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive word hashes, one for each start; starts whose text ends sooner mean nothing."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k <= 8:
        g = h[:n].copy()
        for j in range(1, k):
            g = g * _BASE + h[j : j + n]
        return mix(g)
    _grow(len(h) + 1)
    s = _sums(h * _powers[: len(h)])
    return mix((s[k:] - s[:-k]) * _inverses[:n])


def text_blocks(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20, text: int = 1) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of Arrow batches with at most ``limit`` bytes of text (or one longer text), their bytes and offsets.

    Column ``text`` holds the texts; null is taken as empty.
    """
    for b in batches:
        col = pc.fill_null(b.column(text), "").cast(pa.large_string())
        if not len(col):
            continue
        _, off, raw = col.buffers()
        off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield b.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to
    _give_back()


def _give_back() -> None:
    """Freed memory back to the system at the end of a task; a worker is used again for tasks of other kinds."""
    global _powers, _inverses
    _powers, _inverses = _powers[: 1 << 16].copy(), _inverses[: 1 << 16].copy()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)
