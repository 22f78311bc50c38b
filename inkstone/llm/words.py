"""Whole-column word hashing on the UTF-8 buffers of Arrow strings, without a Python object per word.

Words are maximal runs of bytes outside space and 0x09-0x0D (the first 33 code points hold all separators, so bytes and
characters split alike). A word's hash is polynomial over random byte values modulo 2^64 and then mixed; window hashes
combine word hashes the same way. Hashes only propose: operators that promise exact results confirm on wider hashes or texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; one longer text is handled alone.
CHUNK = 1 << 20

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values of a seed."""
    return mix((np.arange(1, n + 1, dtype=U) + U(seed << 20)) * U(0x9E3779B97F4A7C15))


BASE = U(0x9E3779B97F4A7C13)
BASE_INVERSE = U(pow(0x9E3779B97F4A7C13, -1, 1 << 64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: All of ASCII but letters: what is left are words without marks and digits.
NOT_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), kept up to one chunk; what a longer text needs is made for it alone."""
    p = _powers.get(int(base))
    if p is None or len(p) < n:
        p = np.full(max(n, CHUNK), base, U)
        p[0] = 1
        p = np.multiply.accumulate(p)
        if len(p) <= 4 * CHUNK:
            _powers[int(base)] = p
    return p[:n]


@dataclass
class Chunk:
    """Some consecutive rows. first[i]:first[i+1] are the words of row i; start and end are byte offsets into raw."""

    row: int
    raw: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def hashes(self, seed: int = 1, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.start):
            return np.zeros(0, U)
        values = stream(seed, 256)
        if lower:
            values = values[LOWER]
        total = np.empty(len(self.raw) + 1, U)
        total[0] = 0
        np.cumsum(values[self.raw] * powers(BASE, len(self.raw)), out=total[1:])
        h = (total[self.end] - total[self.start]) * powers(BASE_INVERSE, len(self.raw))[self.start]
        return mix(h + (self.end - self.start).astype(U))


def grams(h: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """The hash of each k consecutive words, len(h) - k + 1 of them (they cross rows; callers drop those)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    factors = stream(seed, k) | U(1)
    out = h[:n] * factors[0]
    for j in range(1, k):
        out += h[j : j + n] * factors[j]
    return mix(out)


def chunks(column: pa.Array, most: int = CHUNK, separator: np.ndarray = SEPARATOR) -> Iterator[Chunk]:
    """Chunks of a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, bounds, data = column.buffers()
    offsets = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        part = raw[offsets[row] : offsets[to]]
        own = offsets[row : to + 1] - offsets[row]
        word = np.zeros(len(part) + 2, bool)
        np.logical_not(separator[part], out=word[1:-1])
        begins, ends = word[1:-1] & ~word[:-2], word[1:-1] & ~word[2:]
        inner = own[1:-1]
        inner = inner[(inner > 0) & (inner < len(part))]
        begins[inner] |= word[1:-1][inner]
        ends[inner - 1] |= word[1:-1][inner - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        yield Chunk(row, part, own, start, end, np.searchsorted(start, own))
        row = to
