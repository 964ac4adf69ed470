"""Vectorised helpers over the UTF-8 bytes of an Arrow string column.

A batch of texts is one byte array plus row offsets, so words, shingles and
windows of all its rows are found with array operations, without a Python
object for each word.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E6C63D0876A9A35 | 1
_SLICE = 1 << 21

#: ASCII white space, as in the class [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
NOT_SPACE = ~SPACE
#: Letters, digits and every byte of a non-ASCII character, as in the class [^\x00-\x2F\x3A-\x60\x7B-\x7F] of lower-cased text.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

#: Byte values for hashing: as they are, or with A-Z read as a-z.
EXACT = _VALUE
LOWER = _VALUE.copy()
LOWER[0x41:0x5B] = _VALUE[0x61:0x7B]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, _SLICE + 4096)
            for name, base in (("up", self.base), ("down", self.inverse)):
                powers = np.full(size, base, U64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))
        return self.up[:n], self.down[:n]


_POWERS = _Powers(_BASE)


class Prefix:
    """Hashes of any substring of a byte array from one running sum."""

    def __init__(self, data: np.ndarray, values: np.ndarray = EXACT):
        up, self.down = _POWERS(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(values[data] * up[:-1], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the row offsets into them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def row_groups(offsets: np.ndarray, limit: int = _SLICE):
    """Ranges of rows of about `limit` bytes; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Words(NamedTuple):
    start: np.ndarray  #: first byte of each word
    end: np.ndarray  #: byte behind it
    first: np.ndarray  #: per row, the index of its first word; one entry more than rows
    hash: np.ndarray  #: 64 bits of the word


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = NOT_SPACE, values: np.ndarray = LOWER) -> Words:
    """The maximal runs of bytes in the class `inside`; none crosses a row."""
    m = inside[data]
    at = offsets[:-1][offsets[:-1] < len(data)]
    before = np.empty_like(m)
    before[1:] = m[:-1]
    if len(m):
        before[0] = False
    before[at] = False
    start = np.flatnonzero(m & ~before)
    after = np.empty_like(m)
    after[:-1] = m[1:]
    if len(m):
        after[-1] = False
    after[at[at > 0] - 1] = False
    end = np.flatnonzero(m & ~after) + 1
    return Words(start, end, np.searchsorted(start, offsets), span_hashes(data, start, end, values))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Hashes of ascending spans, from running sums over slices of bounded size."""
    out = np.empty(len(start), U64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _SLICE, "right")))
        a = start[i]
        out[i:j] = Prefix(data[a : int(end[i:j].max())], values).hash(start[i:j] - a, end[i:j] - a)
        i = j
    return out


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n values from each place on; n - 1 entries shorter than the input."""
    if len(hashes) < n:
        return np.empty(0, U64)
    k = len(hashes) - n + 1
    total = np.full(k, n, U64)
    for j in range(n):
        total = total * U64(0xD6E8FEB86659FD93) + hashes[j : j + k]
    return mix(total)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
