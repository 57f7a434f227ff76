"""Vectorised helpers over UTF-8 bytes, used inside Arrow batches.

A batch's texts are one byte array plus offsets. Prefix polynomial hashes modulo 2**64
give the hash of any byte range in O(1): ``(H[e] - H[s]) * B**-s``. Every byte value is
first replaced by a random 64-bit number and results are mixed, so the weakness of low
bits under a power-of-two modulus doesn't show. Hashes only ever propose; operators
whose contract is exact confirm on real bytes or on 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
MASK64 = (1 << 64) - 1
#: Whitespace of the contracts: space and 0x09-0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SLICE_BYTES = 1 << 21


def table(seed: int) -> np.ndarray:
    """256 random 64-bit numbers, the same in every process."""
    return np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Poly:
    """Prefix hashes with one odd base; powers are kept and grow on demand."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed + 1)
        self.base = int(rng.integers(1 << 40, 1 << 62)) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.table = table(seed)
        self.powers = self.inverses = np.ones(1, dtype=U64)

    def _grown(self, base: int, n: int) -> np.ndarray:
        out = np.full(n, base, dtype=U64)
        out[0] = 1
        return np.multiply.accumulate(out, dtype=U64)

    def reserve(self, n: int) -> None:
        if len(self.powers) < n:
            n = 1 << (n - 1).bit_length()
            self.powers, self.inverses = self._grown(self.base, n), self._grown(self.inverse, n)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self.reserve(len(data) + 1)
        out = np.empty(len(data) + 1, dtype=U64)
        out[0] = 0
        np.cumsum(self.table[data] * self.powers[: len(data)], dtype=U64, out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.inverses[start])


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1] or b"\0" * 8, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes; a longer single text is a range of its own."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


#: Bytes of letters, digits and of anything beyond ASCII.
ALNUM = np.array([chr(b).isalnum() and b < 128 or b >= 128 for b in range(256)])


def words(data: np.ndarray, offsets: np.ndarray, poly: Poly, solid_bytes: np.ndarray = ~SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, start, end, hash) of each word; A-Z lower-cased, words are runs of ``solid_bytes`` (all but whitespace)."""
    data = LOWER[data]
    solid = solid_bytes[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | first[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | first[1:-1]
    start, end = np.flatnonzero(begin), np.flatnonzero(last) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    return doc, start, end, poly.ranges(poly.prefix(data), start, end)


def shingles(doc: np.ndarray, word: np.ndarray, size: int, whole_if_short: bool, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of each run of ``size`` words, in order, repeats included.

    A text with fewer words counts its whole sequence as one shingle if ``whole_if_short``.
    """
    n = len(word)
    multiplier = np.random.default_rng(size * 7919 + 5).integers(1 << 32, 1 << 62, size + 1, dtype=np.int64).astype(U64) * U64(2) + U64(1)
    if n >= size:
        keep = doc[: n - size + 1] == doc[size - 1 :]
        total = np.zeros(n - size + 1, dtype=U64)
        for k in range(size):
            total += word[k : n - size + 1 + k] * multiplier[k]
        d, h = doc[: n - size + 1][keep], mix(total[keep])
    else:
        d, h = np.zeros(0, doc.dtype), np.zeros(0, U64)
    if whole_if_short:
        counts = np.bincount(doc, minlength=n_docs) if n else np.zeros(n_docs, np.int64)
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            starts = np.concatenate([[0], np.cumsum(counts)[:-1]])[short]
            total = counts[short].astype(U64) * multiplier[size]
            for k in range(size - 1):
                has = counts[short] > k
                total[has] += word[(starts + k)[has]] * multiplier[k]
            d, h = np.concatenate([d, short.astype(d.dtype)]), np.concatenate([h, mix(total)])
            order = np.argsort(d, kind="stable")
            d, h = d[order], h[order]
    return d, h


def distinct(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text index, value), sorted."""
    order = np.lexsort((value, doc))
    d, v = doc[order], value[order]
    keep = np.ones(len(d), dtype=bool)
    keep[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    return d[keep], v[keep]


def as_binary(rows: np.ndarray) -> pa.Array:
    """A fixed-width 2-D array as a binary column, one value a row."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize if rows.ndim == 2 else rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def from_binary(column: pa.Array, dtype, width: int) -> np.ndarray:
    """The inverse of as_binary()."""
    data, offsets = flat(column)
    return np.frombuffer(data.tobytes(), dtype=dtype).reshape(len(offsets) - 1, width)
