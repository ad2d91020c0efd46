"""Vectorised word, line and hash arithmetic over one Arrow column of UTF-8 bytes.

All helpers work inside a task on a bounded block of documents.  Words are
``[^\\x20\\x09-\\x0D]+``; the separators are single ASCII bytes, so splitting
the UTF-8 bytes gives the same words as splitting the characters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class RollingHash:
    """Polynomial hashes modulo 2**64 of any slices of a sequence, from prefix sums."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.base = U64(int(rng.integers(2**55, 2**60)) * 8 + 5)
        self.inverse = U64(pow(int(self.base), -1, 2**64))
        self.table = mix(rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64)) | U64(1)
        self.powers = self.inverses = np.ones(1, dtype=U64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            m = -(-n // (1 << 16)) << 16
            for name, r in (("powers", self.base), ("inverses", self.inverse)):
                a = np.full(m, r, dtype=U64)
                a[0] = 1
                setattr(self, name, np.cumprod(a, dtype=U64))

    def _slices(self, terms: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        total = np.zeros(len(terms) + 1, dtype=U64)
        np.cumsum(terms, out=total[1:])
        return mix((total[ends] - total[starts]) * self.inverses[starts])

    def of_bytes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        return self._slices(self.table[data] * self.powers[:len(data)], starts, ends)

    def of_values(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        return self._slices(values * self.powers[:len(values)], starts, ends)


def binary_block(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow binary column; a null value is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset:]
    if bufs[2] is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges of whole documents of about ``limit`` bytes; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends (byte positions) and the first word of each document (n + 1)."""
    n = len(data)
    inside = ~SPACE[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:n]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, hashes: list[RollingHash]):
    """Per ``hashes`` an array of word hashes, and the first word of each document (n + 1)."""
    parts, counts = [[] for _ in hashes], [np.zeros(1, dtype=np.int64)]
    seen = 0
    for i, j in chunks(offsets):
        block, at = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        s, e, firsts = words(block, at)
        for k, h in enumerate(hashes):
            parts[k].append(h.of_bytes(block, s, e))
        counts.append(firsts[1:] + seen)
        seen += len(s)
    return [np.concatenate(p) if p else np.zeros(0, dtype=U64) for p in parts], np.concatenate(counts)


def windows(values: np.ndarray, size: int, rolling: RollingHash) -> np.ndarray:
    """Hash of each run of ``size`` values, by start (the last size - 1 starts are missing)."""
    n = max(0, len(values) - size + 1)
    at = np.arange(n)
    return rolling.of_values(values, at, at + size)


def fits(firsts: np.ndarray, size: int) -> np.ndarray:
    """Whether a window of ``size`` starting at each word stays in its document."""
    n = int(firsts[-1])
    left = np.repeat(firsts[1:], np.diff(firsts)) - np.arange(n)
    return left >= size


def pack_ints(values: np.ndarray) -> bytes:
    """Bytes of ascending or repeated small integers: differences, split into byte planes."""
    d = np.diff(values.astype(np.int64), prepend=0)
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_ints(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int64).ravel())
