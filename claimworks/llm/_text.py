"""Vectorised text helpers for Arrow batches: words and their 64-bit hashes as numpy arrays.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D of the UTF-8 text; only A-Z are
lower-cased. Hashes are polynomial over the word's bytes modulo 2**64, finalised by a mixer, so
the same word has the same hash in every batch, task and run.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, grown by doubling and kept."""
    while len(_powers["up"]) < n:
        for key, b in (("up", _BASE), ("down", _INVERSE)):
            p = _powers[key]
            _powers[key] = np.concatenate([p, p * _U(pow(b, len(p), 1 << 64))])
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (every input bit reaches every output bit)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def mix1(x: int) -> int:
    """The same finaliser for one Python integer."""
    return int(mix(np.array([x & (2**64 - 1)], _U))[0])


def sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums with a leading zero, modulo 2**64."""
    out = np.zeros(len(values) + 1, _U)
    np.cumsum(values, out=out[1:])
    return out


def released(batches) -> Iterator[pa.RecordBatch]:
    """The batches. At the end of a task its worker gives memory that it holds unused back to the
    system, as it stays for later tasks beside the JVM."""
    yield from batches
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def string_column(column) -> pa.Array:
    """The column as one 64-bit-offset string array; nulls read as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def chunks(column, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a string column with about `most` bytes each: (first row, end row, bytes,
    offsets of the rows within the bytes). A longer text stands alone; none is cut."""
    a = string_column(column)
    if not len(a):
        return
    at = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        j = min(j, len(a))
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


class Words:
    """The words of a chunk: start, end (byte positions), doc (row within the chunk), and
    first (position of each row's first word, with the total at the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True):
        self.data = LOWER[data] if lower else data
        n = len(data)
        inside = ~SPACE[data]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        closes = np.zeros(n + 1, bool)
        closes[1:] = inside
        closes[1:n] &= ~inside[1:]
        cut = offsets[(offsets > 0) & (offsets < n)]
        cut = cut[inside[cut] & inside[cut - 1]] if len(cut) else cut
        opens[cut] = True
        closes[cut] = True
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes)
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self._sums = None

    def prefix_sums(self) -> np.ndarray:
        if self._sums is None:
            up, _ = powers(len(self.data))
            self._sums = sums((self.data.astype(_U) + _U(1)) * up)
        return self._sums

    def hash(self) -> np.ndarray:
        return self.hash_range(self.start, self.end)

    def hash_range(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes from start to end, for arrays of both."""
        s = self.prefix_sums()
        _, down = powers(len(self.data) + 1)
        return mix((s[end] - s[start]) * down[start] + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of rows (row, hash): row i has the word hashes
    h[first[i]:first[i+1]]. A row with fewer words has its whole sequence as one shingle; a row
    without words has none."""
    n = np.diff(first)
    rows = np.arange(len(n))
    full = np.flatnonzero(n >= k)
    row = np.repeat(full, n[full] - k + 1)
    if len(h) >= k:
        out = np.zeros(len(h) - k + 1, _U)
        for i in range(k):
            out = out * _U(0xD1342543DE82EF95) + h[i : len(h) - k + 1 + i]
        begins = first[:-1][full]
        lengths = n[full] - k + 1
        at = np.arange(lengths.sum()) + np.repeat(begins - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) if len(full) else np.zeros(0, np.int64)
        out = mix(out[at] + _U(k))
    else:
        out, row = np.zeros(0, _U), np.zeros(0, np.int64)
    short = rows[(n > 0) & (n < k)]
    if len(short):
        extra = np.zeros(len(short), _U)
        for i, r in enumerate(short):
            x = 0
            for v in h[first[r] : first[r + 1]]:
                x = (x * 0xD1342543DE82EF95 + int(v)) & (2**64 - 1)
            extra[i] = (x + int(n[r])) & (2**64 - 1)
        extra = mix(extra)
        row, out = np.concatenate([row, short]), np.concatenate([out, extra])
        order = np.argsort(row, kind="stable")
        row, out = row[order], out[order]
    return row, out


def distinct(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs, by row and then hash, with how often each occurs."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return row[at], h[at], np.diff(np.append(at, len(row)))


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as signed integers, for a LONG column."""
    return h.view(np.int64) if h.flags.c_contiguous else np.ascontiguousarray(h).view(np.int64)
