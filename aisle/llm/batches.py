"""Vectorised words and hashes of whole Arrow text columns.

The helpers work on the bytes of many documents at once, so the cost of a text is
that of a few NumPy passes over it. Words are maximal runs of bytes other than
ASCII white space (\\x20, \\x09-\\x0D), the definition of all word contracts here.
Hashes are 64 bits wide and depend on nothing but the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
"""Bytes worked on at once; a longer single text is one chunk of its own."""

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = np.array(x, np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SALT = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_LOWER = _SALT.copy()
_LOWER[65:91] = _SALT[97:123]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for i, base in enumerate((_BASE, _INVERSE)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _POWERS[i] = np.cumprod(step, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Parts of a text column as (first row, bytes, offsets); null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    rows = len(column)
    if not rows:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + rows + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < rows:
        last = max(int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1, first + 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


class Words:
    """The words of the texts of one chunk.

    ``start``, ``end``: byte ranges; ``doc``: index of the word's text; ``first``:
    where each text's words begin (one more entry than there are texts).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, keep: np.ndarray | None = None):
        inside = ~SPACE[data] if keep is None else keep
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n + 1, bool)
        before[0], before[1:] = False, inside
        after = np.empty(n + 1, bool)
        after[n], after[:n] = False, inside
        self.start = np.flatnonzero(after & (~before | edge))
        self.end = np.flatnonzero(before & (~after | edge))
        self.data = data
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def hashes(self, lower: bool = False) -> np.ndarray:
        """64-bit hash of each word; ``lower`` folds A-Z first."""
        return span_hashes(self.data, self.start, self.end, lower)

    def windows(self, hashes: np.ndarray, size: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(index of first word, hash) of all runs of ``size`` words within one text, or of those that begin ``at``."""
        n = len(hashes)
        if n < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if at is None:
            at = np.flatnonzero(self.doc[: n - size + 1] == self.doc[size - 1 :])
        else:
            at = at[at <= n - size]
            at = at[self.doc[at] == self.doc[at + size - 1]]
        total = np.zeros(len(at), np.uint64)
        for k in range(size):
            total += hashes[at + k] * _SALT[k]
        return at, mix(total + np.uint64(size))

    def shingles(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Concatenated distinct shingle hashes per text, ascending, and their bounds.

        A text with fewer than ``size`` words has its whole sequence as one shingle;
        one without words has none.
        """
        at, found = self.windows(hashes, size)
        doc = self.doc[at]
        counts = np.diff(self.first)
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            total = np.zeros(len(short), np.uint64)
            for k in range(size - 1):
                have = counts[short] > k
                total[have] += hashes[self.first[short[have]] + k] * _SALT[k]
            found = np.concatenate([found, mix(total + counts[short].astype(np.uint64))])
            doc = np.concatenate([doc, short])
            order = np.argsort(doc, kind="stable")
            found, doc = found[order], doc[order]
        bounds = np.searchsorted(doc, np.arange(len(counts) + 1))
        parts = [np.unique(found[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        sizes = np.array([0, *map(len, parts)])
        return (np.concatenate(parts) if parts else found), np.cumsum(sizes)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each byte range."""
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER if lower else _SALT)[data] * power[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def code_points(data: np.ndarray) -> np.ndarray:
    """True where a byte begins a UTF-8 code point."""
    return (data & 0xC0) != 0x80


def counts_between(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of true flags in each of the ranges that ``offsets`` bound."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])
