"""Vectorised words and n-gram keys over a column of texts (numpy inside Arrow tasks).

A word is a maximal run of bytes outside ``0x20, 0x09-0x0D``. These six bytes never occur inside a
multi-byte UTF-8 sequence, so byte runs and code-point runs are the same words. Word and n-gram keys
are 64-bit: a polynomial over per-byte random values, finished by a bit mixer. The work is done in
slices of a few MB, so a very long text costs a few bytes per byte of text, not a few words per byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: white space and ASCII punctuation
SPACE_OR_MARK = SPACE | np.array([33 <= c < 127 and not chr(c).isalnum() for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_C = np.uint64(0xD6E8FEB86659FD93)
_SLICE = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit key so that all of its bits depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 64), _P, np.uint64)
        p[0] = 1
        _POWERS = np.cumprod(p, dtype=np.uint64)
    return _POWERS


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array and n + 1 offsets into it; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):  # older Arrow gives no single array for zero chunks
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_binary())
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64)[col.offset: col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]: offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a column: ``start``/``end`` byte positions, ``first[d]:first[d+1]`` = words of text d."""

    def __init__(self, col: pa.Array | pa.ChunkedArray, lower: bool = False, breaks: np.ndarray = SPACE):
        self.data, self.offsets = text_bytes(col)
        n = len(self.data)
        is_word = ~breaks[self.data]
        begins, ends = is_word.copy(), is_word.copy()
        if n:
            begins[1:] &= ~is_word[:-1]
            ends[:-1] &= ~is_word[1:]
            cut = self.offsets[:-1]
            cut = cut[cut < n]
            begins[cut] = is_word[cut]
            cut = cut[cut > 0]
            ends[cut - 1] = is_word[cut - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.table = np.where(breaks, np.uint64(0), _BYTE[_LOWER] if lower else _BYTE)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def keys(self) -> np.ndarray:
        """A 64-bit key for each word."""
        out = np.empty(len(self.start), np.uint64)
        i, n = 0, len(out)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.start, self.start[i] + _SLICE)))
            a, b = self.start[i], self.end[j - 1]
            s = self.start[i:j] - a
            span = np.diff(np.append(s, b - a))
            pos = np.arange(b - a, dtype=np.int64) - np.repeat(s, span)
            length = self.end[i:j] - self.start[i:j]
            pw = _powers(int(span.max()) + 1)
            v = self.table[self.data[a:b]] * pw[pos]
            out[i:j] = np.add.reduceat(v, s) + length.astype(np.uint64) * _C
            i = j
        return mix(out)


def ngram_keys(keys: np.ndarray, n: int) -> np.ndarray:
    """Key of each run of ``n`` consecutive entries (length ``len(keys) - n + 1``, or none)."""
    if len(keys) < n:
        return np.zeros(0, np.uint64)
    out, done, block, size = None, 0, keys, 1
    with np.errstate(over="ignore"):
        left = n
        while left:
            if left & 1:
                if out is None:
                    out = block.copy()
                else:
                    m = min(len(out), len(block) - done)
                    out = out[:m] * np.uint64(pow(int(_C), size, 1 << 64)) + block[done: done + m]
                done += size
            left >>= 1
            if left:
                block = block[:-size] * np.uint64(pow(int(_C), size, 1 << 64)) + block[size:]
                size *= 2
    return mix(out[: len(keys) - n + 1])


def inside(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of the ``total - n + 1`` runs of n entries stay inside one text."""
    m = total - n + 1
    if m <= 0:
        return np.zeros(0, bool)
    ok = np.ones(m, bool)
    for j in range(1, n):  # a run starting at p crosses the text start at p + j
        cut = first[(first >= j) & (first < total)] - j
        ok[cut[cut < m]] = False
    return ok


def covered(flags: np.ndarray, n: int, total: int) -> np.ndarray:
    """Entries (of ``total``) inside at least one flagged run of n entries."""
    d = np.zeros(total + 1, np.int32)
    at = np.flatnonzero(flags)
    d[at] += 1
    d[at + n] -= 1
    return np.cumsum(d[:-1]) > 0
