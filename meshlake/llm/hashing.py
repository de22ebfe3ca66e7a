"""Words of whole blocks of texts as arrays: where they stand, and hashes of slices.

Nothing here works word by word: a block of texts is one array of bytes, whose words are found by
comparing neighbours, and every hash is a difference of two entries of a running sum.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that are taken at a time; one longer text is a block of its own. The arrays of a
#: block are many times as large, in every Python worker of an executor.
BLOCK = 1 << 19
#: Base of the polynomials, modulo 2**64, and its inverse, which takes a part out of a running sum.
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """256 flags, set for the bytes of the ranges (first, last)."""
    out = np.zeros(256, bool)
    for first, last in ranges:
        out[first : last + 1] = True
    return out


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        _powers = tuple(np.cumprod(np.r_[np.uint64(1), np.full(n + n // 4, x, np.uint64)], dtype=np.uint64) for x in (_BASE, _UNBASE))
    return _powers[0][:n], _powers[1][:n]


def polynomials(x: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each slice [first, end) of ``x``, whatever its place, from one running sum."""
    up, down = _powers_to(len(x) + 1)
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * up[:-1], out=total[1:])
    h = (total[end] - total[first]) * down[first]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(_BASE) + (end - first).astype(np.uint64)
    return h ^ (h >> np.uint64(29))


@dataclass
class Words:
    """The words of a block of texts: ``raw`` bytes, ``first`` and ``last`` byte and ``text`` of each, and whether a line begins with it."""

    raw: np.ndarray
    first: np.ndarray
    last: np.ndarray
    text: np.ndarray
    fresh: np.ndarray

    def hashes(self) -> np.ndarray:
        """64-bit hashes, none of them 0."""
        if not len(self.first):
            return np.empty(0, np.uint64)
        return np.maximum(polynomials(self.raw.astype(np.uint64) + np.uint64(1), self.first, self.last + 1), np.uint64(1))

    def bounds(self, n_texts: int) -> np.ndarray:
        """First word of each text, and the number of words behind."""
        return np.searchsorted(self.text, np.arange(n_texts + 1))


def words_of(texts: pa.Array, between: np.ndarray) -> Words:
    """Words are maximal runs of bytes for which the table ``between`` has no flag."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    white = between[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    begins, ends = ~white, ~white
    begins[1:] &= white[:-1] | edge[1:-1]
    ends[:-1] &= white[1:] | edge[1:-1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    text = np.searchsorted(offsets, first, "right") - 1
    fresh = np.ones(len(first), bool)
    if len(first):
        lines = np.cumsum(raw == 10)
        fresh[1:] = (lines[first[1:]] > lines[last[:-1]]) | (text[1:] != text[:-1])
    return Words(raw, first, last, text, fresh)


def blocks(texts: pa.Array):
    """(first row, slice) of about ``BLOCK`` bytes, or of one longer text; null texts are empty."""
    texts = texts.fill_null("")
    ends = np.cumsum(np.asarray(pc.binary_length(texts)))
    lo = 0
    while lo < len(texts):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + BLOCK, "right")))
        yield lo, texts.slice(lo, hi - lo)
        lo = hi
