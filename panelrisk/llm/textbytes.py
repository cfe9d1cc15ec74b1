"""Vectorised word and hash primitives over the UTF-8 bytes of an Arrow text column.

A word is a maximal run of bytes other than ASCII white space (0x20,
0x09-0x0D); all of these bytes stand alone in UTF-8, so words never cut a code
point. Hashes are 64-bit and depend on the bytes alone, never on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of uint64 that spreads every bit."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def byte_codes(fold_case: bool) -> np.ndarray:
    """A random 64-bit code per byte value; with ``fold_case`` A-Z share a-z's."""
    codes = splitmix(np.arange(256, dtype=np.uint64) + np.uint64(7 << 32))
    if fold_case:
        codes[0x41:0x5B] = codes[0x61:0x7B]
    return codes


_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(size, base & _MASK, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_case: bool = False) -> np.ndarray:
    """64-bit hash of each byte span; equal bytes (and lengths) give equal hashes."""
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(byte_codes(fold_case)[data] * up[:-1], out=total[1:])
    return splitmix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def text_blocks(column: pa.Array | pa.ChunkedArray, max_bytes: int = 1 << 21, max_rows: int = 1 << 16) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, bytes, row offsets) for runs of at most ``max_rows`` rows of about ``max_bytes``.

    A null text counts as empty. A text longer than ``max_bytes`` makes a run of its
    own, so the working memory is bounded by the longer of the two.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return
    _, offs, body = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, side="right")) - 1)
        hi = min(hi, n, lo + max_rows)
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, per-row index into them) of all words; rows never share a word."""
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.ones(len(data), dtype=bool)
    before[1:] = ~solid[:-1]
    starts = np.flatnonzero(solid & (before | edge[:-1]))
    after = np.ones(len(data), dtype=bool)
    after[:-1] = ~solid[1:]
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of one text.

    With fewer words the whole sequence is one shingle; no words, none.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    k = min(width, n)
    total = np.zeros(n - k + 1, dtype=np.uint64)
    for j in range(k):
        total = total * np.uint64(_BASE) + words[j : n - k + 1 + j]
    return np.unique(splitmix(total + np.uint64(k)))
