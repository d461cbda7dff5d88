"""Words and word shingles of whole Arrow text columns, hashed with NumPy.

A word is a run of bytes other than space and ``\\t`` to ``\\r``; ASCII capitals are lowered.
Both rules only touch ASCII bytes, so they can work on UTF-8 without decoding it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20      # text handled at a time; a longer document is a piece of its own
_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_LOWERED = _BYTE.copy()
_LOWERED[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_STEPS = _RNG.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 12), np.uint64(base))
        have[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64 bits so that any of them can be used alone."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pieces(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets into them), a bounded stretch of rows at a time; null is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE_BYTES, side="right")) - 1)
        yield row, data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row]
        row = stop


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the number of words before it (one entry more)."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    np.logical_not(_SPACE[data], out=inside[1:-1])
    begins = inside[1:] & ~inside[:-1]
    # a word also begins where a row does, if its first byte is in a word
    first = offsets[:-1][(offsets[:-1] < offsets[1:])]
    begins[first] |= inside[first + 1]
    ends = inside[1:-1] & ~inside[2:]
    last = offsets[1:][(offsets[:-1] < offsets[1:])] - 1
    ends[last] |= inside[last + 1]
    starts = np.flatnonzero(begins[:len(data)])
    stops = np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the words; ``lower``: with ASCII capitals lowered."""
    out = np.zeros(len(starts), dtype=np.uint64)
    table, first = _LOWERED if lower else _BYTE, 0
    while first < len(starts):
        # a stretch of words at a time, so that a very long text needs no more memory than others
        last = max(first + 1, int(np.searchsorted(stops, starts[first] + PIECE_BYTES, side="right")))
        low, high = starts[first], stops[last - 1]
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(table[data[low:high]] * _powers(_BASE, high - low), out=sums[1:])
        at, to = starts[first:last] - low, stops[first:last] - low
        # divided by the power of its start, a word's sum no longer depends on its place
        out[first:last] = mix((sums[to] - sums[at]) * _powers(pow(_BASE, -1, 1 << 64), high - low)[at] + (to - at).astype(np.uint64))
        first = last
    return out


def shingles(hashes: np.ndarray, edges: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every window of ``width`` words per row, and the row of each.

    A row with fewer words has its whole sequence as one; a row without words has none.
    """
    counts = np.diff(edges)
    full = np.maximum(counts - width + 1, 0)
    rows = np.repeat(np.arange(len(counts)), full)
    first = np.repeat(edges[:-1] - (np.cumsum(full) - full), full) + np.arange(full.sum())
    total = np.zeros(len(first), dtype=np.uint64)
    for k in range(width):
        total += hashes[first + k] * _STEPS[k]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = counts[short].astype(np.uint64) * _STEPS[-1]
        for k in range(width - 1):
            has = counts[short] > k
            extra[has] += hashes[edges[short][has] + k] * _STEPS[k]
        rows, total = np.concatenate([rows, short]), np.concatenate([total, extra])
    return mix(total), rows


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, number of rows, set elements sorted by (row, hash), their rows) piece by piece."""
    for first, data, offsets in pieces(texts):
        starts, stops, edges = word_spans(data, offsets)
        found, rows = shingles(word_hashes(data, starts, stops), edges, width)
        order = np.argsort(found)
        order = order[np.argsort(rows[order].astype(np.int32), kind="stable")]
        found, rows = found[order], rows[order]
        new = np.ones(len(found), dtype=bool)
        new[1:] = (found[1:] != found[:-1]) | (rows[1:] != rows[:-1])
        yield first, len(offsets) - 1, found[new], rows[new]
