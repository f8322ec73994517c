"""Word shingles of texts as 64-bit hashes, computed on whole Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE = _U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def slices(column: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with at most ``most`` bytes, or one row. Null rows are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        upto = max(row + 1, int(np.searchsorted(ends, ends[row] + most, side="right")) - 1)
        yield row, raw[ends[row]: ends[upto]], ends[row: upto + 1] - ends[row]
        row = upto


def word_hashes(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of every row and the total): A-Z lower-cased, split at ASCII white space."""
    rows = len(ends) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = ends[:-1][ends[:-1] < len(raw)]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    gap = np.diff(np.append(starts, len(raw)))
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, gap)
    powers = np.cumprod(np.full(int(place.max()) + 1, _BASE, dtype=np.uint64))
    terms = _BYTE[_LOWER[raw[starts[0]:]]] * powers[place]
    terms[~inside[starts[0]:]] = 0
    return mix(np.add.reduceat(terms, starts - starts[0])), np.searchsorted(starts, ends)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For every row its sorted distinct shingle hashes: ``width`` words each; a row with fewer words has one shingle
    of all its words, a row without words none."""
    for _, raw, ends in slices(column):
        words, bounds = word_hashes(raw, ends)
        joined = words
        for k in range(1, width):
            joined = mix(joined[: max(0, len(words) - k)] * _BASE + words[k:])
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(joined[a: b - width + 1])
            elif b > a:
                whole = words[a: a + 1]
                for k in range(a + 1, b):
                    whole = mix(whole * _BASE + words[k: k + 1])
                yield mix(whole + _U(b - a))
            else:
                yield np.zeros(0, np.uint64)
