"""Vectorised text kernels over Arrow string columns.

Everything works on the UTF-8 bytes of a batch at once: word boundaries, 64-bit
word hashes and hashes of word windows come out of a handful of numpy passes,
with no Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
BLOCK_BYTES = 1 << 18
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_K = np.uint64(0xD6E8FEB86659FD93)
_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)

SPACE_SEPARATORS = np.zeros(256, bool)
SPACE_SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True

ALNUM_SEPARATORS = np.ones(256, bool)
ALNUM_SEPARATORS[0x30:0x3A] = False
ALNUM_SEPARATORS[0x61:0x7B] = False
ALNUM_SEPARATORS[0x80:] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        inverse = np.uint64(pow(int(_R), -1, 1 << 64))
        for k, base in enumerate((_R, inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(33))
    h *= _M1
    h ^= h >> np.uint64(33)
    h *= _M2
    h ^= h >> np.uint64(33)
    return h


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null is an empty value."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer row is a range of its own."""
    n, row = len(offsets) - 1, 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end
        row = end


class Words:
    """The words of a run of documents: ``start``/``end`` in ``data``, ``first[i]:first[i+1]`` those of row i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        inside = ~separators[self.data]
        begin = np.zeros(n + 1, bool)
        begin[:n] = inside
        begin[1:n] &= ~inside[:-1]
        bounds = offsets[offsets < n]
        begin[bounds] = inside[bounds]
        finish = np.zeros(n + 1, bool)
        finish[1:] = inside
        finish[1:n] &= ~inside[1:]
        bounds = offsets[offsets > 0]
        finish[bounds] = inside[bounds - 1]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(finish)
        self.first = np.searchsorted(self.start, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, most: int | None = None) -> np.ndarray:
        """A 64-bit hash of the bytes of each word, or of its first ``most`` bytes."""
        stop = self.end if most is None else np.minimum(self.end, self.start + most)
        out = np.empty(len(self.start), np.uint64)
        at = 0
        while at < len(out):  # by blocks of words, so that the 64-bit temporaries stay small
            base = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.end, base + BLOCK_BYTES, "right")))
            block = self.data[base : self.end[to - 1]]
            power, inverse = _power_tables(len(block) + 1)
            total = np.zeros(len(block) + 1, np.uint64)
            np.cumsum((block.astype(np.uint64) + np.uint64(1)) * power[: len(block)], out=total[1:])
            start, end = self.start[at:to] - base, stop[at:to] - base
            out[at:to] = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * _K)
            at = to
        return out

    def left(self) -> np.ndarray:
        """How many words of its row there are from each word on, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.start))


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` consecutive hashes from each position; the last ``width - 1`` positions have none."""
    n = max(0, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= _K
        out += h[k : k + n]
    return mix(out + np.uint64(width))


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values[first[i]:first[i+1]]``; an empty range sums to 0."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind in "fu" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def covered(starts: np.ndarray, width: int | np.ndarray, n: int) -> np.ndarray:
    """Mask of the n positions that lie in one of the intervals [start, start + width)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge[:n]) > 0
