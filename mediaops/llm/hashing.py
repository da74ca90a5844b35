"""Hashes of words and byte strings, for whole Arrow columns at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes worked on at a time: the arrays below take about 60 bytes for each.
SLICE_BYTES = 2 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_COMBINE = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and where each row begins; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batches, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut to about ``limit`` bytes of text each; a row is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pa.compute.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(lengths, dtype=np.int64) - lengths) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no pattern (the finalizer of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as they were needed yet."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE_BYTES + 1)
            up = np.full(size, _BASE, np.uint64)
            down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up[:n], self.down[:n]


_powers = _Powers()


class Spans:
    """Hash of any byte span of ``data`` in constant time, the same wherever the span lies."""

    def __init__(self, data: np.ndarray, lower: bool = False) -> None:
        up, self._down = _powers.to(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_LOWER if lower else _TABLE)[data] * up[:-1], out=self._sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self._sums[end] - self._sums[start]) * self._down[start]

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(np.uint64))


class Sequences(Spans):
    """Hash of any sequence of neighbours among 64-bit hashes."""

    def __init__(self, hashes: np.ndarray) -> None:
        up, self._down = _powers.to(len(hashes) + 1)
        self._sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[:-1], out=self._sums[1:])


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and each row's first word (with an end). Bytes ``between`` words: ``[\\x20\\x09-\\x0D]``."""
    space = between[data]
    first = ~space
    last = first.copy()
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    edge = np.zeros(len(data), bool)
    edge[begins] = True
    first[1:] &= space[:-1] | edge[1:]
    last[:-1] &= space[1:] | edge[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """Per row the sorted distinct hashes of its ``width``-word shingles, A-Z in lower case.

    Fewer words than ``width`` are one shingle, no words none.
    """
    start, end, rows = words(data, offsets)
    word = Spans(data, lower=True).hash(start, end)
    padded = np.concatenate([word, np.zeros(width, np.uint64)])
    total = np.zeros(len(word), np.uint64)
    for k in range(width):
        total += padded[k:k + len(word)] * _COMBINE[k % 5] * np.uint64(2 * (k // 5) + 1)
    total = mix(total)
    for a, b in zip(rows.tolist(), rows[1:].tolist(), strict=False):
        if b - a >= width:
            found = np.sort(total[a:b - width + 1])
            yield found[np.append(True, found[1:] != found[:-1])]
        elif b > a:
            short = np.uint64(b - a)
            for k in range(b - a):
                short = mix(short + word[a + k:a + k + 1] * _COMBINE[k % 5])[0]
            yield np.array([short], np.uint64)
        else:
            yield np.zeros(0, np.uint64)
