"""Windows of symbols grouped by the lowest-hashed gram in them."""

from __future__ import annotations

import numpy as np

from .hashing import Spans

#: Bytes of the gram that anchors a window.
GRAM = 48
_PLACE = 24
_PLACES = np.uint64((1 << _PLACE) - 1)
_CHUNK = 8 << 20


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from running minima of blocks both ways."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int = GRAM, hashed: type[Spans] = Spans) -> tuple[np.ndarray, ...]:
    """Runs of windows of ``length`` symbols with one anchor: (row, first start, last start, anchor, gram, hash).

    A window's anchor is the gram in it with the lowest hash, the first of equal ones, so equal windows have
    equal anchors at equal places. Places count in ``data``; the hash is that of all symbols of the run.
    Symbols are bytes, or others of which ``hashed`` makes the hashes of spans.
    """
    parts = []
    width = length - gram + 1
    for at in range(0, max(1, len(data) - length + 1), _CHUNK):
        piece = data[at:at + _CHUNK + length - 1]
        if len(piece) < length:
            break
        spans = hashed(piece)
        start = np.arange(len(piece) - gram + 1)
        grams = spans.hash(start, start + gram)
        anchor = (_lowest((grams & ~_PLACES) | start.astype(np.uint64), width) & _PLACES).astype(np.int64)
        first = np.arange(len(anchor))
        row = np.searchsorted(offsets, first + at, "right") - 1
        valid = first + at + length <= offsets[row + 1]
        first, row, anchor = first[valid], row[valid], anchor[valid]
        if not len(first):
            continue
        new = np.ones(len(first), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(first)) - 1
        lo, hi, a = first[begin], first[last], anchor[begin]
        parts.append((row[begin], lo + at, hi + at, a + at, grams[a], spans.hash(lo, hi + length)))
    if not parts:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
