"""Counts of terms in texts, for operators that work on terms of whole documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import flat, in_slices
from .words import LOWER, hashed, spans

#: Bytes of text that are looked at together; a longer text is cut between terms.
PIECE = 1 << 21


def _pieces(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if len(offsets) > 2 or len(data) <= PIECE:
        yield data, offsets
        return
    at = 0
    while at < len(data):
        size = PIECE
        while at + size < len(data) and not (outside := np.flatnonzero(~kind[data[at : at + size]])).size:
            size *= 2
        end = len(data) if at + size >= len(data) else at + int(outside[-1]) + 1
        yield data[at:end], np.array([0, end - at])
        at = end


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The given runs of bytes as an Arrow column, A-Z lower-cased."""
    sizes = ends - starts
    edges = np.concatenate([[0], np.cumsum(sizes)])
    raw = LOWER[data[np.arange(edges[-1]) + np.repeat(starts - edges[:-1], sizes)]]
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])


def counted(batches, kind: np.ndarray, column: str = "text") -> Iterator[tuple]:
    """For slices of Arrow batches: ``(rows, text, hash, count, names)``.

    ``rows`` is the slice; for each different term of each of its texts there is the number of the text,
    the term's 64-bit hash and its occurrences. ``names``: hashes, rising, with the terms themselves. A
    text beyond ``PIECE`` bytes comes in several parts, all but the first without ``rows``.
    """
    for rows in in_slices(batches, PIECE, column):
        for data, offsets in _pieces(*flat(rows.column(rows.schema.get_field_index(column))), kind):
            starts, ends, first = spans(data, offsets, kind)
            values, at, place = np.unique(hashed(data, starts, ends), return_index=True, return_inverse=True)
            text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
            keys, counts = np.unique(text * max(1, len(values)) + place, return_counts=True)
            text, number = np.divmod(keys, max(1, len(values)))
            yield rows, text, values[number], counts, (values, strings(data, starts[at], ends[at]))
            rows = None


class Names:
    """Terms by their hashes, gathered from slices; two terms of one 64-bit hash would be one."""

    def __init__(self):
        self.hashes, self.names = [], []

    def add(self, names: tuple[np.ndarray, pa.Array]) -> None:
        self.hashes.append(names[0])
        self.names.append(names[1])
        if sum(map(len, self.hashes)) > 1 << 20 and len(self.hashes) > 8:
            hashes, strings = self.all()
            self.hashes, self.names = [hashes], [strings]

    def all(self) -> tuple[np.ndarray, pa.Array]:
        """All different hashes, rising, and their terms."""
        if not self.hashes:
            return np.zeros(0, np.uint64), pa.array([], pa.string())
        hashes, at = np.unique(np.concatenate(self.hashes), return_index=True)
        return hashes, pa.concat_arrays(self.names).take(pa.array(at))


def whole(parts: Iterator[tuple]) -> Iterator[tuple]:
    """What ``counted`` gives, the parts of a long text put together."""
    held: list[tuple] = []

    def joined():
        if len(held) == 1:
            return held[0]
        names = Names()
        for part in held:
            names.add(part[4])
        hashes, at = np.unique(np.concatenate([p[2] for p in held]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([p[3] for p in held]), len(hashes)).astype(np.int64)
        return held[0][0], np.zeros(len(hashes), np.int64), hashes, counts, names.all()

    for part in parts:
        if part[0] is not None and held:
            yield joined()
            held = []
        held.append(part)
    if held:
        yield joined()
