"""Words and hashed word windows of UTF-8 texts, computed on whole byte arrays.

Two word definitions are in use, both after lower-casing A-Z only:

* ``SPACED``: runs of bytes other than space and 0x09-0x0D;
* ``ALNUM``: runs of 0-9, a-z and bytes above 0x7F.

A word's hash is a polynomial of its bytes modulo 2**64, taken from a running sum over many
bytes, then mixed. A window's hash combines the hashes of its words in order.
"""

from __future__ import annotations

import numpy as np

_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 0x20, _BYTES).astype(np.uint8)
SPACED = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x41) & (_BYTES <= 0x5A)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)

_BASE = 0x9E3779B97F4A7C15 | 5
_STEP = np.uint64(0xD1342543DE82EF95)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n + 1:
        size = 1 << max(16, int(n).bit_length())
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and for each text the place of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = kind[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offsets)


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: int = 1 << 18) -> np.ndarray:
    """The hash of each run of bytes from ``starts`` to ``ends``, both in rising order.

    Bytes are summed up piece by piece, so that a very long text takes no more memory than a piece,
    or than its longest word.
    """
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, base + piece, "right")))
        size = int(ends[to - 1]) - base
        up, down = _power(size)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum((LOWER[data[base : base + size]].astype(np.uint64) + np.uint64(1)) * up[:size], out=sums[1:])
        first, last = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mix((sums[last] - sums[first]) * down[first])
        at = to
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and for each text the place of its first word."""
    starts, ends, first = spans(data, offsets, kind)
    return hashed(data, starts, ends), first


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of ``width`` words, across texts too."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = hashes[:n].copy()
    for k in range(1, width):
        h *= _STEP
        h += hashes[k : k + n]
    return mix(h + np.uint64(width))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``width``-word shingles of each text.

    A text of fewer words has its whole word sequence as its only shingle; one without words none.
    """
    hashes, first = word_hashes(data, offsets)
    every = window_hashes(hashes, width)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            x = every[a : b - width + 1].copy()
            x.sort()
            keep = np.empty(len(x), bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            out.append(x[keep])
        elif b > a:
            out.append(window_hashes(hashes[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
