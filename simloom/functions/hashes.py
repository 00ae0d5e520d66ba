"""MD5 of many short messages at once."""

from __future__ import annotations

import math

import numpy as np

_CONSTANTS = [np.uint32(int(abs(math.sin(k + 1)) * 2**32)) for k in range(64)]
_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_WORDS = [k if k < 16 else (5 * k + 1) % 16 if k < 32 else (3 * k + 5) % 16 if k < 48 else 7 * k % 16 for k in range(64)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
#: Messages hashed at a time.
SLICE = 65_536


def _first_word(words: dict[int, np.ndarray], n: int) -> np.ndarray:
    """The first 32 bits, as the hash is printed, of ``n`` messages of one block; ``words`` has those of the block's 16 words that aren't 0."""
    a, b, c, d = (np.full(n, x) for x in _START)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for k in range(64):
        if k < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif k < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif k < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        f += a
        f += _CONSTANTS[k]
        if _WORDS[k] in words:
            f += words[_WORDS[k]]
        np.left_shift(f, np.uint32(_SHIFTS[k]), out=g)
        np.right_shift(f, np.uint32(32 - _SHIFTS[k]), out=f)
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    a += _START[0]
    return a.byteswap()


def _blocks(texts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(t.ljust(64, b"\0") for t in texts), "<u4").reshape(len(texts), 16).astype(np.uint32)


def pair_hashes(seed: int, i: np.ndarray, j: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The first 32 bits of the MD5 of ``seed|i|j`` for the pairs ``(i[rows], j[columns])``, in the order of the printed hash.

    A message is two parts that are or-ed together: one for each ``i``, one for each ``j`` and place where it begins.
    """
    out = np.empty(len(rows), np.uint32)
    first = [f"{seed}|{x}|".encode() for x in i.tolist()]
    second = [str(x).encode() for x in j.tolist()]
    length = np.array([len(x) for x in first], np.int64)
    left = _blocks(first)
    for start in np.unique(length[rows]).tolist():
        if start + max(map(len, second), default=0) > 55:
            raise ValueError("a message of more than one block")
        right = _blocks([b"\0" * start + x + b"\x80" for x in second])
        right[:, 14] = [8 * (start + len(x)) for x in second]
        used = np.flatnonzero(left.any(axis=0) | right.any(axis=0)).tolist()
        own = np.flatnonzero(length[rows] == start)
        for at in range(0, len(own), SLICE):
            part = own[at : at + SLICE]
            x, y = rows[part], columns[part]
            out[part] = _first_word({w: left[x, w] | right[y, w] for w in used}, len(part))
    return out
