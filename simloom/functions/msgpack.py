"""Reading MessagePack, the binary form of metadata in recordings, after its public specification."""

from __future__ import annotations

import struct

_FIXED = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
_SIZED = {0xC4: ("bin", ">B"), 0xC5: ("bin", ">H"), 0xC6: ("bin", ">I"), 0xD9: ("str", ">B"), 0xDA: ("str", ">H"), 0xDB: ("str", ">I"), 0xDC: ("list", ">H"), 0xDD: ("list", ">I"), 0xDE: ("map", ">H"), 0xDF: ("map", ">I")}


def unpack(raw: bytes):
    """The one value that ``raw`` holds; an error if it is cut short or more follows. Extension types are not known."""
    value, end = _value(raw, 0)
    if end != len(raw):
        raise ValueError("bytes after the value")
    return value


def _number(raw: bytes, at: int, kind: str):
    size = struct.calcsize(kind)
    if at + size > len(raw):
        raise ValueError("cut short")
    return struct.unpack_from(kind, raw, at)[0], at + size


def _value(raw: bytes, at: int):
    tag, at = _number(raw, at, ">B")
    if tag <= 0x7F:
        return tag, at
    if tag >= 0xE0:
        return tag - 0x100, at
    if tag in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[tag], at
    if tag in _FIXED:
        return _number(raw, at, _FIXED[tag])
    if tag in _SIZED:
        kind, size = _SIZED[tag][0], _SIZED[tag][1]
        n, at = _number(raw, at, size)
    elif tag <= 0x8F:
        kind, n = "map", tag & 0x0F
    elif tag <= 0x9F:
        kind, n = "list", tag & 0x0F
    elif 0xA0 <= tag <= 0xBF:
        kind, n = "str", tag & 0x1F
    else:
        raise ValueError(f"unknown type {tag:#x}")
    if kind in ("bin", "str"):
        if at + n > len(raw):
            raise ValueError("cut short")
        part = raw[at : at + n]
        return part.decode() if kind == "str" else part, at + n
    found = []
    for _ in range(n * (2 if kind == "map" else 1)):
        x, at = _value(raw, at)
        found.append(x)
    return (dict(zip(found[::2], found[1::2])) if kind == "map" else found), at
