"""Byte encodings of a name list: raw, front-coded, and segment trie."""

from __future__ import annotations

import struct

from ..functions.enums import NameFormat

RESET = 16
TRIE_VERSION = 3


class FormatError(ValueError):
    """Bytes that are no valid archive."""


def _take(data: bytes, at: int, n: int) -> bytes:
    if n < 0 or at + n > len(data):
        raise FormatError("name table is cut short")
    return data[at : at + n]


def varint(n: int) -> bytes:
    out = bytearray()
    while True:
        low, n = n & 0x7F, n >> 7
        out.append(low | (0x80 if n else 0))
        if not n:
            return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = 0
    for k in range(5):
        b = _take(data, at + k, 1)[0]
        value |= (b & 0x7F) << (7 * k)
        if b < 0x80:
            return value, at + k + 1
    raise FormatError("varint is too long")


def shared(a: bytes, b: bytes) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def encode(names: list[bytes], kind: NameFormat) -> bytes:
    if kind == NameFormat.RAW:
        return struct.pack("<I", len(names)) + b"".join(struct.pack("<I", len(n)) + n for n in names)
    if kind == NameFormat.FRONT_CODED:
        parts, last = [struct.pack("<II", len(names), RESET)], b""
        for i, n in enumerate(names):
            keep = 0 if i % RESET == 0 else shared(last, n)
            if max(keep, len(n) - keep) > 0xFFFF:
                raise FormatError("name too long for front coding")
            parts.append(struct.pack("<HH", keep, len(n) - keep) + n[keep:])
            last = n
        return b"".join(parts)
    return _encode_trie(names)


def decode(data: bytes, kind: NameFormat) -> list[bytes]:
    if kind == NameFormat.TRIE:
        return _decode_trie(data)
    (count,) = struct.unpack("<I", _take(data, 0, 4))
    at, names, last = 4, [], b""
    if kind == NameFormat.FRONT_CODED:
        _take(data, 0, 8)
        at = 8
    for _ in range(count):
        if kind == NameFormat.RAW:
            (n,) = struct.unpack("<I", _take(data, at, 4))
            name, at = _take(data, at + 4, n), at + 4 + n
        else:
            keep, n = struct.unpack("<HH", _take(data, at, 4))
            name, at = last[:keep] * (keep <= len(last)) + _take(data, at + 4, n), at + 4 + n
            last = name
        names.append(name)
    return names


def trie_safe(names: list[bytes]) -> bool:
    """Whether a trie gives the names back: it can't hold empty segments or one name twice."""
    return len(set(names)) == len(names) and all(all(n.split(b"/")) for n in names)


def _encode_trie(names: list[bytes]) -> bytes:
    if not trie_safe(names):
        raise FormatError("a trie holds no empty segments and no name twice")
    root: dict = {}
    for i, name in enumerate(names):
        node = root
        for seg in name.split(b"/"):
            node = node.setdefault(seg, {})
        node[None] = i

    def emit(node: dict) -> bytes:
        kids = [(k, v) for k, v in node.items() if k is not None]
        widest = max([0, *(len(k) for k, _ in kids)])
        code = 0 if not 0 < widest <= 0xFFFF else (1 if widest <= 0xFF else 2)
        out = bytes([(None in node) | (bool(kids) << 1) | (code << 2)])
        if None in node:
            out += varint(node[None])
        if kids:
            out += varint(len(kids))
        for k, v in kids:
            size = varint(len(k)) if code == 0 else struct.pack("<B" if code == 1 else "<H", len(k))
            out += size + k + emit(v)
        return out

    body = emit(root)
    return bytes([TRIE_VERSION, 0]) + varint(len(body)) + body + varint(len(names))


def _decode_trie(data: bytes) -> list[bytes]:
    head = _take(data, 0, 4)
    if head[0] != TRIE_VERSION or head[1]:
        raise FormatError("unknown trie version or flags")
    size, at = read_varint(data, 2)
    body = _take(data, at, size)
    count, _ = read_varint(data, at + size)
    names: list[bytes] = [b""] * count

    def walk(at: int, path: bytes) -> int:
        kind = _take(body, at, 1)[0]
        at += 1
        if kind & 1:
            i, at = read_varint(body, at)
            if i < count:
                names[i] = path
        if kind & 2:
            n, at = read_varint(body, at)
            code = kind >> 2 & 3
            for _ in range(n):
                if code in (0, 3):
                    size, at = read_varint(body, at)
                else:
                    size = int.from_bytes(_take(body, at, code), "little")
                    at += code
                label = _take(body, at, size)
                at = walk(at + size, path + b"/" + label if path else label)
        return at

    walk(0, b"")
    return names


def recommend(names: list[bytes]) -> NameFormat:
    """The encoding for a name list; a trie only where it is exact."""
    if len(names) < 100:
        return NameFormat.RAW
    raw = 4 + sum(4 + len(n) for n in names)
    front, last, trie, before = 8, b"", 8, []
    for i, n in enumerate(names):
        front += 4 + len(n) - (shared(last, n) if i % RESET else 0)
        seg = n.split(b"/")
        keep = 0
        while keep < min(len(seg), len(before)) and seg[keep] == before[keep]:
            keep += 1
        trie += sum(4 + len(s) for s in seg[keep:])
        last, before = n, seg
    if all(a <= b for a, b in zip(names, names[1:], strict=False)) and front <= 0.9 * raw:
        return NameFormat.FRONT_CODED
    if len(names) >= 5000 and trie < 0.5 * raw and front > 0.85 * raw and trie_safe(names):
        return NameFormat.TRIE
    return NameFormat.RAW
