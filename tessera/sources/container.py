"""The binary container: fixed header, metadata sections, aligned blocks.

Metadata is small and parsed where it is needed; block payloads are only read by the tasks that own them.
"""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass, field

import numpy as np

from ..functions import codecs, hashing
from ..functions.enums import Checksum, Codec, EntryType, FileHash, IndexType, NameFormat
from . import nametable
from .nametable import FormatError

MAGIC, VERSION = 0x2052414D, (0, 1, 1)
HEADER = struct.Struct("<IBBBBQQQQBBHI")
SECTION = struct.Struct("<IIQQQ")
BLOCK = struct.Struct("<QQBBHIII")
NAMES, FILES, SPANS, BLOCKS, POSIX, LINKS, XATTRS, HASHES = 1, 2, 3, 4, 10, 11, 12, 13

FILE_ROW = np.dtype([("name_id", "<u4"), ("entry_type", "u1"), ("reserved", "u1"), ("flags", "<u2"), ("size", "<u8")])
SPAN_ROW = np.dtype([("block_id", "<u4"), ("offset", "<u4"), ("length", "<u4"), ("sequence", "<u4")])
BLOCK_ROW = np.dtype([("offset", "<u8"), ("raw", "<u8"), ("stored", "<u8")])
POSIX_ROW = np.dtype([("uid", "<u4"), ("gid", "<u4"), ("mode", "<u4"), ("mtime", "<i8"), ("atime", "<i8"), ("ctime", "<i8")])


@dataclass
class Header:
    header_size: int = 48
    meta_offset: int = 48
    meta_stored: int = 0
    meta_raw: int = 0
    meta_codec: str = "none"
    index_type: IndexType = IndexType.MULTIBLOCK
    align_log2: int = 6
    version: tuple[int, int, int] = VERSION
    crc: int = 0

    def pack(self) -> bytes:
        body = HEADER.pack(MAGIC, *self.version, self.align_log2, self.header_size, self.meta_offset, self.meta_stored, self.meta_raw, self.meta_codec == "zstd", self.index_type, 0, 0)[:44]
        return body + struct.pack("<I", int(hashing.crc32c([body])[0]))

    @staticmethod
    def parse(data: bytes) -> Header:
        if len(data) < HEADER.size:
            raise FormatError("file is too short")
        magic, a, b, c, align, size, at, stored, raw, codec, index, reserved, crc = HEADER.unpack(data[: HEADER.size])
        if magic != MAGIC:
            raise FormatError("not an archive")
        if a != VERSION[0]:
            raise FormatError(f"unsupported major version {a}")
        if size < HEADER.size or reserved or codec > 1 or index > 1:
            raise FormatError("invalid header")
        if crc and crc != int(hashing.crc32c([data[:44]])[0]):
            raise FormatError("header checksum mismatch")
        return Header(size, at, stored, raw, "zstd" if codec else "none", IndexType(index), align, (a, b, c), crc)


@dataclass
class Metadata:
    """Row-aligned metadata columns of one archive."""

    header: Header
    names: list[bytes]
    files: np.ndarray
    starts: np.ndarray
    counts: np.ndarray
    spans: np.ndarray
    blocks: np.ndarray
    posix: np.ndarray | None = None
    links: list[bytes | None] | None = None
    hashes: list[bytes | None] | None = None
    hash_algo: FileHash | None = None
    xattrs: list[list[tuple[str, bytes]]] | None = None
    name_format: NameFormat = NameFormat.RAW
    sections: dict[int, int] = field(default_factory=dict)


def _rows(data: bytes, kind: np.dtype, at: int, n: int) -> np.ndarray:
    if n < 0 or len(data) < at + n * kind.itemsize:
        raise FormatError("section is cut short")
    return np.frombuffer(data, kind, n, at)


def _count(data: bytes, at: int = 0) -> int:
    return int(_rows(data, np.dtype("<u4"), at, 1)[0])


def _bits(data: bytes, at: int, n: int) -> np.ndarray:
    raw = _rows(data, np.dtype("u1"), at, (n + 7) // 8)
    return np.unpackbits(raw, bitorder="little")[:n].astype(bool)


def _pack_bits(flags: list[bool]) -> bytes:
    return np.packbits(np.array(flags, bool), bitorder="little").tobytes()


def read_table(data: bytes, kind: np.dtype) -> np.ndarray:
    return _rows(data, kind, 4, _count(data))


def write_table(rows: np.ndarray) -> bytes:
    return struct.pack("<I", len(rows)) + rows.tobytes()


def read_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, total, u4 = _count(data), _count(data, 4), np.dtype("<u4")
    return _rows(data, u4, 8, n), _rows(data, u4, 8 + 4 * n, n), _rows(data, SPAN_ROW, 8 + 8 * n, total)


def write_spans(counts: np.ndarray, spans: np.ndarray) -> bytes:
    counts = counts.astype("<u4")
    starts = (np.cumsum(counts) - counts).astype("<u4")
    return struct.pack("<II", len(counts), len(spans)) + starts.tobytes() + counts.tobytes() + spans.tobytes()


def read_links(data: bytes, n: int) -> list[bytes | None]:
    has, at, out = _bits(data, 4, n), 4 + (n + 7) // 8, []
    for h in has:
        if not h:
            out.append(None)
            continue
        size = _count(data, at)
        out.append(_rows(data, np.dtype("u1"), at + 4, size).tobytes())
        at += 4 + size
    return out


def write_links(links: list[bytes | None]) -> bytes:
    return struct.pack("<I", len(links)) + _pack_bits([x is not None for x in links]) + b"".join(struct.pack("<I", len(x)) + x for x in links if x is not None)


def read_hashes(data: bytes, n: int) -> tuple[FileHash, list[bytes | None]]:
    if _count(data) != n:
        raise FormatError("hash count differs from file count")
    algo, size = _rows(data, np.dtype("u1"), 4, 2)
    if size != 32:
        raise FormatError("unsupported hash length")
    has, at, out = _bits(data, 8, n), 8 + (n + 7) // 8, []
    for h in has:
        out.append(_rows(data, np.dtype("u1"), at, 32).tobytes() if h else None)
        at += 32 * int(h)
    return FileHash(int(algo)), out


def write_hashes(algo: FileHash, hashes: list[bytes | None]) -> bytes:
    return struct.pack("<IBBH", len(hashes), algo, 32, 0) + _pack_bits([x is not None for x in hashes]) + b"".join(x for x in hashes if x is not None)


def read_xattrs(data: bytes, n: int) -> list[list[tuple[str, bytes]]]:
    at, out = 4, []
    for _ in range(min(n, _count(data))):
        own, at, k = [], at + 4, _count(data, at)
        for _ in range(k):
            klen = int(_rows(data, np.dtype("<u2"), at, 1)[0])
            vlen = _count(data, at + 2)
            body = _rows(data, np.dtype("u1"), at + 6, klen + vlen).tobytes()
            own.append((body[:klen].decode("utf-8", "replace"), body[klen:]))
            at += 6 + klen + vlen
        out.append(own)
    return out + [[] for _ in range(n - len(out))]


def write_xattrs(xattrs: list[list[tuple[str, bytes]]]) -> bytes:
    out = [struct.pack("<I", len(xattrs))]
    for own in xattrs:
        out.append(struct.pack("<I", len(own)))
        out += [struct.pack("<HI", len(k.encode()), len(v)) + k.encode() + v for k, v in own]
    return b"".join(out)


def pack_meta(m: Metadata) -> bytes:
    parts: list[tuple[int, int, bytes]] = [(NAMES, int(m.name_format), nametable.encode(m.names, m.name_format)), (FILES, 0, write_table(m.files))]
    if m.header.index_type == IndexType.MULTIBLOCK:
        parts.append((SPANS, 0, write_spans(m.counts, m.spans)))
    if len(m.blocks):
        parts.append((BLOCKS, 0, write_table(m.blocks)))
    if m.posix is not None:
        parts.append((POSIX, 0, write_table(m.posix)))
    if m.links and any(x is not None for x in m.links):
        parts.append((LINKS, 0, write_links(m.links)))
    if m.xattrs and any(m.xattrs):
        parts.append((XATTRS, 0, write_xattrs(m.xattrs)))
    if m.hashes is not None:
        parts.append((HASHES, 0, write_hashes(m.hash_algo or FileHash.SHA256, m.hashes)))
    at, head = 8 + SECTION.size * len(parts), struct.pack("<II", len(parts), 0)
    for kind, flags, data in parts:
        head += SECTION.pack(kind, flags, at, len(data), 0)
        at += len(data)
    return head + b"".join(p[2] for p in parts)


def parse_meta(header: Header, meta: bytes) -> Metadata:
    found: dict[int, tuple[int, bytes]] = {}
    for i in range(_count(meta)):
        if 8 + (i + 1) * SECTION.size > len(meta):
            raise FormatError("section directory is cut short")
        kind, flags, at, stored, raw = SECTION.unpack_from(meta, 8 + i * SECTION.size)
        if at + stored > len(meta):
            raise FormatError("section lies outside the metadata")
        found[kind] = (flags, codecs.decompress(meta[at : at + stored], "zstd", raw) if raw else meta[at : at + stored])  # the last of a kind counts
    if NAMES not in found or FILES not in found:
        raise FormatError("names or files are missing")
    kind = NameFormat(found[NAMES][0])
    names, files = nametable.decode(found[NAMES][1], kind), read_table(found[FILES][1], FILE_ROW)
    n = len(files)
    if header.index_type == IndexType.MULTIBLOCK:
        if SPANS not in found:
            raise FormatError("spans are missing")
        starts, counts, spans = read_spans(found[SPANS][1])
    else:
        is_file = files["entry_type"] == EntryType.FILE
        counts = is_file.astype("<u4")
        starts = (np.cumsum(counts) - counts).astype("<u4")
        spans = np.zeros(int(counts.sum()), SPAN_ROW)
        spans["block_id"], spans["length"] = np.arange(len(spans)), files["size"][is_file]
    m = Metadata(header, names, files, starts, counts, spans, read_table(found[BLOCKS][1], BLOCK_ROW) if BLOCKS in found else np.zeros(0, BLOCK_ROW), name_format=kind, sections={k: len(v[1]) for k, v in found.items()})
    if POSIX in found:
        m.posix = read_table(found[POSIX][1], POSIX_ROW)
    if LINKS in found:
        m.links = read_links(found[LINKS][1], n)
    if XATTRS in found:
        m.xattrs = read_xattrs(found[XATTRS][1], n)
    if HASHES in found:
        m.hash_algo, m.hashes = read_hashes(found[HASHES][1], n)
    return m


def open_container(path: str) -> Metadata:
    """Header and metadata; block offsets are recovered by walking the blocks if their table is missing."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        h = Header.parse(f.read(HEADER.size))
        if h.meta_offset + h.meta_stored > size:
            raise FormatError("metadata lies outside the file")
        f.seek(h.meta_offset)
        meta = f.read(h.meta_stored)
        m = parse_meta(h, codecs.decompress(meta, "zstd", h.meta_raw) if h.meta_codec == "zstd" else meta)
        if not len(m.blocks) and len(m.spans):
            wanted, at, rows, step = int(m.spans["block_id"].max()) + 1, h.header_size, [], 1 << h.align_log2
            while len(rows) < wanted:
                f.seek(at)
                head = f.read(BLOCK.size)
                if len(head) < BLOCK.size:
                    raise FormatError("blocks are cut short")
                raw, stored = BLOCK.unpack(head)[:2]
                rows.append((at, raw, stored))
                at += BLOCK.size + stored + -(BLOCK.size + stored) % step
            m.blocks = np.array(rows, BLOCK_ROW)
    return m


def read_block(f, offset: int, size: int) -> dict:
    """A block's header fields and stored payload."""
    if offset + BLOCK.size > size:
        raise FormatError("block lies outside the file")
    f.seek(offset)
    raw, stored, codec, kind, _, check, _, _ = BLOCK.unpack(f.read(BLOCK.size))
    if offset + BLOCK.size + stored > size:
        raise FormatError("block payload lies outside the file")
    return {"raw_size": raw, "stored_size": stored, "comp_algo": Codec(codec).name.lower(), "checksum_type": Checksum(kind).name.lower(), "checksum": check, "payload": f.read(stored)}


def write_container(path: str, m: Metadata, blocks, compress_meta: bool = True) -> None:
    """Write one container: ``blocks`` yields (raw_size, codec, checksum kind, checksum, payload) in id order.

    Room for the metadata is taken from its uncompressed size, so that it always fits before the first block.
    """
    step = 1 << m.header.align_log2
    m.blocks = np.zeros(int(m.spans["block_id"].max()) + 1 if len(m.spans) else 0, BLOCK_ROW)
    room = HEADER.size + len(pack_meta(m))
    at = m.header.header_size = room + -room % step
    part = f"{path}.part"
    with open(part, "wb") as f:
        rows = []
        for raw, codec, kind, check, payload in blocks:
            f.seek(at)
            f.write(BLOCK.pack(raw, len(payload), Codec[codec.upper()], Checksum[kind.upper()], 0, check, 0o644, 0) + payload)
            rows.append((at, raw, len(payload)))
            at += BLOCK.size + len(payload) + -(BLOCK.size + len(payload)) % step
        m.blocks = np.array(rows, BLOCK_ROW) if rows else np.zeros(0, BLOCK_ROW)
        meta = pack_meta(m)
        m.header.meta_codec, m.header.meta_raw, stored = "none", 0, meta
        if compress_meta and len(meta) > 256:
            small = codecs.compress(meta, "zstd")
            if len(small) < len(meta):
                stored, m.header.meta_codec, m.header.meta_raw = small, "zstd", len(meta)
        m.header.meta_offset, m.header.meta_stored = HEADER.size, len(stored)
        f.truncate(at)
        f.seek(0)
        f.write(m.header.pack() + stored)
    os.replace(part, path)
