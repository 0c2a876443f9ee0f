"""The binary sidecar of an archive: header, archive name, section directory, aligned sections."""

from __future__ import annotations

import os
import struct
import time
from dataclasses import dataclass, field

import numpy as np

from ..functions.enums import SidecarType

MAGIC, VERSION = 0x4D414900, 1
HEADER = struct.Struct("<IBBBBQIIQQ24x")
SECTION = struct.Struct("<IIQQ")


@dataclass
class Sidecar:
    kind: SidecarType
    archive_name: str
    archive_hash: int
    timestamp: int = 0
    align_log2: int = 0
    sections: dict[int, bytes] = field(default_factory=dict)


def write_sidecar(path: str, s: Sidecar) -> None:
    name = os.path.basename(s.archive_name.replace("\\", "/")).encode()
    step = 1 << s.align_log2
    at = HEADER.size + len(name) + 4 + SECTION.size * len(s.sections)
    directory, body, first = b"", b"", 0
    for kind, data in s.sections.items():
        pad = -at % step
        body += b"\0" * pad + data
        at += pad
        first = first or at
        directory += SECTION.pack(kind, 0, at, len(data))
        at += len(data)
    head = HEADER.pack(MAGIC, VERSION, s.kind, s.align_log2, 0, s.archive_hash, len(name), 0, s.timestamp or int(time.time()), first)
    with open(f"{path}.part", "wb") as f:
        f.write(head + name + struct.pack("<I", len(s.sections)) + directory + body)
    os.replace(f"{path}.part", path)


def read_sidecar(path: str) -> Sidecar | None:
    """None if the file is absent or no sidecar."""
    try:
        with open(path, "rb") as f:
            data = f.read()
    except OSError:
        return None
    if len(data) < HEADER.size:
        return None
    magic, _, kind, align, _, digest, size, _, stamp, _ = HEADER.unpack_from(data)
    if magic != MAGIC:
        return None
    at = HEADER.size + size
    name = data[HEADER.size : at].decode("utf-8", "replace")
    (n,) = struct.unpack_from("<I", data, at)
    out = Sidecar(SidecarType(kind), name, digest, stamp, align)
    for i in range(n):
        k, _, lo, length = SECTION.unpack_from(data, at + 4 + i * SECTION.size)
        out.sections[k] = data[lo : lo + length]
    return out


def pack_sketches(num_hashes: int, bit_width: int, seed: int, rows: np.ndarray) -> bytes:
    return struct.pack("<IBQ", num_hashes, bit_width, seed) + rows.astype(f"<u{bit_width // 8}").tobytes()


def unpack_sketches(data: bytes) -> tuple[int, int, int, np.ndarray]:
    n, width, seed = struct.unpack_from("<IBQ", data)
    rows = np.frombuffer(data, f"<u{width // 8}", offset=13).reshape(-1, n)
    return n, width, seed, rows.astype(np.uint64).view(np.int64)


def archive_digest(path: str) -> int:
    """The 64-bit hash of a whole file."""
    from ..functions.hashing import h64

    with open(path, "rb") as f:
        return int(h64([f.read()])[0])
