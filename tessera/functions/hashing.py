"""Hash and checksum kernels that Spark lacks, over batches of byte strings.

Each kernel advances all rows of a batch together, one stripe or word at a time, in numpy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np

U64 = np.uint64
P1, P2, P3 = U64(0x9E3779B185EBCA87), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)


def rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U64(n)) | (x >> U64(64 - n))


def avalanche(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(33))
    h = h * P2
    h = h ^ (h >> U64(29))
    h = h * P3
    return h ^ (h >> U64(32))


def _padded(data: Sequence[bytes], multiple: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(zero-padded bytes end to end, first unit and number of units of each row)."""
    units = np.array([-(-len(d) // multiple) for d in data], np.int64)
    first = np.concatenate([[0], np.cumsum(units)])[:-1]
    return np.frombuffer(b"".join(d + b"\0" * (-len(d) % multiple) for d in data), np.uint8), first, units


def h64(data: Sequence[bytes], seed: int = 0) -> np.ndarray:
    """Four-lane 64-bit hash over 32-byte stripes; the last stripe is filled with zeros."""
    with np.errstate(over="ignore"):
        flat, first, units = _padded(data, 32)
        words = flat.view("<u8").reshape(-1, 4)
        s = U64(seed)
        lanes = np.tile(np.array([s + P1 + P2, s + P2, s, s - P1], U64), (len(data), 1))
        order = np.argsort(-units, kind="stable")
        ordered = units[order]
        for k in range(int(units.max()) if len(units) else 0):
            live = order[: np.searchsorted(-ordered, -k, "left")]
            lanes[live] = rotl(lanes[live] + words[first[live] + k] * P2, 31) * P1
        size = np.array([len(d) for d in data], U64)
        return avalanche(size + rotl(lanes[:, 0], 1) + rotl(lanes[:, 1], 7) + rotl(lanes[:, 2], 12) + rotl(lanes[:, 3], 18))


def h64_words(words: np.ndarray, seed: int) -> np.ndarray:
    """h64 of 8-byte inputs given as little-endian words: only the first lane depends on the data."""
    with np.errstate(over="ignore"):
        s = U64(seed)
        rest = rotl(rotl(np.array([s + P2], U64), 31) * P1, 7) + rotl(rotl(np.array([s], U64), 31) * P1, 12) + rotl(rotl(np.array([s - P1], U64), 31) * P1, 18)
        lane = rotl(s + P1 + P2 + words * P2, 31) * P1
        return avalanche(U64(8) + rotl(lane, 1) + rest)


def _crc_tables() -> np.ndarray:
    t = np.zeros((8, 256), np.uint32)
    for i in range(256):
        c = i
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        t[0, i] = c
    for k in range(1, 8):
        t[k] = (t[k - 1] >> np.uint32(8)) ^ t[0][t[k - 1] & np.uint32(255)]
    return t


_CRC = _crc_tables()


def crc32c(data: Sequence[bytes]) -> np.ndarray:
    """Castagnoli CRC, eight bytes of every row at a time."""
    size = np.array([len(d) for d in data], np.int64)
    flat, first, units = _padded(data, 8)
    rows = flat.reshape(-1, 8)
    crc = np.full(len(data), 0xFFFFFFFF, np.uint32)
    whole = size // 8
    order = np.argsort(-whole, kind="stable")
    ordered = whole[order]
    for k in range(int(whole.max()) if len(whole) else 0):
        live = order[: np.searchsorted(-ordered, -k, "left")]
        b = rows[first[live] + k].copy()
        b[:, :4] ^= crc[live].astype("<u4").view(np.uint8).reshape(-1, 4)
        out = _CRC[7][b[:, 0]]
        for j in range(1, 8):
            out = out ^ _CRC[7 - j][b[:, j]]
        crc[live] = out
    for j in range(7):
        live = np.flatnonzero(size % 8 > j)
        b = rows[first[live] + whole[live], j]
        crc[live] = (crc[live] >> np.uint32(8)) ^ _CRC[0][(crc[live] ^ b) & np.uint32(255)]
    return crc ^ np.uint32(0xFFFFFFFF)


def xxh32(data: Sequence[bytes]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh32_intdigest(d, 0) for d in data], np.uint32)


def blake3_available() -> bool:
    try:
        import blake3  # noqa: F401
    except ImportError:
        return False
    return True


def blake3(data: Sequence[bytes]) -> list[bytes]:
    if not blake3_available():
        raise RuntimeError("blake3 is not installed")
    import blake3 as b

    return [b.blake3(d).digest() for d in data]


def file_hash(data: Sequence[bytes], algo: str = "sha256") -> list[bytes]:
    """32-byte digests: SHA-256, BLAKE3, or the 64-bit hash four times."""
    if algo == "sha256":
        return [hashlib.sha256(d).digest() for d in data]
    if algo == "blake3":
        return blake3(data)
    if algo == "h64":
        return [int(h).to_bytes(8, "little") * 4 for h in h64(data)]
    raise ValueError(f"unknown file hash: {algo}")


def checksum(data: Sequence[bytes], kind: str) -> np.ndarray:
    """32-bit block checksums as int64; kind is an enums.Checksum name in lower case."""
    if kind == "none":
        return np.zeros(len(data), np.int64)
    if kind == "h64":
        return (h64(data) & U64(0xFFFFFFFF)).astype(np.int64)
    if kind == "crc32c":
        return crc32c(data).astype(np.int64)
    if kind == "xxh32":
        return xxh32(data).astype(np.int64)
    if kind == "blake3":
        return np.array([int.from_bytes(d[:4], "little") for d in blake3(data)], np.int64)
    raise ValueError(f"unknown checksum: {kind}")


def available_checksums() -> list[str]:
    return ["none", "xxh32", "crc32c", "h64", *(["blake3"] if blake3_available() else [])]
