"""Codes and labels of the archive model, and parsing of option spellings."""

from __future__ import annotations

from enum import IntEnum, IntFlag

from pyspark.sql import Column
from pyspark.sql import functions as F


class Codec(IntEnum):
    NONE, GZIP, ZSTD, LZ4, BZIP2 = range(5)


class Checksum(IntEnum):
    NONE, BLAKE3, XXH32, CRC32C, H64 = range(5)


class FileHash(IntEnum):
    SHA256, BLAKE3, H64 = 1, 2, 3


class IndexType(IntEnum):
    MULTIBLOCK, SINGLE_FILE = 0, 1


class EntryType(IntEnum):
    FILE, DIR, SYMLINK, CHAR, BLOCK, FIFO, SOCKET = range(7)
    UNKNOWN = 255


class NameFormat(IntEnum):
    FRONT_CODED, RAW, TRIE = range(3)


class EntryFlag(IntFlag):
    REDACTED, STRONG_HASH, SHARED_SPANS = 1, 2, 4


class SidecarType(IntEnum):
    VECTOR, MINHASH, GENERIC = 1, 2, 3


class EmbeddingType(IntEnum):
    FLOAT32, FLOAT16, INT8 = range(3)


#: The kinds of entries an archive stores; devices, pipes and sockets are left out.
STORED = ("file", "dir", "symlink")
_CHECKSUM_NAMES = {"none": Checksum.NONE, "off": Checksum.NONE, "blake3": Checksum.BLAKE3, "xxhash32": Checksum.XXH32, "xxh32": Checksum.XXH32, "crc32c": Checksum.CRC32C, "crc": Checksum.CRC32C, "xxhash3": Checksum.H64, "xxh3": Checksum.H64, "h64": Checksum.H64}


def parse_codec(name: str) -> Codec:
    """Case is ignored."""
    try:
        return Codec[name.upper()]
    except KeyError:
        raise ValueError(f"unknown codec: {name}") from None


def parse_checksum(name: str) -> Checksum:
    """Case matters, aliases are allowed."""
    if name not in _CHECKSUM_NAMES:
        raise ValueError(f"unknown checksum: {name}")
    return _CHECKSUM_NAMES[name]


def label(code: Column, kind: type[IntEnum]) -> Column:
    """The lower-case name of a code; ``unknown`` for others."""
    out = F.lit("unknown")
    for member in kind:
        out = F.when(code == int(member), F.lit(member.name.lower())).otherwise(out)
    return out
