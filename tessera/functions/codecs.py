"""Block codecs."""

from __future__ import annotations

import bz2
import struct
import zlib
from collections.abc import Callable

LEVELS = {"none": None, "gzip": (0, 9), "zstd": (1, 22), "lz4": None, "bzip2": (1, 9)}
DEFAULTS = {"gzip": 6, "zstd": 3, "bzip2": 9}


def check_level(codec: str, level: int) -> int:
    """The level to use; -1 is the default, other negative or unknown levels are errors."""
    if codec not in LEVELS:
        raise ValueError(f"unknown codec: {codec}")
    if level == -1:
        return DEFAULTS.get(codec, 0)
    bounds = LEVELS[codec]
    if bounds is None or not bounds[0] <= level <= bounds[1]:
        raise ValueError(f"level {level} isn't valid for {codec}")
    return level


def compress(data: bytes, codec: str = "zstd", level: int = -1) -> bytes:
    return compressor(codec, level)(data)


def compressor(codec: str, level: int = -1) -> Callable[[bytes], bytes]:
    """A function for many values: what a codec allocates, it allocates once."""
    level = check_level(codec, level)
    if codec == "none":
        return lambda data: data
    if codec == "gzip":
        return lambda data: _gzip(data, level)
    if codec == "bzip2":
        return lambda data: bz2.compress(data, level)
    if codec == "lz4":
        import pyarrow as pa

        raw = pa.Codec("lz4_raw")
        return lambda data: struct.pack("<I", len(data)) + (raw.compress(data, asbytes=True) if data else b"")
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress


def _gzip(data: bytes, level: int) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def decompress(data: bytes, codec: str, raw_size: int) -> bytes:
    """The raw bytes; a raw size of 0 means there are none."""
    if raw_size == 0:
        return b""
    if codec == "none":
        out = data
    elif codec == "gzip":
        try:
            out = zlib.decompress(data, 31)
        except zlib.error:
            out = zlib.decompress(data, 15)
    elif codec == "bzip2":
        out = bz2.decompress(data)
    elif codec == "lz4":
        import pyarrow as pa

        (size,) = struct.unpack_from("<I", data)
        out = pa.Codec("lz4_raw").decompress(data[4:], size, asbytes=True)
    elif codec == "zstd":
        import zstandard

        out = zstandard.ZstdDecompressor().decompress(data, max_output_size=raw_size)
    else:
        raise ValueError(f"unknown codec: {codec}")
    if len(out) != raw_size:
        raise ValueError(f"block has {len(out)} bytes, not {raw_size}")
    return out
