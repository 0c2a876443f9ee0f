"""The kernels as Arrow-batched column functions.

Spark hands a worker up to 10,000 rows or 64 MB at once. Kernels take them in pieces and hand on each piece's results before the
next, so that a worker holds little besides the given batch, however large the table is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows and bytes of the first argument that a kernel takes at once; a longer value is a piece of its own.
ROWS, BYTES = 1024, 2 << 20


def pieces(columns: list) -> Iterator[list]:
    """Slices of Arrow arrays of one length: at most ``ROWS`` rows and ``BYTES`` of the first array, but a row at least."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(columns[0]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        before = int(ends[at - 1]) if at else 0
        n = min(max(int(np.searchsorted(ends, before + BYTES, "right")) - at, 1), ROWS)
        yield [c.slice(at, n) for c in columns]
        at += n


def piecewise(fn: Callable) -> Callable:
    """A function of Arrow batches that yields ``fn`` of one piece after the other: bytes of the first column, values of the others."""

    def run(batches):
        for batch in batches:
            columns = list(batch) if isinstance(batch, tuple) else [batch]
            for piece in pieces(columns):
                yield fn(_bytes(piece[0].to_pylist()), *[c.to_pylist() for c in piece[1:]])
            if not len(columns[0]):
                yield fn([], *[[] for _ in columns[1:]])

    return run


def kernel(fn: Callable, kind: str) -> Callable[..., Column]:
    """A column function of ``fn``, which makes an Arrow array of ``kind`` of every piece."""
    import pyarrow as pa

    def of(*columns: Column) -> Column:
        run = piecewise(fn)
        run.__annotations__ = {"batches": Iterator[pa.Array if len(columns) == 1 else tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, kind)(*columns)

    return of


def _bytes(s) -> list[bytes]:
    return [b"" if x is None else bytes(x) for x in s]


def block_checksum(content: Column, kind: str) -> Column:
    def run(s):
        import pyarrow as pa

        from . import hashing

        return pa.array(hashing.checksum(s, kind), pa.int64())

    return kernel(run, "long")(content)


def digest_h64(content: Column) -> Column:
    """Lower-case hex of the 64-bit hash."""

    def run(s):
        import pyarrow as pa

        from . import hashing

        return pa.array([f"{int(h):016x}" for h in hashing.h64(s)], pa.string())

    return kernel(run, "string")(content)


def file_hash(content: Column, algo: str) -> Column:
    """32-byte digests; SHA-256 stays in the JVM."""
    if algo == "sha256":
        return F.unhex(F.sha2(content, 256))

    def run(s):
        import pyarrow as pa

        from . import hashing

        return pa.array(hashing.file_hash(s, algo), pa.binary())

    return kernel(run, "binary")(content)


def compress(content: Column, codec: str, level: int = -1) -> Column:
    if codec == "none":
        return content

    def run(s):
        import pyarrow as pa

        from .codecs import compressor

        one = compressor(codec, level)
        return pa.array([one(x) for x in s], pa.binary())

    return kernel(run, "binary")(content)


def encoded(content: Column, codec: str, level: int, kind: str) -> Column:
    """struct(payload, checksum): encoding and checksum of the stored bytes in one pass."""

    def run(s):
        import pyarrow as pa

        from . import hashing
        from .codecs import compressor

        one = compressor(codec, level)
        data = [one(x) for x in s]
        return pa.StructArray.from_arrays([pa.array(data, pa.binary()), pa.array(hashing.checksum(data, kind), pa.int64())], ["payload", "checksum"])

    return kernel(run, "payload binary, checksum long")(content)


def _decode(payloads: list[bytes], codecs, sizes) -> list[bytes]:
    from .codecs import decompress as one

    return [one(x, k, int(m)) for x, k, m in zip(payloads, codecs, sizes, strict=True)]


def decompress(payload: Column, codec: Column, raw_size: Column) -> Column:
    """Decode stored blocks; the codec may differ by row."""

    def run(p, c, n):
        import pyarrow as pa

        return pa.array(_decode(p, c, n), pa.binary())

    return kernel(run, "binary")(payload, codec, raw_size)


def _mismatches(payloads: list[bytes], kinds, stored) -> list[bool]:
    """Whether each payload differs from its checksum; a stored 0 and type none never do."""
    from . import hashing

    out = [False] * len(payloads)
    for kind in set(kinds) - {"none"}:
        at = [i for i, (k, c) in enumerate(zip(kinds, stored, strict=True)) if k == kind and c]
        if at:
            for i, c in zip(at, hashing.checksum([payloads[i] for i in at], kind), strict=True):
                out[i] = int(c) != int(stored[i])
    return out


def verified_decode(payload: Column, codec: Column, raw_size: Column, kind: Column, stored: Column) -> Column:
    """Raw bytes of blocks, after verifying their checksums over the stored bytes; a mismatch is an error."""

    def run(p, c, n, k, s):
        import pyarrow as pa

        if any(_mismatches(p, k, s)):
            raise ValueError("block checksum mismatch")
        return pa.array(_decode(p, c, n), pa.binary())

    return kernel(run, "binary")(payload, codec, raw_size, kind, stored)


def block_fault(payload: Column, codec: Column, raw_size: Column, kind: Column, stored: Column) -> Column:
    """``checksum`` for a mismatch, ``undecodable`` for an encoded block without checksum that doesn't decode, else null."""

    def run(p, c, n, kinds, sums):
        import pyarrow as pa

        from .codecs import decompress as one

        out: list[str | None] = ["checksum" if x else None for x in _mismatches(p, kinds, sums)]
        for i, (x, y, m) in enumerate(zip(p, c, n, strict=True)):
            if (kinds[i] == "none" or not sums[i]) and y != "none" and m > 0:
                try:
                    one(x, y, int(m))
                except Exception:  # any decoder error means the same here
                    out[i] = "undecodable"
        return pa.array(out, pa.string())

    return kernel(run, "string")(payload, codec, raw_size, kind, stored)
