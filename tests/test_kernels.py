import os
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions import codecs, hashing
from tessera.functions.enums import Checksum, Codec, parse_checksum, parse_codec

GOLDEN = {b"": "9090306c6e91ed59", b"a": "26489728c2a1efd1", b"hash": "feda40794297dbb9", b"SAME": "392aab064d2cf741", b"DIFF": "c0fbd5ab922968ca", b"Hello, World!\n": "476416c424c77e32", bytes(range(32)): "69588587ca7e6ddd", bytes(33): "590fa495f57960d0"}


def test_h64_golden_values():
    for data, want in GOLDEN.items():
        assert f"{int(hashing.h64([data])[0]):016x}" == want
    assert [f"{int(h):016x}" for h in hashing.h64(list(GOLDEN))] == list(GOLDEN.values())
    assert hashing.file_hash([b"hash"], "h64")[0].hex() == "b9db97427940dafe" * 4


@settings(max_examples=25, deadline=None)
@given(st.lists(st.binary(max_size=200), max_size=8))
def test_batches_equal_single_inputs(rows):
    for kind in ("h64", "crc32c", "xxh32"):
        assert hashing.checksum(rows, kind).tolist() == [int(hashing.checksum([r], kind)[0]) for r in rows]


def test_word_form_equals_general_form():
    words = np.random.default_rng(0).integers(0, 1 << 63, 500, dtype=np.uint64)
    for seed in (0, 42, 43):
        assert (hashing.h64_words(words, seed) == hashing.h64([w.tobytes() for w in words], seed)).all()


def test_crc32c_published_values():
    assert int(hashing.crc32c([b"123456789"])[0]) == 0xE3069283
    assert int(hashing.crc32c([bytes(32)])[0]) == 0x8A9136AA
    assert int(hashing.crc32c([b"\xff" * 32])[0]) == 0x62A8AB43


def test_checksum_none_and_unknown():
    assert hashing.checksum([b"x"], "none").tolist() == [0]
    with pytest.raises(ValueError):
        hashing.checksum([b"x"], "md4")
    if not hashing.blake3_available():
        with pytest.raises(RuntimeError):
            hashing.file_hash([b"x"], "blake3")


@pytest.mark.parametrize("codec", ["none", "gzip", "zstd", "lz4", "bzip2"])
def test_codec_round_trips(codec):
    random.seed(1)
    for data in (b"", b"x", b"abc" * 1000, random.randbytes(5000), os.urandom(3)):
        assert codecs.decompress(codecs.compress(data, codec), codec, len(data)) == data
    with pytest.raises(Exception):
        codecs.decompress(codecs.compress(b"abc", codec), codec, 7)


def test_gzip_accepts_zlib_framing_and_levels_are_checked():
    assert codecs.decompress(zlib.compress(b"hello"), "gzip", 5) == b"hello"
    assert codecs.compress(b"x" * 99, "gzip", 9)
    for codec, level in (("zstd", -7), ("zstd", 99), ("lz4", 3), ("gzip", 10), ("bzip2", 0)):
        with pytest.raises(ValueError):
            codecs.compress(b"x", codec, level)


def test_option_spellings():
    assert parse_codec("ZStd") == Codec.ZSTD and parse_checksum("xxh3") == Checksum.H64 and parse_checksum("off") == Checksum.NONE
    for bad in ("XXH3", "crc64"):
        with pytest.raises(ValueError):
            parse_checksum(bad)


@pytest.mark.parametrize("data", [b"", b"short", b"12345678", b"abcdefgh" * 40, bytes(range(256)) * 3])
def test_lanes_equal_brute_force(data):
    from tessera.operators.minhash import lanes

    shingles = {data[i : i + 8] for i in range(len(data) - 7)} if len(data) >= 8 else ({data} if data else set())
    for width in (8, 32, 64):
        want = [min(((int(hashing.h64([s], 42)[0]) + i * int(hashing.h64([s], 43)[0])) % 2**64 for s in shingles), default=2**64 - 1) % 2**width for i in range(5)]
        assert lanes(data, 5, width).tolist() == want


def sizes_at_once(codec):
    """What a kernel with the codec takes at once of a full batch of rows, and its decoded results."""
    import pyarrow as pa

    from tessera.functions import udfs

    rows = [b"", None, bytes(3 << 20), *[str(i).encode() * 200 for i in range(10_000)]]
    seen = []

    def run(s):
        seen.append([len(x) for x in s])
        return pa.array([codecs.decompress(codecs.compressor(codec)(x), codec, len(x)) for x in s], pa.binary())

    out = udfs.piecewise(run)(iter([pa.array(rows, pa.binary())]))
    first = next(out)
    assert len(seen) == 1  # a piece is handed on before the next is read
    got = [x for a in [first, *out] for x in a.to_pylist()]
    assert got == [x or b"" for x in rows]
    return seen


def test_zstd_takes_a_batch_in_pieces():
    seen = sizes_at_once("zstd")
    assert len(seen) > 5 and all(len(s) == 1 or sum(s) <= 2 << 20 and len(s) <= 1024 for s in seen)


def test_gzip_takes_a_batch_in_pieces():
    seen = sizes_at_once("gzip")
    assert len(seen) > 5 and all(len(s) == 1 or sum(s) <= 2 << 20 and len(s) <= 1024 for s in seen)


@pytest.mark.parametrize("num_hashes", [4, 128])
def test_sketches_are_made_in_pieces(num_hashes):
    import pyarrow as pa

    from tessera.functions import udfs
    from tessera.operators import minhash

    rows = [b"", None, b"abc", *[str(i).encode() * 20 for i in range(1500)]]
    made = list(udfs.piecewise(lambda s: minhash.sketches(s, num_hashes, 32, 42))(iter([pa.array(rows, pa.binary())])))
    assert len(made) == 2 and max(map(len, made)) == udfs.ROWS
    assert [x for a in made for x in a.to_pylist()] == [minhash.lanes(x or b"", num_hashes, 32, 42).tolist() for x in rows]
