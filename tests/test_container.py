import struct

import numpy as np
import pytest

from tessera.functions.enums import EntryFlag, FileHash, IndexType, NameFormat, SidecarType
from tessera.operators import archive as ar
from tessera.operators import content, diffing, listing, minhash
from tessera.sources import container, datasource, nametable, sidecar
from tessera.sources.nametable import FormatError

NAMES = [b"include/header.hpp", b"src/main.cpp", b"src/main.hpp", b"src/util/helper.cpp"]


def pattern(seed, n):
    return bytes((seed + i % 251) % 256 for i in range(n))


def entries(spark, items):
    """items: {name: bytes | None (folder) | str (link target)}"""
    rows = [(n, "dir" if v is None else "symlink" if isinstance(v, str) else "file", v if isinstance(v, (bytes, bytearray)) else b"", 0o40755 if v is None else 0o100644, 123, v if isinstance(v, str) else None) for n, v in items.items()]
    return spark.createDataFrame([(n, k, bytearray(c), m, t, s) for n, k, c, m, t, s in rows], "name string, entry_type string, content binary, mode bigint, mtime bigint, symlink_target string")


def contents(at, names=None):
    spark = at.files.sparkSession
    return {r.name: bytes(r.content) for r in content.read_files(at, content.request(spark, names) if names else None).collect()}


@pytest.mark.parametrize("kind", list(NameFormat))
def test_name_tables(kind):
    for names in ([], NAMES, sorted(f"d{i % 7}/e{i % 13}/file {i}".encode() for i in range(300))):
        assert nametable.decode(nametable.encode(names, kind), kind) == names
    with pytest.raises(FormatError):
        nametable.decode(nametable.encode(NAMES, kind)[:9], kind)


def test_trie_layout_and_limits():
    data = nametable.encode([b"a", b"a-b", b"a/b"], NameFormat.TRIE)
    assert data[:2] == bytes([3, 0]) and nametable.decode(data, NameFormat.TRIE) == [b"a", b"a-b", b"a/b"]
    for bad in ([b"/abs"], [b"a//b"], [b"x", b"x"]):
        with pytest.raises(FormatError):
            nametable.encode(bad, NameFormat.TRIE)
    with pytest.raises(FormatError):
        nametable.encode([b"x" * 70000], NameFormat.FRONT_CODED)
    assert nametable.recommend([b"a", b"b"]) == NameFormat.RAW
    assert nametable.recommend(sorted(b"some/long/folder/name/%06d" % i for i in range(200))) == NameFormat.FRONT_CODED
    for n in (0, 1, 127, 128, 2**32 - 1):
        assert nametable.read_varint(nametable.varint(n), 0)[0] == n


def test_header_checks():
    good = container.Header().pack()
    assert len(good) == 48 and container.Header.parse(good).align_log2 == 6
    for at, value in ((0, 9), (4, 7), (8, 1), (40, 2), (41, 2), (42, 1), (20, 9)):
        bad = bytearray(good)
        bad[at] = value
        with pytest.raises(FormatError):
            container.Header.parse(bytes(bad))
    no_crc = bytearray(good[:44] + b"\0\0\0\0")
    no_crc[20] = 9
    container.Header.parse(bytes(no_crc))


def test_section_codecs():
    x = [[("user.a", b"\0\1"), ("k", b"")], [], [("é", b"v")]]
    assert container.read_xattrs(container.write_xattrs(x), 3) == x
    links = [None, b"a/b", b"", None]
    assert container.read_links(container.write_links(links), 4) == links
    h = [b"h" * 32, None]
    assert container.read_hashes(container.write_hashes(FileHash.SHA256, h), 2) == (FileHash.SHA256, h)
    with pytest.raises(FormatError):
        container.read_hashes(container.write_hashes(FileHash.SHA256, h), 3)
    with pytest.raises(FormatError):
        container.read_table(struct.pack("<I", 5), container.FILE_ROW)


@pytest.mark.parametrize(("codec", "checksum", "multiblock", "dedup"), [("none", "h64", True, False), ("zstd", "crc32c", True, True), ("gzip", "xxh32", True, False), ("lz4", "none", False, False), ("bzip2", "h64", False, False)])
def test_round_trip(spark, tmp_path, codec, checksum, multiblock, dedup):
    items = {"d": None, "d/a.txt": b"A" * 1000, "d/b.txt": pattern(17, 40000), "e.txt": b"", "same1": b"SAME", "same2": b"SAME", "exact": b"x" * 32768, "over": b"y" * 32769, "link": "d/a.txt", "é ü": "ß".encode()}
    at = ar.build_archive(entries(spark, items), ar.WriteOptions(codec=codec, checksum=checksum, multiblock=multiblock, dedup=dedup, block_size=32768))
    path = f"{tmp_path}/a.bin"
    datasource.write_container(at, path)
    with pytest.raises(FileExistsError):
        datasource.write_container(at, path)
    back = datasource.read_container(spark, path)
    want = {k: v for k, v in items.items() if isinstance(v, bytes)}
    assert contents(back) == want and contents(at) == want
    files = {r.name: r for r in back.files.collect()}
    assert [files[n].file_id for n in sorted(items, key=str.encode)] == list(range(len(items)))
    assert files["link"].symlink_target == "d/a.txt" and files["d"].entry_type == "dir" and files["d/a.txt"].mtime == 123 and files["d/a.txt"].mode == 0o100644
    assert files["same2"].entry_flags & EntryFlag.SHARED_SPANS == (4 if dedup else 0)
    blocks = {r.block_id: r for r in back.blocks.collect()}
    n = 10 if multiblock else 8
    assert len(blocks) == n - dedup and all(b.block_offset % 64 == 0 for b in blocks.values())
    ends = sorted((b.block_offset, b.block_offset + 32 + b.stored_size) for b in blocks.values())
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
    head = spark.read.format("tessera").option("table", "header").load(path).first()
    assert head.header_size == ends[0][0] and head.index_type == ("multiblock" if multiblock else "single_file")
    assert content.all_valid(back).first().all_valid
    only = back.files.filter("name = 'exact'")
    assert [r.name for r in only.collect()] == ["exact"]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    pushed = spark.read.format("tessera").option("pushdown", "true").load(path).filter("name IN ('exact', 'zzz') AND logical_size > 0")
    assert [r.name for r in pushed.collect()] == ["exact"]
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert contents(back, ["over", "nothing", "same2"]) == {"over": items["over"], "same2": b"SAME"}


def test_missing_block_table_and_corruption(spark, tmp_path):
    at = ar.build_archive(entries(spark, {"a": b"A" * 1024, "b": b"B" * 500}), ar.WriteOptions(codec="zstd", compress_meta=False, block_size=256))
    path = f"{tmp_path}/a.bin"
    datasource.write_container(at, path)
    m = container.open_container(path)
    raw = bytearray(open(path, "rb").read())
    for i in range(struct.unpack_from("<I", raw, 48)[0]):
        where = 56 + 32 * i
        if struct.unpack_from("<I", raw, where)[0] == container.BLOCKS:
            struct.pack_into("<I", raw, where, 99)
    open(f"{tmp_path}/c.bin", "wb").write(raw)
    assert (container.open_container(f"{tmp_path}/c.bin").blocks == m.blocks).all()
    assert contents(datasource.read_container(spark, f"{tmp_path}/c.bin"))["a"] == b"A" * 1024
    raw[int(m.blocks[0]["offset"]) + 32 + 3] ^= 1
    open(f"{tmp_path}/d.bin", "wb").write(raw)
    bad = datasource.read_container(spark, f"{tmp_path}/d.bin")
    assert [(r.block_id, r.reason) for r in content.validate(bad).filter("NOT valid").collect()] == [(0, "checksum")]
    with pytest.raises(Exception, match="checksum"):
        contents(bad)


def test_byte_identical_under_input_order(spark, tmp_path):
    items = {f"f{i}": pattern(i, 3000 + i) for i in range(12)}
    for name, rows in (("x", items), ("y", dict(reversed(items.items())))):
        datasource.write_container(ar.build_archive(entries(spark, rows).repartition(3), ar.WriteOptions(block_size=1000)), f"{tmp_path}/{name}")
    assert open(f"{tmp_path}/x", "rb").read() == open(f"{tmp_path}/y", "rb").read()


def test_redaction(spark):
    plain = ar.WriteOptions(codec="none", dedup=True)
    at = ar.build_archive(entries(spark, {"a": b"xxx", "b": b"xxx", "c": b"y"}), plain)
    red = content.redact(at, ["a"])
    assert contents(red) == {"a": b"", "b": b"", "c": b"y"}
    f = {r.name: r for r in red.files.collect()}
    assert f["a"].entry_flags & 1 and f["b"].entry_flags & 1 and f["b"]["hash"] is None and f["c"].entry_flags & 1 == 0
    assert {bytes(r.payload) for r in red.blocks.collect()} == {b"\0\0\0", b"y"}
    assert [r.block_id for r in content.validate(red).collect()] == [1]
    with pytest.raises(content.ContentError):
        content.redact(at, ["nope"])
    with pytest.raises(content.ContentError):
        content.redact(ar.build_archive(entries(spark, {"a": b"x" * 99}), ar.WriteOptions(codec="zstd")), ["a"])


def test_diff(spark):
    def stats(old, new, **o):
        a, b = (ar.build_archive(entries(spark, x), ar.WriteOptions(**o)).files for x in (old, new))
        return {r.status: (r.n_files, r.n_bytes) for r in diffing.diff_stats(diffing.diff_files(a, b)).collect()}

    assert stats({"f1": b"abc", "f2": b"def"}, {"f1": b"abcx", "f3": b"ghi"}) == {"modified": (1, 3), "added": (1, 3), "deleted": (1, 3)}
    assert stats({"f1": b"abc"}, {"f1": b"abd"}) == {"modified": (1, 3)}
    assert stats({"f1": b"abc"}, {"f1": b"abd"}, hashes=False) == {"unchanged": (1, 3)}
    assert stats({}, {"f": b"a"}) == {"added": (1, 1)}


def test_extract_cat_and_walk(spark, tmp_path):
    items = {"d": None, "d/a.txt": b"one\n", "d/e": None, "d/e/b.txt": b"two", "empty": b"", "l": "d/a.txt"}
    at = ar.build_archive(entries(spark, items), ar.WriteOptions(block_size=2))
    out = f"{tmp_path}/out"
    assert content.extract(at, out) == 6
    assert open(f"{out}/d/e/b.txt", "rb").read() == b"two" and (tmp_path / "out/l").is_symlink() and int((tmp_path / "out/d/a.txt").stat().st_mtime) == 123
    again = ar.build_archive(datasource.walk(spark, out, ""))
    assert contents(again) == {k: v for k, v in items.items() if isinstance(v, bytes)}
    assert {r.name: r.entry_type for r in again.files.collect()} == {"d": "dir", "d/a.txt": "file", "d/e": "dir", "d/e/b.txt": "file", "empty": "file", "l": "symlink"}
    assert content.extract(at, f"{tmp_path}/strip", ["d/a.txt", "d/e/b.txt"], strip=1) == 2
    assert (tmp_path / "strip/a.txt").exists() and (tmp_path / "strip/e/b.txt").exists()
    with pytest.raises(content.ContentError):
        content.extract(at, out, ["nope"])
    with pytest.raises(content.ContentError):
        content.extract(ar.build_archive(entries(spark, {"../x": b"1"})), out)
    wanted = content.request(spark, ["d/e/b.txt", "d/a.txt"])
    assert content.cat(at, f"{tmp_path}/cat", wanted) == 7 and open(f"{tmp_path}/cat", "rb").read() == b"twoone\n"


def test_similarity_fixture(spark, tmp_path):
    fox = "The quick brown fox jumps over the lazy {}\n"
    files = entries(spark, {"file1": fox.format("dog").encode(), "file2": fox.format("cat").encode(), "file3": b"A completely different sentence about nothing\n", "dir": None})
    index = minhash.build(ar.number_files(files), 128, 32)
    search = minhash.MinHashSearcher().search
    got = [(r.name, round(r.score, 4)) for r in search(index, "file1").collect()]
    assert got == [("file1", 1.0), ("file2", 0.8047)]
    bird = fox.format("bird").encode()
    assert [(r.name, round(r.score, 4)) for r in search(index, bird).collect()] == [("file1", 0.8047), ("file2", 0.7578)]
    assert [r.name for r in search(index, bird, 1).collect()] == ["file1"]
    wide = minhash.build(ar.number_files(files), 256, 32)
    assert [round(r.score, 4) for r in search(wide, "file1").collect()] == [1.0, 0.7852]
    rows = {r.name: r.sketch for r in index.collect()}
    assert set(rows["dir"]) == {0xFFFFFFFF}
    banded = minhash.search_banded(index, index.filter("name = 'file1'").selectExpr("name AS query_id", "sketch"), 128, 32)
    assert {(r.name, round(r.score, 4)) for r in banded.collect()} == {("file1", 1.0), ("file2", 0.8047)}
    with pytest.raises(ValueError):
        minhash.check(128, 12)
    with pytest.raises(KeyError):
        search(index, "nope")
    s = sidecar.Sidecar(SidecarType.MINHASH, "/x/y.bin", 77, align_log2=4)
    s.sections[1] = sidecar.pack_sketches(128, 32, 42, np.array([rows["file1"], rows["dir"]], np.int64).view(np.uint64))
    sidecar.write_sidecar(f"{tmp_path}/i", s)
    back = sidecar.read_sidecar(f"{tmp_path}/i")
    assert (back.archive_name, back.archive_hash, back.kind) == ("y.bin", 77, SidecarType.MINHASH)
    datasource.register(spark)
    assert [r.sketch for r in spark.read.format("tessera_index").load(f"{tmp_path}/i").orderBy("file_id").collect()] == [rows["file1"], rows["dir"]]
    assert sidecar.read_sidecar(f"{tmp_path}/none") is None and listing is not None and IndexType is not None


def test_embedding_file(spark, tmp_path):
    v = np.random.default_rng(2).normal(size=(5, 3)).astype("<f4")
    open(f"{tmp_path}/e", "wb").write(struct.pack("<IIB", 5, 3, 0) + v.tobytes())
    open(f"{tmp_path}/n", "w").write("\n".join("abcde"))
    datasource.register(spark)
    load = lambda **o: spark.read.format("tessera_embeddings").options(**o).load()
    got = load(path=f"{tmp_path}/e", names=f"{tmp_path}/n").orderBy("original_index").collect()
    assert [r.filename for r in got] == list("abcde") and np.allclose([r.vector for r in got], v)
    open(f"{tmp_path}/q", "wb").write(struct.pack("<IIB", 2, 2, 2) + np.array([127, -127, 0, 64], "i1").tobytes())
    assert np.allclose([r.vector for r in load(path=f"{tmp_path}/q").orderBy("original_index").collect()], [[1, -1], [0, 64 / 127]])
    open(f"{tmp_path}/h", "wb").write(struct.pack("<IIB", 1, 1, 1) + b"\0\0")
    with pytest.raises(Exception, match="16-bit"):
        load(path=f"{tmp_path}/h").collect()
