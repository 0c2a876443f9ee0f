"""Spark data sources over containers, sidecars and packed embeddings, and the container sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from ..functions.enums import EntryType, FileHash, IndexType, NameFormat

SCHEMAS = {
    "header": "version string, align_log2 int, header_size bigint, meta_offset bigint, meta_stored bigint, meta_raw bigint, meta_codec string, index_type string, crc32c bigint, name_format string",
    "files": "file_id bigint, name string, name_bytes binary, entry_type string, entry_flags int, logical_size bigint, uid bigint, gid bigint, mode bigint, mtime bigint, atime bigint, ctime bigint, symlink_target string, hash binary",
    "spans": "file_id bigint, sequence_order int, block_id bigint, offset_in_block bigint, length bigint",
    "blocks": "block_id bigint, block_offset bigint, raw_size bigint, stored_size bigint, comp_algo string, checksum_type string, checksum bigint, payload binary",
    "xattrs": "file_id bigint, key string, value binary",
}
#: Stored bytes of blocks that one task reads.
TASK_BYTES = 64 << 20


class Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        super().__init__((lo, hi))


class ContainerSource(DataSource):
    """``spark.read.format("tessera").option("table", "files" | "spans" | "blocks" | "header" | "xattrs").load(path)``.

    With ``pushdown`` set to true, lookups by name are answered inside the source; the session must then have
    ``spark.sql.python.filterPushdown.enabled``.
    """

    @classmethod
    def name(cls) -> str:
        return "tessera"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "files")]

    def reader(self, schema):
        kind = PushingReader if self.options.get("pushdown", "false").lower() == "true" else ContainerReader
        return kind(self.options.get("table", "files"), self.options["path"])


class ContainerReader(DataSourceReader):
    def __init__(self, table: str, path: str):
        self.table, self.path, self.names = table, path.removeprefix("file://").removeprefix("file:"), None

    def partitions(self):
        import numpy as np

        from .container import open_container

        m = open_container(self.path)
        if self.table != "blocks":
            return [Range(0, len(m.files))]
        ends = np.cumsum(m.blocks["stored"].astype(np.int64))
        cuts = np.searchsorted(ends, np.arange(0, int(ends[-1]) if len(ends) else 0, TASK_BYTES), "left")
        cuts = sorted({0, *cuts.tolist(), len(m.blocks)})
        return [Range(a, b) for a, b in zip(cuts, cuts[1:], strict=False)] or [Range(0, 0)]

    def read(self, partition):
        from .container import open_container, read_block

        lo, hi = partition.value
        m = open_container(self.path)
        h = m.header
        if self.table == "header":
            yield (".".join(map(str, h.version)), h.align_log2, h.header_size, h.meta_offset, h.meta_stored, h.meta_raw, h.meta_codec, h.index_type.name.lower(), h.crc, m.name_format.name.lower())
        elif self.table == "files":
            for i, f in enumerate(m.files):
                raw = m.names[int(f["name_id"])]
                name = raw.decode("utf-8", "replace")
                if self.names is not None and name not in self.names:
                    continue
                p = [int(m.posix[i][c]) for c in ("uid", "gid", "mode", "mtime", "atime", "ctime")] if m.posix is not None else [None] * 6
                link = m.links[i] if m.links else None
                kind = EntryType(int(f["entry_type"])).name.lower() if int(f["entry_type"]) in EntryType._value2member_map_ else "unknown"
                yield (i, name, raw, kind, int(f["flags"]), int(f["size"]), *p, None if link is None else link.decode("utf-8", "replace"), m.hashes[i] if m.hashes else None)
        elif self.table == "spans":
            for i, (start, count) in enumerate(zip(m.starts, m.counts, strict=True)):
                for s in m.spans[int(start) : int(start) + int(count)]:
                    yield (i, int(s["sequence"]), int(s["block_id"]), int(s["offset"]), int(s["length"]))
        elif self.table == "xattrs":
            for i, own in enumerate(m.xattrs or []):
                for k, v in own:
                    yield (i, k, v)
        else:
            import os

            size = os.path.getsize(self.path)
            with open(self.path, "rb") as f:
                for i in range(lo, hi):
                    at = int(m.blocks[i]["offset"])
                    b = read_block(f, at, size)
                    yield (i, at, b["raw_size"], b["stored_size"], b["comp_algo"], b["checksum_type"], b["checksum"], b["payload"])


class PushingReader(ContainerReader):
    def pushFilters(self, filters):
        """Equality and membership of ``name`` are answered here; everything else goes back to Spark."""
        for f in filters:
            if self.table == "files" and isinstance(f, (EqualTo, In)) and f.attribute == ("name",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = values if self.names is None else self.names & values
            else:
                yield f


class EmbeddingSource(DataSource):
    """``format("tessera_embeddings")``: packed vectors (count u32, dim u32, type u8, data) and an optional ``names`` line file."""

    @classmethod
    def name(cls) -> str:
        return "tessera_embeddings"

    def schema(self) -> str:
        return "filename string, original_index bigint, vector array<float>"

    def reader(self, schema):
        return EmbeddingReader(self.options["path"], self.options.get("names"))


class EmbeddingReader(DataSourceReader):
    def __init__(self, path: str, names: str | None):
        self.path, self.names_path = path.removeprefix("file://").removeprefix("file:"), names

    def _head(self):
        import struct

        with open(self.path, "rb") as f:
            count, dim, kind = struct.unpack("<IIB", f.read(9))
        if kind not in (0, 2):
            raise ValueError("16-bit and unknown embedding types can't be read")
        names = None
        if self.names_path:
            with open(self.names_path, encoding="utf-8") as f:
                names = [x.rstrip("\n") for x in f if x.rstrip("\n")]
            if len(names) != count:
                raise ValueError(f"{len(names)} names for {count} vectors")
        return count, dim, kind, names

    def partitions(self):
        count, dim, kind, _ = self._head()
        step = max(1, TASK_BYTES // max(1, dim * (4 if kind == 0 else 1)))
        return [Range(a, min(a + step, count)) for a in range(0, count, step)] or [Range(0, 0)]

    def read(self, partition):
        import numpy as np

        (lo, hi), (_, dim, kind, names) = partition.value, self._head()
        width = dim * (4 if kind == 0 else 1)
        with open(self.path, "rb") as f:
            f.seek(9 + lo * width)
            data = np.frombuffer(f.read((hi - lo) * width), "<f4" if kind == 0 else "i1").reshape(-1, dim)
        for i, v in enumerate(data, lo):
            yield (names[i] if names else str(i), i, (v / np.float32(127) if kind == 2 else v).astype(np.float32).tolist())


class SidecarSource(DataSource):
    """``format("tessera_index")``: sketches of a binary MinHash sidecar, by file position."""

    @classmethod
    def name(cls) -> str:
        return "tessera_index"

    def schema(self) -> str:
        return "file_id bigint, num_hashes int, bit_width int, seed bigint, sketch array<bigint>"

    def reader(self, schema):
        return SidecarReader(self.options["path"])


class SidecarReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://").removeprefix("file:")

    def read(self, partition):
        from .sidecar import read_sidecar, unpack_sketches

        s = read_sidecar(self.path)
        if s is None:
            raise ValueError(f"not an index: {self.path}")
        n, width, seed, rows = unpack_sketches(s.sections[1])
        for i, r in enumerate(rows):
            yield (i, n, width, seed, r.tolist())


def register(spark: SparkSession) -> None:
    for source in (ContainerSource, EmbeddingSource, SidecarSource):
        spark.dataSource.register(source)


def read_container(spark: SparkSession, path: str):
    """ArchiveTables over a container."""
    from ..operators.archive import ArchiveTables

    register(spark)
    return ArchiveTables(*(spark.read.format("tessera").option("table", t).load(path) for t in ("files", "spans", "blocks")))


def write_container(at, path: str, force: bool = False) -> None:
    """Write archive tables to one container file, streaming blocks in id order through the driver; refuses to overwrite unless forced.

    A container is one file with one writer. Parquet directories (ArchiveTables.save) are the distributed form.
    """
    import os

    import numpy as np

    from . import container as c
    from . import nametable

    if os.path.exists(path) and not force:
        raise FileExistsError(path)
    o = at.options
    files = at.files.orderBy("file_id").toPandas()
    n = len(files)
    names = [x.encode() for x in files.name]
    rows = np.zeros(n, c.FILE_ROW)
    rows["name_id"], rows["size"] = np.arange(n), files.logical_size
    rows["entry_type"] = [EntryType[t.upper()] for t in files.entry_type]
    rows["flags"] = files.entry_flags
    spans = at.spans.orderBy("file_id", "sequence_order").toPandas()
    table = np.zeros(len(spans), c.SPAN_ROW)
    for to, name in (("block_id", "block_id"), ("offset", "offset_in_block"), ("length", "length"), ("sequence", "sequence_order")):
        table[to] = spans[name]
    counts = np.bincount(spans.file_id.to_numpy().astype(int), minlength=n) if n else np.zeros(0, int)
    posix = None
    if o.posix:
        posix = np.zeros(n, c.POSIX_ROW)
        for k in ("uid", "gid", "mode", "mtime", "atime", "ctime"):
            posix[k] = files[k].fillna(0)
    kind = NameFormat[o.name_format.upper()] if o.name_format else nametable.recommend(names)
    hashes = [None if h is None else bytes(h) for h in files["hash"]] if o.hashes else None
    links = [None if x is None or x != x else x.encode() for x in files.symlink_target]
    header = c.Header(index_type=IndexType.MULTIBLOCK if o.multiblock else IndexType.SINGLE_FILE, align_log2=o.align_log2)
    m = c.Metadata(header, names, rows, np.cumsum(counts) - counts, counts, table, np.zeros(0, c.BLOCK_ROW), posix, links, hashes, FileHash[o.hash_algo.upper()], name_format=kind)
    ordered = at.blocks.orderBy("block_id").select("raw_size", "comp_algo", "checksum_type", "checksum", "payload")
    c.write_container(path, m, ((r.raw_size, r.comp_algo, r.checksum_type, r.checksum, bytes(r.payload)) for r in ordered.toLocalIterator(prefetchPartitions=True)), o.compress_meta)


def walk(spark: SparkSession, root: str, prefix: str | None = None) -> DataFrame:
    """Entries of a folder tree: folders, links and modes from a driver-side walk that never follows links, contents from the executors."""
    import os

    rows = []
    base = prefix if prefix is not None else os.path.basename(os.path.normpath(root))

    def visit(path: str, name: str) -> None:
        try:
            st = os.lstat(path)
        except OSError:
            return
        kind = {0o4: "dir", 0o12: "symlink", 0o10: "file"}.get(st.st_mode >> 12)
        if kind is None:
            return
        rows.append((name, kind, os.path.abspath(path) if kind == "file" else None, st.st_mode, int(st.st_mtime), os.readlink(path) if kind == "symlink" else None))
        if kind == "dir":
            try:
                children = sorted(os.listdir(path))
            except OSError:
                return
            for c in children:
                visit(os.path.join(path, c), f"{name}/{c}" if name else c)

    visit(root, base)
    rows = [r for r in rows if r[0]]
    listed = spark.createDataFrame(rows, "name string, entry_type string, path string, mode bigint, mtime bigint, symlink_target string")
    return with_contents(listed)


def with_contents(listed: DataFrame) -> DataFrame:
    """Entries of (name, entry_type, path, mode, mtime, symlink_target); files are read by the tasks."""

    @F.pandas_udf("binary")
    def load(paths):
        import pandas as pd

        def one(p):
            if p is None:
                return b""
            with open(p, "rb") as f:
                return f.read()

        return pd.Series([one(p) for p in paths])

    return listed.select("name", "entry_type", load("path").alias("content"), "mode", "mtime", "symlink_target")


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """Names, one per non-empty line."""
    return spark.read.text(path).filter("value <> ''").select(F.col("value").alias("name"))
