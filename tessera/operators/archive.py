"""The archive as tables, and how they are built from entries.

entries: name, entry_type, content, mode, mtime, symlink_target
files:   file_id, name, entry_type, entry_flags, logical_size, uid, gid, mode, mtime, atime, ctime, symlink_target, hash
spans:   file_id, sequence_order, block_id, offset_in_block, length
blocks:  block_id, block_offset, raw_size, stored_size, comp_algo, checksum_type, checksum, payload
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, paths, udfs
from ..functions.enums import STORED, EntryFlag, parse_checksum, parse_codec
from .ordering import in_order
from .work import keep

BLOCK_HEADER, ALIGNMENT, FIXED_HEADER = 32, 64, 48


@dataclass(frozen=True)
class WriteOptions:
    codec: str = "zstd"
    level: int = -1
    checksum: str = "h64"
    multiblock: bool = True
    block_size: int = 1 << 20
    posix: bool = True
    hashes: bool = True
    hash_algo: str = "sha256"
    dedup: bool = False
    compress_meta: bool = True
    name_format: str | None = None
    align_log2: int = 6

    def __post_init__(self):
        parse_codec(self.codec)
        parse_checksum(self.checksum)
        codecs.check_level(self.codec, self.level)
        if self.block_size < 1:
            raise ValueError("block size must be positive")


@dataclass(frozen=True)
class ArchiveTables:
    files: DataFrame
    spans: DataFrame
    blocks: DataFrame
    options: WriteOptions = WriteOptions()
    #: The blocks without ``block_offset``, for readers that don't ask where a block lies.
    stored: DataFrame | None = None

    def with_(self, **changed) -> ArchiveTables:
        if "blocks" in changed:
            changed.setdefault("stored", None)
        return replace(self, **changed)

    @property
    def payloads(self) -> DataFrame:
        return self.blocks if self.stored is None else self.stored

    def register(self, prefix: str = "") -> None:
        """Temp views ``files``, ``spans`` and ``blocks`` for SQL."""
        for name in ("files", "spans", "blocks"):
            getattr(self, name).createOrReplaceTempView(prefix + name)

    def save(self, path: str, mode: str = "error") -> None:
        """A Parquet directory; ``error`` refuses an existing one. Files are sorted by name, so min/max statistics prune lookups."""
        for name in ("files", "spans", "blocks"):
            df = getattr(self, name)
            key = "name" if name == "files" else "block_id"
            df.sortWithinPartitions(key).write.mode(mode).parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> ArchiveTables:
        return ArchiveTables(*(spark.read.parquet(f"{path}/{name}") for name in ("files", "spans", "blocks")))


def align_up(n: Column, alignment: int = ALIGNMENT) -> Column:
    return n + F.pmod(-n, F.lit(alignment))


def padding_for(n: Column, alignment: int = ALIGNMENT) -> Column:
    return F.pmod(-n, F.lit(alignment))


def entries_of_documents(docs: DataFrame) -> DataFrame:
    """Entries ``lang/source/doc_id.txt`` with the text's bytes, and their directories."""
    name = F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = docs.select(name.alias("name"), F.lit("file").alias("entry_type"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"), F.lit(paths.FILE_MODE).cast("long").alias("mode"), (F.lit(1_700_000_000) + F.col("doc_id")).alias("mtime"), F.lit(None).cast("string").alias("symlink_target"))
    return files.unionByName(directories(files))


def entries_of_pages(pages: DataFrame) -> DataFrame:
    """Entries named by the page's address below its scheme, and page number."""
    name = F.concat(F.regexp_replace("url", "^[a-z]+://", ""), F.lit("#"), F.col("page_id").cast("string"))
    return pages.select(name.alias("name"), F.lit("file").alias("entry_type"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"), F.lit(paths.FILE_MODE).cast("long").alias("mode"), F.lit(1_700_000_000).cast("long").alias("mtime"), F.lit(None).cast("string").alias("symlink_target"))


def directories(files: DataFrame) -> DataFrame:
    """A directory entry for every proper prefix of the names."""
    parts = F.split("name", "/")
    prefixes = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    d = files.select(F.explode(prefixes).alias("name")).filter("name <> ''").distinct()
    return d.select("name", F.lit("dir").alias("entry_type"), F.lit(b"").alias("content"), F.lit(paths.DIR_MODE).cast("long").alias("mode"), F.lit(1_700_000_000).cast("long").alias("mtime"), F.lit(None).cast("string").alias("symlink_target"))


def storable(entries: DataFrame) -> DataFrame:
    """Entries that an archive can hold, with clean names and ``logical_size``, in no order."""
    e = entries.filter(F.col("entry_type").isin(*STORED)).withColumn("name", paths.clean_name(F.col("name")))
    return e.withColumn("logical_size", F.when(F.col("entry_type") == "file", F.octet_length("content")).otherwise(0).cast("long"))


def number_files(entries: DataFrame) -> DataFrame:
    """``storable`` entries with ``file_id``, their rank by the bytes of the name."""
    return in_order(storable(entries), ["name"], "file_id")


def canonical_files(files: DataFrame, digest: str = "digest") -> DataFrame:
    """``files`` (file_id, logical_size, digest, ...) with ``canonical_id``.

    The first non-empty file with a digest is canonical for all later ones of its size. One of another size
    stands for itself and for nobody else. Firsts are found by an aggregate, not a window, so that a
    digest shared by a third of all files is combined before the shuffle.
    """
    first = files.filter("entry_type = 'file' AND logical_size > 0").groupBy(digest).agg(F.min(F.struct("file_id", "logical_size")).alias("_first"))
    j = files.join(first, digest, "left")
    same = (F.col("entry_type") == "file") & (F.col("logical_size") > 0) & (F.col("_first.logical_size") == F.col("logical_size"))
    return j.withColumn("canonical_id", F.when(same, F.col("_first.file_id")).otherwise(F.col("file_id"))).drop("_first")


def block_count(options: WriteOptions) -> Column:
    """Blocks of a canonical regular file: at least one, so that empty files have an empty block."""
    if not options.multiblock:
        return F.lit(1).cast("long")
    return F.greatest(F.ceil(F.col("logical_size") / F.lit(options.block_size)), F.lit(1)).cast("long")


def plan_blocks(files: DataFrame, options: WriteOptions) -> DataFrame:
    """(file_id, logical_size, n_blocks, first_block) of canonical regular files; ids run in file order."""
    f = files.filter("entry_type = 'file' AND canonical_id = file_id").select("file_id", "logical_size", block_count(options).alias("n_blocks"))
    return in_order(f, ["file_id"], None, {"first_block": "n_blocks"})


def chunks(planned: DataFrame, options: WriteOptions) -> DataFrame:
    """One row per block: file_id, sequence_order, block_id, offset, raw_size; no content is touched."""
    d = planned.select("file_id", "logical_size", "first_block", F.explode(F.sequence(F.lit(0), F.col("n_blocks").cast("int") - 1)).alias("sequence_order"))
    if options.multiblock:
        offset = F.col("sequence_order") * F.lit(options.block_size).cast("long")
        size = F.least(F.lit(options.block_size).cast("long"), F.col("logical_size") - offset)
    else:
        offset, size = F.lit(0).cast("long"), F.col("logical_size")
    return d.select("file_id", "sequence_order", (F.col("first_block") + F.col("sequence_order")).alias("block_id"), offset.alias("offset"), size.alias("raw_size"))


def build_archive(entries: DataFrame, options: WriteOptions | None = None) -> ArchiveTables:
    """The archive tables of ``entries``.

    Files are numbered by name, equal files share spans if asked for, content is cut into blocks that
    never mix files, blocks are encoded and checksummed as stored, and laid out in id order. Entries, their numbers and
    encoded blocks are kept in the shared folder, so every file is read and every block encoded once. Content is shuffled once, to its blocks;
    files are numbered, compared and listed without it.
    """
    o = options or WriteOptions()
    given = storable(entries).withColumn("digest", F.sha2(F.coalesce("content", F.lit(b"")), 256))
    sha256 = F.when(F.col("content").isNotNull(), F.unhex("digest"))
    hashed = (sha256 if o.hash_algo == "sha256" else udfs.file_hash(F.col("content"), o.hash_algo)) if o.hashes else F.lit(None).cast("binary")
    given = keep(given.withColumn("hash", hashed).withColumn("_row", F.monotonically_increasing_id()), "entries")
    e = in_order(given.drop("content"), ["name"], "file_id")
    if o.dedup:
        e = canonical_files(e)
    else:
        e = e.withColumn("canonical_id", F.col("file_id"))
    e = keep(e, "files")
    shared = F.when(F.col("canonical_id") != F.col("file_id"), int(EntryFlag.SHARED_SPANS)).otherwise(0)
    is_file = F.col("entry_type") == "file"
    has_hash = is_file if o.hashes else F.lit(False)
    stamp = lambda c: (F.col(c) if o.posix else F.lit(None)).cast("long")
    owner = (F.lit(0) if o.posix else F.lit(None)).cast("long")
    files = e.select(
        "file_id", "name", "entry_type", (shared + F.when(has_hash, int(EntryFlag.STRONG_HASH)).otherwise(0)).alias("entry_flags"), "logical_size",
        owner.alias("uid"), owner.alias("gid"), stamp("mode").alias("mode"), stamp("mtime").alias("mtime"), stamp("mtime").alias("atime"), stamp("mtime").alias("ctime"),
        "symlink_target", F.when(has_hash, F.col("hash")).alias("hash"),
    )
    planned = plan_blocks(e.select("file_id", "entry_type", "logical_size", "canonical_id"), o)
    spans = spans_of(e.select("file_id", "entry_type", "canonical_id"), chunks(planned, o))
    size = F.lit(o.block_size) if o.multiblock else F.greatest(F.octet_length("content"), F.lit(1))
    raw = planned.join(e.select("file_id", "_row"), "file_id").join(given.select("_row", "content"), "_row")
    raw = raw.select("first_block", "content", F.explode(F.sequence(F.lit(0), F.col("n_blocks").cast("int") - 1)).alias("k"))
    raw = raw.select((F.col("first_block") + F.col("k")).alias("block_id"), F.substring("content", F.col("k") * size + 1, size).alias("raw")) if o.multiblock else raw.select(F.col("first_block").alias("block_id"), F.col("content").alias("raw"))
    blocks = raw.select("block_id", F.octet_length("raw").cast("long").alias("raw_size"), udfs.encoded(F.col("raw"), o.codec, o.level, o.checksum).alias("_e"))
    blocks = blocks.select("block_id", "raw_size", F.col("_e.payload").alias("payload"), F.octet_length("_e.payload").cast("long").alias("stored_size"), F.col("_e.checksum").alias("checksum"))
    blocks = keep(blocks.withColumn("comp_algo", F.lit(o.codec)).withColumn("checksum_type", F.lit(o.checksum)), "blocks")
    return ArchiveTables(files, spans, lay_out(blocks, o), o, blocks)


def spans_of(files: DataFrame, chunked: DataFrame) -> DataFrame:
    """Spans of every regular file; duplicates repeat those of their canonical file."""
    f = files.filter("entry_type = 'file'").select("file_id", "canonical_id")
    c = chunked.select(F.col("file_id").alias("canonical_id"), "sequence_order", "block_id", F.lit(0).cast("long").alias("offset_in_block"), F.col("raw_size").alias("length"))
    return f.join(c, "canonical_id").select("file_id", "sequence_order", "block_id", "offset_in_block", "length")


def lay_out(blocks: DataFrame, options: WriteOptions, start: int = FIXED_HEADER) -> DataFrame:
    """``block_offset`` of every block: headers and payloads end to end in id order, each aligned.

    Only ids and sizes are ordered; payloads are joined back by id.
    """
    step = 1 << options.align_log2
    sizes = blocks.select("block_id", align_up(F.col("stored_size") + BLOCK_HEADER, step).alias("room"))
    first = start + -start % step
    at = in_order(sizes, ["block_id"], None, {"block_offset": "room"}).select("block_id", (F.col("block_offset") + first).alias("block_offset"))
    return blocks.join(at, "block_id").select("block_id", "block_offset", "raw_size", "stored_size", "comp_algo", "checksum_type", "checksum", "payload")
