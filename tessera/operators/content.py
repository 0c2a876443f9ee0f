"""Reading content back: lookup by name, reassembly, concatenation, extraction, validation, redaction."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths, udfs
from ..functions.enums import EntryFlag
from .archive import ArchiveTables
from .ordering import in_order

REDACTED = int(EntryFlag.REDACTED)


class ContentError(Exception):
    """A request that the archive can't answer as asked."""


def request(spark, names: list[str]) -> DataFrame:
    """(pos, name) of a list of wanted names."""
    return spark.createDataFrame(list(enumerate(names)), "pos int, name string")


def find(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pos, files columns) of wanted names (pos, name); of files with equal names the first; misses are absent.

    The name is compared byte by byte, never as a pattern.
    """
    first = files.join(wanted.select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.min("file_id").alias("file_id"))
    return wanted.join(first, "name").join(files.drop("name"), "file_id").select("pos", "file_id", "name", *[c for c in files.columns if c not in ("file_id", "name")])


def missing(files: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(files.select("name"), "name", "left_anti").select("pos", "name")


def file_block_ids(at: ArchiveTables) -> DataFrame:
    """(file_id, block_ids): distinct sorted ids; empty for other types and empty files."""
    ids = at.spans.filter("length > 0").groupBy("file_id").agg(F.sort_array(F.collect_set("block_id")).alias("block_ids"))
    return at.files.select("file_id").join(ids, "file_id", "left").select("file_id", F.coalesce("block_ids", F.array().cast("array<bigint>")).alias("block_ids"))


def decoded(blocks: DataFrame, verify: bool = True) -> DataFrame:
    """(block_id, raw): checksums are verified over the stored bytes before decoding, in the same pass."""
    given = [F.col(c) for c in ("payload", "comp_algo", "raw_size")]
    raw = udfs.verified_decode(*given, F.col("checksum_type"), F.col("checksum")) if verify else udfs.decompress(*given)
    return blocks.select("block_id", raw.alias("raw"))


def read_files(at: ArchiveTables, wanted: DataFrame | None = None, verify: bool = True) -> DataFrame:
    """(file_id, name, content) of the wanted (pos, name) or all regular files; redacted ones are empty.

    Only blocks of wanted files are decoded. Slices outside their block are an error.
    """
    f = at.files if wanted is None else find(at.files, wanted)
    f = f.filter("entry_type = 'file'").select("file_id", "name", "entry_flags").distinct()
    live = f.filter(F.col("entry_flags").bitwiseAND(REDACTED) == 0)
    spans = at.spans.join(live.select("file_id"), "file_id", "left_semi")
    blocks = at.payloads.join(spans.select("block_id").distinct(), "block_id", "left_semi")
    j = spans.join(decoded(blocks, verify), "block_id")
    outside = F.raise_error(F.concat(F.lit("span outside block "), F.col("block_id").cast("string"))).cast("binary")
    piece = F.when(F.col("offset_in_block") + F.col("length") > F.octet_length("raw"), outside).otherwise(F.substring("raw", F.col("offset_in_block").cast("int") + 1, F.col("length").cast("int")))
    # Pieces are laid end to end once, not appended one by one.
    whole = j.select("file_id", "sequence_order", piece.alias("piece")).groupBy("file_id").agg(F.expr("listagg(piece) WITHIN GROUP (ORDER BY sequence_order)").alias("content"))
    return f.join(whole, "file_id", "left").select("file_id", "name", F.coalesce("content", F.lit(b"")).alias("content"))


def cat_plan(files: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(pos, name, offset, size) of concatenated regular files in requested or archive order; redacted ones take no room."""
    f = (files.withColumn("pos", F.col("file_id")) if wanted is None else find(files, wanted)).filter("entry_type = 'file'")
    size = F.when(F.col("entry_flags").bitwiseAND(REDACTED) != 0, F.lit(0)).otherwise(F.col("logical_size")).cast("long")
    return in_order(f.select("pos", "name", size.alias("size")), ["pos"], None, {"offset": "size"}).select("pos", "name", "offset", "size")


def cat(at: ArchiveTables, out: str, wanted: DataFrame | None = None) -> int:
    """Write the concatenation to a file on a mounted file system; every task writes its files at their offsets. Returns the size."""
    plan = cat_plan(at.files, wanted)
    total = plan.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    with open(out, "wb") as f:
        f.truncate(total)
    rows = plan.join(read_files(at, wanted).select("name", "content"), "name").select("offset", "content")

    def write(batches):
        with open(out, "r+b") as f:
            for b in batches:
                for offset, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    f.seek(offset)
                    f.write(data)
        return iter(())

    rows.mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()
    return total


def extract(at: ArchiveTables, out_dir: str, names: list[str] | None = None, strip: int = 0) -> int:
    """Write entries below ``out_dir`` on a mounted file system: folders, then files in parallel, then links and folder times.

    Missing names and names that would leave the folder are errors. Returns the number of entries written.
    """
    spark = at.files.sparkSession
    wanted = None
    f = at.files
    if names is not None:
        wanted = request(spark, names)
        lost = [r.name for r in missing(f, wanted).limit(20).collect()]
        if lost:
            raise ContentError(f"not in the archive: {', '.join(lost)}")
        f = find(f, wanted).drop("pos").dropDuplicates(["file_id"])
    f = f.withColumn("target", paths.strip_components(F.col("name"), strip)).filter("target IS NOT NULL")
    unsafe = f.filter(~paths.is_safe(F.col("target"))).select("name").limit(1).collect()
    if unsafe:
        raise ContentError(f"unsafe name: {unsafe[0].name}")
    os.makedirs(out_dir, exist_ok=True)
    kept = f.filter("entry_type <> 'file'").orderBy("target").select("target", "entry_type", "mode", "atime", "mtime", "symlink_target")
    dirs = []
    for r in kept.toLocalIterator():
        if r.entry_type == "dir":
            os.makedirs(os.path.join(out_dir, r.target), exist_ok=True)
            dirs.append((r.target, r.mode, r.atime, r.mtime))
    rows = f.filter("entry_type = 'file'").select("file_id", "target", "mode", "atime", "mtime").join(read_files(at, wanted).select("file_id", "content"), "file_id")

    def write(batches):
        import pyarrow as pa

        for b in batches:
            for _, target, mode, atime, mtime, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                path = os.path.join(out_dir, target)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                part = f"{path}.part-{os.getpid()}"
                with open(part, "wb") as o:
                    o.write(data)
                if mode is not None:
                    os.chmod(part, mode & 0o777)
                os.replace(part, path)
                if mtime is not None:
                    os.utime(path, (atime, mtime))
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    n = rows.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    for r in kept.filter("entry_type = 'symlink'").toLocalIterator():
        path = os.path.join(out_dir, r.target)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        if os.path.lexists(path):
            os.unlink(path)
        os.symlink(r.symlink_target or "", path)
        n += 1
    for target, mode, atime, mtime in reversed(dirs):
        path = os.path.join(out_dir, target)
        if mode is not None:
            os.chmod(path, mode & 0o777)
        if mtime is not None:
            os.utime(path, (atime, mtime))
    return n + len(dirs)


def validate(at: ArchiveTables) -> DataFrame:
    """(block_id, valid, reason) of every block that no redacted file uses.

    A checksum decides alone; an encoded block without one must decode; plain blocks without one are valid.
    """
    redacted = at.files.filter(F.col("entry_flags").bitwiseAND(REDACTED) != 0).select("file_id")
    gone = at.spans.join(redacted, "file_id", "left_semi").select("block_id").distinct()
    live = at.payloads.join(gone, "block_id", "left_anti")
    fault = udfs.block_fault(*[F.col(c) for c in ("payload", "comp_algo", "raw_size", "checksum_type", "checksum")])
    v = live.select("block_id", F.when(F.col("stored_size") != F.octet_length("payload"), "truncated").otherwise(fault).alias("reason"))
    return v.select("block_id", F.col("reason").isNull().alias("valid"), "reason")


def all_valid(at: ArchiveTables) -> DataFrame:
    return validate(at).agg(F.coalesce(F.bool_and("valid"), F.lit(True)).alias("all_valid"), F.count(F.lit(1)).alias("n_blocks"))


def redacted_blocks(files: DataFrame, spans: DataFrame, names: DataFrame) -> DataFrame:
    """(block_id) of the blocks of the regular files among ``names`` (name)."""
    hit = files.filter("entry_type = 'file'").join(names.select("name").distinct(), "name", "left_semi").select("file_id")
    return spans.join(hit, "file_id", "left_semi").select("block_id").distinct()


def redacted_files(files: DataFrame, spans: DataFrame, names: DataFrame) -> DataFrame:
    """``files`` after redaction: every file that shares a block of a named one is flagged and loses its hash."""
    hit = spans.join(redacted_blocks(files, spans, names), "block_id", "left_semi").select("file_id").distinct().withColumn("_hit", F.lit(True))
    f = files.join(hit, "file_id", "left")
    gone = F.col("_hit").isNotNull()
    flags = F.when(gone, F.col("entry_flags").bitwiseOR(REDACTED).bitwiseAND(F.lit(~int(EntryFlag.STRONG_HASH)))).otherwise(F.col("entry_flags"))
    return f.withColumn("entry_flags", flags.cast("int")).withColumn("hash", F.when(~gone, F.col("hash"))).select(*files.columns)


def redact(at: ArchiveTables, names: list[str]) -> ArchiveTables:
    """Blank the payloads of the named files' blocks and flag all files that share them.

    Encoded archives are refused, and so are unknown names. Sizes and block checksums stay as they were.
    """
    if at.blocks.filter("comp_algo <> 'none'").limit(1).count():
        raise ContentError("encoded blocks can't be redacted")
    wanted = request(at.files.sparkSession, names)
    lost = [r.name for r in missing(at.files, wanted).limit(20).collect()]
    if lost:
        raise ContentError(f"not in the archive: {', '.join(lost)}")
    gone = redacted_blocks(at.files, at.spans, wanted).withColumn("_gone", F.lit(True))
    zero = F.unhex(F.repeat(F.lit("00"), F.octet_length("payload")))
    blocks = at.blocks.join(gone, "block_id", "left").withColumn("payload", F.when(F.col("_gone"), zero).otherwise(F.col("payload"))).select(*at.blocks.columns)
    return at.with_(files=redacted_files(at.files, at.spans, wanted), blocks=blocks)
