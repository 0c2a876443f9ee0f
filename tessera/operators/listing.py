"""Listings and summaries of an archive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fmt, paths
from .archive import ArchiveTables


def list_entries(files: DataFrame) -> DataFrame:
    mode = F.coalesce(F.col("mode"), paths.default_mode(F.col("entry_type")))
    return files.select("file_id", "name", "entry_type", "logical_size", fmt.format_mode(mode, F.col("entry_type")).alias("mode_text"))


def list_plain(files: DataFrame) -> DataFrame:
    return files.select("file_id", paths.plain_name(F.col("name"), F.col("entry_type")).alias("line"))


def list_table(files: DataFrame) -> DataFrame:
    """Fixed-width lines: mode, owner, size, time, name."""
    mode = F.coalesce(F.col("mode"), paths.default_mode(F.col("entry_type")))
    link = F.when(F.col("entry_type") == "symlink", F.concat(F.lit(" -> "), F.coalesce("symlink_target", F.lit("")))).otherwise("")
    line = F.concat_ws(" ", fmt.format_mode(mode, F.col("entry_type")), F.lpad(F.coalesce("uid", F.lit(0)).cast("string"), 5, " "), F.lpad(F.coalesce("gid", F.lit(0)).cast("string"), 5, " "), F.lpad(F.col("logical_size").cast("string"), 12, " "), F.date_format(F.timestamp_seconds(F.coalesce("mtime", F.lit(0))), "yyyy-MM-dd HH:mm"), F.concat(F.col("name"), link))
    return files.select("file_id", line.alias("line"))


def list_json(files: DataFrame) -> DataFrame:
    return files.select("file_id", F.to_json(F.struct("name", F.col("entry_type").alias("type"), F.col("logical_size").alias("size"))).alias("line"))


def totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("n_entries"), F.coalesce(F.sum("logical_size"), F.lit(0)).alias("total_size"))


def by_type(files: DataFrame) -> DataFrame:
    return files.groupBy("entry_type").agg(F.count(F.lit(1)).alias("n_entries"), F.sum("logical_size").alias("total_size"))


def header_summary(at: ArchiveTables) -> DataFrame:
    """One row: counts of files and blocks, layout label by the first entry, sizes, greatest block id."""
    first = F.min(F.struct("file_id", "entry_type", "name"))["entry_type"]
    f = at.files.agg(F.count(F.lit(1)).alias("n_files"), F.when(first == "dir", "directory-based").when(first == "file", "mixed").otherwise("other").alias("layout"))
    b = at.blocks.agg(F.count(F.lit(1)).alias("n_blocks"), F.max("block_id").alias("max_block_id"), F.sum("raw_size").alias("raw_size"), F.sum("stored_size").alias("stored_size"))
    return f.crossJoin(b)  # one row each


def single_file_block_index(files: DataFrame) -> DataFrame:
    """(file_id, block_index): how many regular files come before a regular file."""
    from .ordering import in_order

    f = files.select("file_id", F.when(F.col("entry_type") == "file", 1).otherwise(0).alias("is_file"))
    return in_order(f, ["file_id"], None, {"block_index": "is_file"}).filter("is_file = 1").select("file_id", "block_index")


def depth_histogram(files: DataFrame) -> DataFrame:
    return files.groupBy(F.size(paths.segments(F.col("name"))).cast("long").alias("depth")).agg(F.count(F.lit(1)).alias("n_entries"))


def directory_sizes(files: DataFrame) -> DataFrame:
    """(directory, n_files, total_size) over all files below each directory."""
    parts = F.split("name", "/")
    up = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    f = files.filter("entry_type = 'file'").select("logical_size", F.explode(up).alias("directory"))
    return f.groupBy("directory").agg(F.count(F.lit(1)).alias("n_files"), F.sum("logical_size").alias("total_size"))
