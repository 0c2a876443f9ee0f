"""Comparison of two archives' files: name, logical_size, hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fmt


def diff_files(old: DataFrame, new: DataFrame, one_sided: str = "modified") -> DataFrame:
    """(path, status, old_size, new_size, old_hash, new_hash) of every name in either archive.

    Same-named entries are modified if their sizes or hashes differ. If only one side has a hash they
    count as ``one_sided``: ``modified`` as in per-file views, ``unchanged`` as in totals. Without hashes equal sizes are unchanged.
    """
    if one_sided not in ("modified", "unchanged"):
        raise ValueError(one_sided)
    side = lambda df, p: df.select(F.col("name").alias("path"), F.col("logical_size").alias(f"{p}_size"), F.lower(F.hex("hash")).alias(f"{p}_hash"), F.lit(True).alias(f"_{p}"))
    j = side(old, "old").join(side(new, "new"), "path", "full_outer")
    if one_sided == "modified":
        changed = F.coalesce("old_hash", F.lit("")) != F.coalesce("new_hash", F.lit(""))
    else:
        changed = F.coalesce(F.col("old_hash") != F.col("new_hash"), F.lit(False))
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when((F.col("old_size") != F.col("new_size")) | changed, "modified").otherwise("unchanged")
    return j.select("path", status.alias("status"), "old_size", "new_size", "old_hash", "new_hash")


def diff_stats(diff: DataFrame) -> DataFrame:
    """(status, n_files, n_bytes); bytes are old sizes but for added files."""
    size = F.when(F.col("status") == "added", F.col("new_size")).otherwise(F.col("old_size"))
    return diff.groupBy("status").agg(F.count(F.lit(1)).alias("n_files"), F.sum(size).alias("n_bytes"))


def diff_total(diff: DataFrame) -> DataFrame:
    return diff.agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("status") != "unchanged").alias("n_changed"))


def diff_lines(diff: DataFrame) -> DataFrame:
    """(path, line) of changed entries, rendered for reading."""
    sized = lambda c: F.when(F.col(c) > 0, F.concat(F.lit(" ("), fmt.format_bytes(F.col(c)), F.lit(")"))).otherwise("")
    head = lambda c: F.substring(c, 1, 8)
    sizes = F.concat(F.lit(" ("), fmt.format_bytes(F.col("old_size")), F.lit(" -> "), fmt.format_bytes(F.col("new_size")), F.lit(")"))
    hashes = F.when(F.coalesce(F.col("old_hash") != F.col("new_hash"), F.lit(False)), F.concat(F.lit(" ["), head("old_hash"), F.lit(" -> "), head("new_hash"), F.lit("]"))).otherwise("")
    line: Column = F.when(F.col("status") == "added", F.concat(F.lit("A  "), F.col("path"), sized("new_size"))).when(F.col("status") == "deleted", F.concat(F.lit("D  "), F.col("path"), sized("old_size"))).otherwise(F.concat(F.lit("M  "), F.col("path"), sizes, hashes))
    return diff.filter("status <> 'unchanged'").select("path", line.alias("line"))


def block_delta(old_blocks: DataFrame, new_blocks: DataFrame) -> DataFrame:
    """(block_id, action) turning one archive's blocks into another's: keep blocks whose payload exists, add the rest."""
    have = old_blocks.select(F.sha2("payload", 256).alias("h")).distinct().withColumn("_have", F.lit(True))
    return new_blocks.select("block_id", F.sha2("payload", 256).alias("h")).join(have, "h", "left").select("block_id", F.when(F.col("_have"), "keep").otherwise("add").alias("action"))
