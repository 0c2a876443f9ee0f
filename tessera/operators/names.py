"""Statistics over sorted name tables: front coding, tries, and the choice of an encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths

RESET = 16


def front_coding(files: DataFrame) -> DataFrame:
    """(file_id, name, prefix_len, suffix_len): bytes shared with the name before; none at every 16th.

    The name before is found by a join on the id, so no task sees the whole table. Lengths above 65,535 are an error.
    """
    f = files.select("file_id", "name")
    before = f.select((F.col("file_id") + 1).alias("file_id"), F.col("name").alias("previous"))
    j = f.join(before, "file_id", "left")
    prefix = F.when((F.col("file_id") % RESET == 0) | F.col("previous").isNull(), 0).otherwise(paths.common_prefix(F.col("previous"), F.col("name"))).cast("int")
    size = F.octet_length("name")
    j = j.select("file_id", "name", "previous", prefix.alias("prefix_len"), size.alias("_size"))
    suffix = F.when(F.col("_size") - F.col("prefix_len") > 65535, F.raise_error(F.lit("name too long for front coding")).cast("int")).otherwise(F.col("_size") - F.col("prefix_len"))
    return j.select("file_id", "name", "previous", "prefix_len", suffix.alias("suffix_len"))


def trie_nodes(files: DataFrame) -> DataFrame:
    """(prefix, depth, is_entry, n_children) of every node of the segment trie."""
    segs = paths.segments(F.col("name"))
    f = files.select(segs.alias("s")).filter("size(s) > 0")
    nodes = f.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("s")), lambda i: F.struct(F.array_join(F.slice("s", 1, i), "/").alias("prefix"), i.alias("depth"), (i == F.size("s")).alias("leaf"), F.array_join(F.slice("s", 1, i - 1), "/").alias("parent")))).alias("n")).select("n.*")
    nodes = nodes.groupBy("prefix", "depth", "parent").agg(F.max("leaf").alias("is_entry"))
    kids = nodes.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")).withColumnRenamed("parent", "prefix")
    return nodes.join(kids, "prefix", "left").select("prefix", F.col("depth").cast("long").alias("depth"), "is_entry", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"))


def size_estimates(files: DataFrame) -> DataFrame:
    """One row: n_names, is_sorted, raw_bytes, front_bytes, trie_bytes.

    The trie estimate counts what each name's path adds to its predecessor's: shared leading segments are free.
    """
    f = front_coding(files)
    seg, before = F.split("name", "/"), F.split(F.coalesce("previous", F.lit("")), "/")
    shared = F.size(F.filter(F.sequence(F.lit(1), F.size(seg)), lambda i: (F.size(before) >= i) & (F.array_join(F.slice(seg, 1, i), "/") == F.array_join(F.slice(before, 1, i), "/"))))
    shared = F.when(F.col("previous").isNull(), 0).otherwise(shared)
    new = F.slice(seg, shared + 1, F.greatest(F.size(seg) - shared, F.lit(0)))
    added = F.aggregate(F.transform(new, lambda s: F.octet_length(s) + 4), F.lit(0), lambda a, x: a + x)
    size = F.octet_length("name")
    return f.agg(
        F.count(F.lit(1)).alias("n_names"),
        F.coalesce(F.bool_and(F.col("previous").isNull() | (F.col("previous") <= F.col("name"))), F.lit(True)).alias("is_sorted"),
        (F.coalesce(F.sum(size + 4), F.lit(0)) + 4).alias("raw_bytes"),
        (F.coalesce(F.sum(F.col("suffix_len") + 4), F.lit(0)) + 8).alias("front_bytes"),
        (F.coalesce(F.sum(added), F.lit(0)) + 8).alias("trie_bytes"),
    )


def recommend_format(files: DataFrame) -> DataFrame:
    """``size_estimates`` with ``name_format``: raw below 100 names, front coding when it saves a tenth of sorted names, a trie for many names that only it halves."""
    e = size_estimates(files)
    front, trie, raw, n = F.col("front_bytes"), F.col("trie_bytes"), F.col("raw_bytes"), F.col("n_names")
    choice = F.when(n < 100, "raw").when(F.col("is_sorted") & (front <= 0.9 * raw), "front_coded").when((n >= 5000) & (trie < 0.5 * raw) & (front > 0.85 * raw), "trie").otherwise("raw")
    return e.withColumn("name_format", choice)


def is_sorted(files: DataFrame) -> DataFrame:
    return front_coding(files).agg(F.coalesce(F.bool_and(F.col("previous").isNull() | (F.col("previous") <= F.col("name"))), F.lit(True)).alias("is_sorted"))


def csr(spans: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, span_start, span_count): each file's place in the flat span list."""
    from .ordering import in_order

    n = spans.groupBy("file_id").agg(F.count(F.lit(1)).alias("span_count"))
    f = files.select("file_id").join(n, "file_id", "left").select("file_id", F.coalesce("span_count", F.lit(0)).alias("span_count"))
    return in_order(f, ["file_id"], None, {"span_start": "span_count"}).select("file_id", "span_start", "span_count")


