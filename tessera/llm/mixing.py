"""Mixing sources to target weights by systematic sampling.

Each source receives a target number of words. All documents of a source have the same
expected number of copies, ``target / source size``. Laid end to end in the order of their
size, those expectations are a prefix sum; after one random offset per source, a document is
emitted once for every integer boundary its interval crosses. The order by size keeps the
words taken within about one document of the target.

Ranks inside a source never need one task to hold the source: documents are ranked within
(source, size class, salt) and shifted by a prefix sum over the few counted classes, so a
source with a third of all rows is spread over as many tasks as it has classes and salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import save, workspace

WEIGHTS = (5.0, 2.0, 1.0)
#: No document is taken more often than this.
MOST_COPIES = 3
#: Each (source, size class) is ranked in so many independent parts.
SALTS = 64
#: Sizes up to this form a class each; larger ones share 16 classes an octave.
EXACT_SIZES = 1024
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of runs of non-ASCII-white-space characters; null counts 0."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.regexp_replace(squeezed, r"[\x20\x09-\x0D]+", "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size) -> plus ``target``: shares of the total by weight, at most ``most`` sizes.

    Sources by code point, null last, take the weights in turn. Sources in the order of
    cap / weight reach their caps first. With the first k of them capped, the others' level would be
    ``(total - caps) / weights left``; it rises with k up to the true one and falls after it,
    so the level L with ``sum(min(cap, L * weight)) = total`` is the greatest. The table has one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("w", pick).withColumn("cap", (F.col("source_size") * most).cast("double"))
    t = t.withColumn("ratio", F.col("cap") / F.col("w"))
    t = t.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    t = t.withColumn("water", F.max("level").over(whole))
    return t.select("source", "source_size", F.least("cap", F.coalesce(F.col("water"), F.lit(0.0)) * F.col("w")).alias("target"))


def _size_class(size: Column) -> Column:
    octave = F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")))
    fine = F.floor(size / F.pow(F.lit(2.0), octave) * 16)
    return F.when(size <= EXACT_SIZES, size).otherwise((EXACT_SIZES + octave * 16 + fine).cast("long"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: str = SEED) -> DataFrame:
    """``docs`` (doc_id, text, source, any others) with size, source_size, target, copies, taken.

    Every input row is returned once, with ``copies`` saying how often the mix takes it and
    ``taken = copies * size``. Null text has size 0 and is never worth copies to the target but
    may have some; a null source is a source of its own; repeated rows are ranked
    one after another; an empty table gives an empty result. Columns of ``docs`` with the names
    of the new ones are replaced. Equal input gives equal output whatever the partitioning.
    """
    new = ("size", "source_size", "target", "copies", "taken")
    kept = [c for c in docs.columns if c.lower() not in new]
    out = _ranked(_sized(docs, F.struct(*kept)), weights, most, seed)
    return out.select(*[F.col("row")[c].alias(c) for c in kept], *new)


def repeated(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: str = SEED) -> DataFrame:
    """The rows of ``docs``, all columns as they are, each as many times as the mix takes it."""
    out = _ranked(_sized(docs, F.struct(*docs.columns)), weights, most, seed).filter("copies > 0")
    out = out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def _sized(docs: DataFrame, row: Column) -> DataFrame:
    """(doc_id, source, size, salt, tie, row): the salt is a hash of id and text, so neither a repeated id nor copies of a text share one part."""
    whole = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    salt = F.conv(F.substring(F.md5(whole.cast("binary")), 1, 4), 16, 10).cast("int") % SALTS
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), salt.alias("salt"), F.xxhash64("text").alias("tie"), row.alias("row"))


def _ranked(sized: DataFrame, weights: tuple[float, ...], most: int, seed: str) -> DataFrame:
    """(doc_id, source, size, row) of ``sized`` with source_size, target, copies, taken."""
    # Null and other sources have keys that begin differently, so that windows and joins share one plain hash partitioning.
    key = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source")))
    d = sized.select(key.alias("_key"), "doc_id", "source", "size", _size_class(F.col("size")).alias("_class"), F.col("salt").alias("_salt"), "tie", "row")
    counts = d.groupBy("_key", "_class", "_salt").agg(F.first("source").alias("source"), F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_words"))
    plan = targets(counts.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, most).withColumn("_key", key)
    along = Window.partitionBy("_key").orderBy("_class", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.col("_key")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    starts = counts.select("_key", "_class", "_salt", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"))
    starts = starts.join(plan.drop("source"), "_key").withColumn("_e", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumn("_u", u)
    within = Window.partitionBy("_key", "_class", "_salt").orderBy("size", F.col("doc_id").asc_nulls_last(), "tie")
    j = d.withColumn("_rn", F.row_number().over(within)).join(starts, ["_key", "_class", "_salt"])
    rank = F.col("_before") + F.col("_rn")
    copies = (F.floor(F.col("_e") * rank + F.col("_u")) - F.floor(F.col("_e") * (rank - 1) + F.col("_u"))).cast("long")
    # A product that rounds across an integer may add a crossing; never go above the stated most.
    j = j.withColumn("copies", F.least(copies, F.lit(most).cast("long")))
    return j.select("doc_id", "source", "row", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op10_mix_sources(spark, sf_dir: str) -> DataFrame:
    """The mix over all documents; the texts are counted once and never moved."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = save(_sized(docs, F.lit(0)), f"{workspace(spark, 'mix')}/sizes")
    out = _ranked(sized, WEIGHTS, MOST_COPIES, SEED)
    return out.select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]+', '', 'g')) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 4))::INTEGER % 64 AS salt
  FROM documents),
c AS (
  SELECT *, CASE WHEN size <= 1024 THEN size ELSE CAST(1024 + floor(log2(greatest(size, 1))) * 16 + floor(size / pow(2.0, floor(log2(greatest(size, 1)))) * 16) AS BIGINT) END AS class
  FROM d),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM c GROUP BY source),
r AS (SELECT *, CAST(3 * source_size AS DOUBLE) AS cap, CAST(3 * source_size AS DOUBLE) / w AS ratio FROM s),
l AS (
  SELECT *, ((SELECT sum(CAST(source_size AS DOUBLE)) FROM s) - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
          / ((SELECT sum(w) FROM s) - coalesce(sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) AS level
  FROM r),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT max(level) FROM l), 0.0::DOUBLE) * w) AS target FROM l),
k AS (
  SELECT c.*, row_number() OVER (PARTITION BY source ORDER BY class, salt, size, doc_id NULLS LAST) AS rn FROM c),
e AS (
  SELECT k.doc_id, k.size, t.source_size, t.target, k.rn, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS e,
         CAST(('0x' || substr(md5('mix-1|' || coalesce('1' || k.source, '0')), 1, 8))::UBIGINT AS DOUBLE) / 4294967296.0::DOUBLE AS u
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(least(floor(e * rn + u) - floor(e * (rn - 1) + u), 3) AS BIGINT) * size AS taken FROM e
"""
