"""Global ordinals and running sums without a single-task sort.

A row_number over the whole table would put every row into one task. Here rows fall into value ranges
whose bounds come from a bounded sample, ranges are ranked independently, and the counts and sums of the ranges before
(one row each, so they may be broadcast) are added. Bounds are literals: recomputed partitions agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sampled keys per range.
SAMPLE = 32


def range_of(df: DataFrame, by: Sequence[str], parts: int | None = None) -> Column:
    """The number of sampled bounds at or below the row's key; nulls come first.

    All of ``by`` make the key, so rows that share its first column still spread over ranges. Bounds are looked up in
    two steps, a row among every ``k``-th bound and then among ``k``, not one after the other.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*by) if len(by) > 1 else F.col(by[0])
    sample = df.select(*by).filter(F.col(by[0]).isNotNull()).orderBy(F.xxhash64(*by), *by).limit(SAMPLE * parts).select(key.alias("k")).distinct().orderBy("k")
    keys = [r.k for r in sample.collect()]  # at most SAMPLE a range
    bounds = keys[:: max(1, len(keys) // parts)][1:]
    if not bounds:
        return F.lit(0)
    kind = df.select(key.alias("k")).schema["k"].dataType
    literal = lambda k: (F.struct(*[F.lit(v) for v in k]) if len(by) > 1 else F.lit(k)).cast(kind)
    listed = lambda ks: F.array(*[literal(k) for k in ks])
    below = lambda array: F.size(F.filter(array, lambda b: b <= key))
    step = max(1, int(len(bounds) ** 0.5))
    if len(bounds) <= 64:
        return below(listed(bounds))
    first = below(listed(bounds[::step]))
    return F.when(first == 0, 0).otherwise((first - 1) * step + below(F.slice(listed(bounds), (first - 1) * step + 1, step)))


def in_order(df: DataFrame, by: Sequence[str], ordinal: str | None = None, sums: dict[str, str] | None = None, parts: int | None = None) -> DataFrame:
    """``df`` with the 0-based position in the order of ``by`` and exclusive running sums.

    ``sums`` maps new columns to the summed ones. Nulls come first; ties in ``by`` are in any order.
    """
    sums = sums or {}
    d = df.withColumn("_range", range_of(df, by, parts))
    per = d.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(v).alias(f"_t_{k}") for k, v in sums.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    zero = lambda c: F.coalesce(c, F.lit(0))
    base = per.select("_range", zero(F.sum("_n").over(before)).alias("_b"), *[zero(F.sum(f"_t_{k}").over(before)).alias(f"_b_{k}") for k in sums])
    w = Window.partitionBy("_range").orderBy(*by)
    for k, v in sums.items():
        d = d.withColumn(k, zero(F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, -1))))
    if ordinal:
        d = d.withColumn(ordinal, F.row_number().over(w))
    d = d.join(F.broadcast(base), "_range")
    if ordinal:
        d = d.withColumn(ordinal, (F.col("_b") + F.col(ordinal) - 1).cast("long"))
    for k in sums:
        d = d.withColumn(k, (F.col(f"_b_{k}") + F.col(k)).cast("long"))
    return d.drop("_range", "_b", *[f"_b_{k}" for k in sums])
