"""Ordering vectors by similarity to a reference vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 1000
CAP = 512 << 20
#: Query vectors that a task holds at once, and rows that it compares with them at once.
BLOCK, ROWS = 4096, 128


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    scale = norm(a) * norm(b)
    return F.when(scale < 1e-8, 0.0).otherwise(dot(a, b) / scale)


def negative_square_distance(a: Column, b: Column) -> Column:
    return F.lit(0.0) - F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def reference(df: DataFrame, key: str, vector: str) -> list[float]:
    """The first vector by key, one row."""
    r = df.filter(F.col(vector).isNotNull()).orderBy(key).select(vector).first()
    return [float(x) for x in r[0]] if r else []


def similarity(df: DataFrame, key: str, vector: str, metric: str = "cosine") -> DataFrame:
    """(key, similarity) to the first vector by key."""
    ref = F.lit(reference(df, key, vector)).cast("array<double>")
    score = {"cosine": cosine, "euclidean": negative_square_distance}[metric](F.col(vector), ref)
    return df.select(key, score.alias("similarity"))


def sweep_bins(df: DataFrame, key: str, bins: int = BINS, batch: Column | None = None) -> DataFrame:
    """(batch, key, similarity, bin): bins between the least and greatest similarity of a batch; all 0 if those are equal.

    Extremes come from an aggregate that is joined back, a row per batch, so no batch has to fit one task.
    """
    d = df.withColumn("batch", (batch if batch is not None else F.lit(0)).cast("long"))
    ends = d.groupBy("batch").agg(F.min("similarity").alias("_lo"), F.max("similarity").alias("_hi"))
    d = d.join(ends, "batch")
    width = F.col("_hi") - F.col("_lo")
    at = F.least(F.lit(bins - 1), F.floor((F.col("similarity") - F.col("_lo")) / width * F.lit(float(bins - 1))).cast("int"))
    return d.select("batch", key, "similarity", F.when(width > 0, at).otherwise(0).cast("long").alias("bin"))


def vector_order(df: DataFrame, key: str, vector: str, metric: str = "cosine", bins: int = BINS, batch_size: int | None = None) -> DataFrame:
    """(position, batch, key, similarity, bin) in sweep order: bins from high to low, input order within.

    With ``batch_size`` the input is cut by position into batches that are ordered on their own and laid end to end, as a
    bounded-memory loader does; by default all rows are one batch.
    """
    from .ordering import in_order

    d = similarity(df, key, vector, metric)
    batch = None
    if batch_size:
        d = in_order(d, [key], "_row")
        batch = F.floor(F.col("_row") / batch_size)
    b = sweep_bins(d, key, bins, batch).withColumn("_down", -F.col("bin"))
    b = b.withColumn("_major", F.col("batch") * (bins + 1) + F.col("_down") + bins)
    return in_order(b, ["_major", key], "position").select("position", "batch", key, "similarity", "bin")


def batch_size(dim: int, cap: int = CAP) -> int:
    """Vectors that a capped loader holds: 20 % overhead, between a thousand and ten million."""
    return min(max(int(max(cap, 10 << 20) / (dim * 4 * 1.2)), 1000), 10_000_000)


def decode_int8(v: Column) -> Column:
    return F.transform(v, lambda x: (x / F.lit(127.0)).cast("float"))


def encode_int8(v: Column) -> Column:
    return F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x.cast("double") * 127.0).cast("int"))))


def memory_stats(df: DataFrame, vector: str, names: str | None = None) -> DataFrame:
    """One row: n_items, bytes_per_item, estimated bytes."""
    dim = F.max(F.size(vector))
    n = F.count(F.lit(1))
    extra = F.coalesce(F.sum(F.octet_length(names)), F.lit(0)) if names else F.lit(0)
    return df.agg(n.alias("n_items"), (dim * 4).cast("long").alias("bytes_per_item"), (n * dim * 4 + extra).cast("long").alias("estimated_bytes"))


def top_k(df: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10) -> DataFrame:
    """(query, key, similarity): the ``k`` nearest rows of ``df`` by cosine, then key, for every row of ``queries`` (query, vector).

    Exact, all queries against all rows in blocks: queries lie in the shared folder in blocks of ``BLOCK``, a task holds one block and
    ``ROWS`` rows at a time, and hands on at most ``k`` rows a query. Null vectors and those of another length have no neighbours.
    """
    from .ordering import in_order
    from .work import keep

    asked = in_order(queries.select("query", "vector").filter("vector IS NOT NULL"), ["query"], "_n")
    listed = keep(asked.select("query", "vector", F.floor(F.col("_n") / BLOCK).alias("block")), "queries")
    out = None
    for b in sorted(r.block for r in listed.select("block").distinct().collect()):  # one number a block
        rows = [(r["query"], r.vector) for r in listed.filter(F.col("block") == b).collect()]  # at most BLOCK
        part = _nearest(df, rows, key, vector, k)
        out = part if out is None else out.unionByName(part)
    out = out if out is not None else _nearest(df, [], key, vector, k)
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), key)
    return out.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= k).drop("_place")


def _nearest(df: DataFrame, rows: list, key: str, vector: str, k: int) -> DataFrame:
    """The ``k`` nearest rows of every task; NaN is the greatest similarity, as in Spark's order."""
    import numpy as np

    groups = {}
    for n in sorted({len(v) for _, v in rows}):
        groups[n] = np.array([q for q, v in rows if len(v) == n], np.int64), np.array([v for _, v in rows if len(v) == n], float).reshape(-1, n)

    def first(ids, names, s):
        order = np.lexsort((names, -s, ids))
        ids, names, s = ids[order], names[order], s[order]
        some = np.arange(len(ids)) - np.searchsorted(ids, ids) < k
        return ids[some], names[some], s[some]

    def run(batches):
        import pyarrow as pa

        top = {n: (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)) for n in groups}
        least = {n: np.full(len(ids), -np.inf) for n, (ids, _) in groups.items()}  # a place needs this at least
        for batch in batches:
            for from_ in range(0, batch.num_rows, ROWS):
                keys, own = (c.slice(from_, ROWS) for c in batch.columns)
                sizes = np.array([-1 if x is None else x for x in own.value_lengths().to_pylist()])
                for n, (ids, q) in groups.items():
                    at = np.flatnonzero(sizes == n)
                    if not len(at):
                        continue
                    x, names = own.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), n), keys.to_numpy()[at]
                    scale = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((x * x).sum(axis=1))[None, :]
                    s = np.where(scale < 1e-8, 0.0, (q @ x.T) / np.maximum(scale, 1e-300))
                    s[np.isnan(s)] = np.inf
                    if k and s.shape[1] >= k:
                        least[n] = np.maximum(least[n], np.partition(s, -k, axis=1)[:, -k])
                    i, j = np.nonzero(s >= least[n][:, None])
                    top[n] = first(*(np.concatenate(p) for p in zip(top[n], (i, names[j], s[i, j]), strict=True)))
        for n, (i, names, s) in top.items():
            yield pa.RecordBatch.from_arrays([pa.array(groups[n][0][i]), pa.array(names), pa.array(np.where(np.isinf(s), np.nan, s))], names=["query", key, "similarity"])

    return df.select(F.col(key).cast("long").alias(key), vector).mapInArrow(run, f"query long, {key} long, similarity double")
