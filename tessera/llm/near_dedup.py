"""Near-duplicate documents: MinHash bands propose, odd sketches sieve, full sets decide.

A document is the set of its distinct word shingles (64-bit hashes; two different shingles of
a pair collide with probability 2^-64). From 128 MinHash samples come

* 32 band keys of 4 samples: a pair at similarity 0.85 shares no band with probability
  (1 - 0.85^4)^32 < 1e-10, at 0.8 with 5e-8;
* an odd sketch: every (sample number, value) flips one of 512 bits. The XOR of two sketches
  has one parity bit per differing sample pair, so its population count estimates
  similarities near 1 far better than its size suggests.

A candidate is sieved by ``bit_count`` of the XOR at 0.22 below the threshold (over five
standard deviations) and then decided on both full sets.

Equal sets are one node from the start, so exact copies never meet. Candidates come in two rounds.
First each bucket's members meet only the bucket's least member. Once those links' components are known, a bucket
that lies inside one component is done. In the others only pairs of different components remain;
buckets are cut into blocks of about ``BLOCK`` members whose pairs meet in separate
partitions, and the sieve is part of the join, so refused pairs are never emitted. All pairs
that share a bucket are thus linked, refused or already connected: no bucket is capped.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import posix, put, save, workspace
from .textkit import U64, Words, mix, plain, slices, split

SAMPLES, BANDS, BITS = 128, 32, 512
ROWS = SAMPLES // BANDS
MARGIN = 0.22
BLOCK = 512

_rng = np.random.default_rng(20240607)
_MUL = (_rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint64) | U64(1)).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)
_LANE = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_POS = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) | U64(1)

SKETCH = "doc_id long, n_shingles long, sid long, sid2 long, bands array<long>, odd array<long>"
_SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("sid", pa.int64()), ("sid2", pa.int64()), ("bands", pa.list_(pa.int64())), ("odd", pa.list_(pa.int64()))])


def shingle_sets(words: Words, width: int) -> Iterator[np.ndarray]:
    """Per row the sorted distinct hashes of its ``width``-word shingles.

    A row of fewer words has one, its whole sequence; a row without words has none.
    """
    h, ptr = words.hashes(), words.ptr
    run = np.zeros(0, U64)
    if len(h) >= width:
        run = np.zeros(len(h) - width + 1, U64)
        for j in range(width):
            run += h[j : len(h) - width + 1 + j] * _POS[j]
        run = mix(run)
    for d in range(len(ptr) - 1):
        lo, hi = int(ptr[d]), int(ptr[d + 1])
        if hi - lo >= width:
            s = np.sort(run[lo : hi - width + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif hi > lo:
            yield mix(np.array([np.sum(h[lo:hi] * _POS[: hi - lo], dtype=U64) + U64(hi - lo)]))
        else:
            yield np.zeros(0, U64)


def min_hashes(s: np.ndarray) -> np.ndarray:
    """The least value of each of the sample functions over a set."""
    x = (s >> U64(32)).astype(np.uint32)
    best = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(best, (x[None, at : at + 1024] * _MUL[:, None] + _ADD[:, None]).min(axis=1), out=best)
    return best


def bands_and_odd(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, SAMPLES) values -> (documents, BANDS) keys and (documents, BITS / 64) sketch words."""
    n = len(sig)
    lanes = sig.astype(U64) * (_LANE | U64(1)) + _LANE
    keys = mix(lanes.reshape(n, BANDS, ROWS).sum(axis=2, dtype=U64))
    bit = (mix(lanes) % U64(BITS)).astype(np.int64) + np.arange(n)[:, None] * BITS
    odd = np.bincount(bit.ravel(), minlength=n * BITS).astype(np.uint8) & 1
    return keys.view(np.int64), np.packbits(odd.reshape(n, BITS), axis=1).view(np.int64)


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text = batch.column(0), plain(batch.column(1))
            for lo, hi in slices(text):
                sets = list(shingle_sets(split(text.slice(lo, hi - lo)), width))
                n = np.array([len(s) for s in sets], np.int64)
                sid = np.array([np.sum(s, dtype=U64) for s in sets], U64)
                sid2 = np.array([np.sum(mix(s), dtype=U64) for s in sets], U64)
                keys, odd = bands_and_odd(np.stack([min_hashes(s) for s in sets]))
                at = np.arange(hi - lo + 1, dtype=np.int32)
                cols = [ids.slice(lo, hi - lo), pa.array(n), pa.array((mix(sid) ^ n.astype(U64)).view(np.int64)), pa.array(sid2.view(np.int64))]
                cols += [pa.ListArray.from_arrays(at * BANDS, keys.ravel()), pa.ListArray.from_arrays(at * (BITS // 64), odd.ravel())]
                yield pa.RecordBatch.from_arrays(cols, schema=_SKETCH)

    return run


def most_odd_bits(similarity: float) -> int:
    """The XOR population count expected at ``similarity``."""
    return int(np.ceil(BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * SAMPLES * (1 - similarity)))))


def _odd_distance(a: str, b: str) -> Column:
    return F.expr("+".join(f"bit_count({a}[{i}] ^ {b}[{i}])" for i in range(BITS // 64)))


def _sets_of(docs: DataFrame, ids: DataFrame, width: int, path: str) -> DataFrame:
    """(sid, hashes binary) of the nodes in ``ids`` (doc_id, sid), read again from the texts.

    The wanted ids lie in the shared folder, one sorted array for each remainder of the id, and are memory-mapped: the
    texts are filtered where they are read and never shuffled, and a row is looked up in one array only.
    """
    folder = posix(path)
    n_buckets = min(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1, 8191)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1) for b in batches if b.num_rows]
        rows = np.concatenate(parts) if parts else np.zeros((0, 2), np.int64)
        rows = rows[np.lexsort((rows[:, 0], rows[:, 0] % n_buckets))]
        bound = np.searchsorted(rows[:, 0] % n_buckets, np.arange(n_buckets + 1))
        for k in np.flatnonzero(np.diff(bound)):
            put(f"{folder}/{k}.ids", np.ascontiguousarray(rows[bound[k] : bound[k + 1]].T).tobytes())
        yield pa.RecordBatch.from_pydict({"n": [len(rows)]})

    os.makedirs(folder, exist_ok=True)
    ids.select("doc_id", "sid").repartition(F.pmod("doc_id", F.lit(n_buckets))).mapInArrow(store, "n long").write.format("noop").mode("overwrite").save()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, np.ndarray] = {}

        def wanted(k: int) -> np.ndarray:
            if k not in maps:
                name = f"{folder}/{k}.ids"
                maps[k] = np.memmap(name, np.int64, "r").reshape(2, -1) if os.path.exists(name) else np.zeros((2, 0), np.int64)
            return maps[k]

        for batch in batches:
            doc = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy()
            bucket = doc % n_buckets
            first, end = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
            for k in np.unique(bucket):
                own = bucket == k
                first[own], end[own] = np.searchsorted(wanted(k)[0], doc[own]), np.searchsorted(wanted(k)[0], doc[own], "right")
            at = np.flatnonzero(end > first)
            text = plain(batch.column(1).take(pa.array(at)))
            for lo, hi in slices(text):
                out: dict[str, list] = {"sid": [], "hashes": []}
                for d, s in zip(at[lo:hi], shingle_sets(split(text.slice(lo, hi - lo)), width), strict=True):
                    sid = int((mix(np.array([np.sum(s, dtype=U64)])) ^ U64(len(s))).view(np.int64)[0])
                    if sid in wanted(int(bucket[d]))[1, first[d] : end[d]]:
                        out["sid"].append(sid)
                        out["hashes"].append(s.tobytes())
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("sid", pa.int64()), ("hashes", pa.binary())]))

    return docs.select("doc_id", "text").mapInArrow(read, "sid long, hashes binary")


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                if len(s) > len(t):
                    s, t = t, s
                both = int(np.count_nonzero(t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, width: int, percent: int, path: str) -> DataFrame:
    """Those of ``pairs`` (a, b node ids) whose full sets are similar enough."""
    pairs = save(pairs, f"{path}/pairs")
    ids = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct().join(nodes.select("sid", "rep"), "sid").select(F.col("rep").alias("doc_id"), "sid")
    sets = save(_sets_of(docs, ids, width, f"{path}/ids").dropDuplicates(["sid"]), f"{path}/sets")
    a, b = sets.select(F.col("sid").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("sid").alias("b"), F.col("hashes").alias("y"))
    joined = pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y")
    return save(joined.mapInArrow(_confirm(percent), "a long, b long"), f"{path}/links")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text, any others).

    Rows are linked when ``100 * |A & B| >= percent * |A | B|`` of their shingle sets;
    ``component_id`` is the least doc_id reachable and ``kept`` marks that document. Null or
    blank text has an empty set and is linked with nothing. Rows with one doc_id are one
    document: a link of any of them holds for all. A null doc_id takes no part (null component, kept).
    An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    path = workspace(spark, "near")
    docs = docs.select("doc_id", "text")
    sketch = save(docs.mapInArrow(_sketch(width), SKETCH), f"{path}/sketch")
    full = sketch.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    first = full.groupBy("sid", "sid2").agg(F.min("doc_id").alias("doc_id"))
    nodes = save(full.join(first, ["sid", "sid2", "doc_id"]).dropDuplicates(["sid"]).select("sid", F.col("doc_id").alias("rep"), "bands", "odd"), f"{path}/nodes")

    members = nodes.select("sid", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("sid").alias("least")).filter("n > 1")
    met = save(members.join(buckets, "key"), f"{path}/met")
    odd = nodes.select("sid", "odd")
    star = met.filter("sid <> least").select(F.col("least").alias("a"), F.col("sid").alias("b")).distinct()
    star = star.join(odd.toDF("a", "oa"), "a").join(odd.toDF("b", "ob"), "b").filter(_odd_distance("oa", "ob") <= most_odd_bits(percent / 100 - MARGIN)).select("a", "b")
    several = full.groupBy("doc_id").agg(F.min("sid").alias("a"), F.max("sid").alias("z")).filter("a <> z").select("doc_id", "a")
    same_doc = full.select("doc_id", F.col("sid").alias("b")).join(several, "doc_id").filter("a <> b").select("a", "b").distinct()
    links = _verified(docs, star, nodes, width, percent, f"{path}/star").union(same_doc)
    label = components(links, f"{path}/first")

    lab = met.filter("n > 2").join(label, met.sid == label.node, "left").select("key", "n", "least", "sid", F.coalesce("label", "sid").alias("c"))
    split_up = lab.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).filter("c1 <> c2").select("key")
    rest = lab.filter("sid <> least").join(split_up, "key").join(odd, "sid")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rest = rest.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("sid"), "blocks").cast("int"))
    rest = rest.select("key", "sid", "c", "odd", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    # A member of block i stands on the left of cell (i, j) for j >= i and on the right of cell (j, i) for j <= i.
    left = rest.filter("block <= other").select("key", F.col("block").alias("i"), F.col("other").alias("j"), F.col("sid").alias("a"), F.col("c").alias("ca"), F.col("odd").alias("oa"))
    right = rest.filter("other <= block").select("key", F.col("other").alias("i"), F.col("block").alias("j"), F.col("sid").alias("b"), F.col("c").alias("cb"), F.col("odd").alias("ob"))
    near = left.join(right, ["key", "i", "j"]).filter((F.col("ca") != F.col("cb")) & ((F.col("i") < F.col("j")) | (F.col("a") < F.col("b")))).filter(_odd_distance("oa", "ob") <= most_odd_bits(percent / 100 - MARGIN))
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = _verified(docs, near, nodes, width, percent, f"{path}/rest")
    label = components(links.union(more), f"{path}/second")

    out = sketch.select("doc_id", "n_shingles", "sid").alias("s").join(label.alias("l"), (F.col("s.sid") == F.col("l.node")) & (F.col("s.n_shingles") > 0), "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("label", "s.sid")).alias("label"))
    out = save(out, f"{path}/labelled")
    least = out.filter("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("least"))
    # Rows without words belong to their doc_id alone, unless another row of that id is linked.
    by_doc = out.join(least, "label", "left").groupBy("doc_id").agg(F.min("least").alias("least")).filter("doc_id IS NOT NULL")
    out = out.alias("o").join(by_doc.alias("d"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.least("doc_id", "least").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Components at 3-word shingles and similarity 0.85 over all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, percent=85)
