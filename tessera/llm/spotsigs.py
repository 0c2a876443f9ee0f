"""SpotSigs: chains of content words behind common words as document signatures.

An anchor is a very common word; each occurrence contributes one signature, the hash of the anchor and the next ``CHAIN``
content words (words that are no anchors). Boilerplate and navigation have few anchors, prose has
many. A word that belongs to no chain is a signature of its own, so that texts without anchors are told apart and no text
with a word is without signatures; the rule is local, so a small edit changes few signatures.

* ``fingerprint`` holds 32 bits of every signature of the whole set, as hex in the order of the
  64-bit hashes; similarities are exact Jaccard over the whole 64-bit sets.
* ``search`` compares the full sets of stated queries with all rows: rows are partitioned by set
  length so that only neighbouring partitions can reach the threshold, and of each set only
  the prefix that must contain a common signature is looked up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import U64, Words, mix, plain, slices, split

ANCHORS = (
    "the of and a to in is it that for was with as by on be at an are this which or from not he she they we you his her had has have will were but all there been if more when who would about can do into its than them then these so some no my our your us me him "
    "der die das und ist ein eine einer den dem des zu mit sich auf für von im nicht auch es an werden aus er hat dass sie nach wird bei um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei in ich wir ihr "
    "de la que el en y a los se del las un por con no una su para es al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre ser también me hasta hay donde quien desde todo nos durante uno ni contra ese eso mi qué "
    "le les des et en du une que est pour qui dans il au par pas sur ce plus ne se sont avec son aux ou elle mais cette ses ont été comme nous vous ils leur leurs deux même ces je on lui tout si sans y"
).split()
CHAIN = 2

_TRIM = np.zeros(256, bool)
_TRIM[list(b".,;:!?\"'()[]{}<>*%$&#")] = True
_anchor_hashes: np.ndarray | None = None


def trimmed(column: pa.LargeStringArray) -> Words:
    """Words in lower case (A-Z) without ASCII punctuation at their ends; words of nothing else are left out."""
    w = split(column)
    if not len(w.starts):
        return w
    # The last byte up to, and the first from, every place that is no such sign.
    place = np.where(_TRIM[w.buf], -1, np.arange(len(w.buf)))
    last = np.maximum.accumulate(place)
    first = np.minimum.accumulate(np.where(place < 0, len(w.buf), place)[::-1])[::-1]
    s, e = np.minimum(first[w.starts], w.ends), last[w.ends - 1] + 1
    keep = e > s
    return Words(w.buf, s[keep], e[keep], np.concatenate([[0], np.cumsum(keep)])[w.ptr])


def _anchors() -> np.ndarray:
    global _anchor_hashes
    if _anchor_hashes is None:
        _anchor_hashes = np.unique(split(pa.array([" ".join(ANCHORS)], pa.large_string())).hashes())
    return _anchor_hashes


def spot_sets(column: pa.LargeStringArray) -> Iterator[np.ndarray]:
    """Per row the sorted distinct 64-bit signature hashes."""
    w = trimmed(column)
    h, known = w.hashes(), _anchors()
    is_anchor = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(h) else np.zeros(0, bool)
    content = np.flatnonzero(~is_anchor)
    row_end = np.repeat(w.ptr[1:], np.diff(w.ptr))
    at = np.flatnonzero(is_anchor)
    nth = np.searchsorted(content, at)
    sig = h[at] * U64(0x9E3779B97F4A7C15)
    ok = np.ones(len(at), bool)
    for j in range(CHAIN):
        k = nth + j
        ok &= k < len(content)
        pos = content[np.minimum(k, len(content) - 1)] if len(content) else np.zeros(len(at), np.int64)
        ok &= pos < row_end[at]
        sig = mix(sig + h[pos] * U64(2 * j + 3)) if len(h) else sig
    alone = np.ones(len(h), bool)
    alone[at[ok]] = False
    for j in range(CHAIN):
        alone[content[nth[ok] + j]] = False
    at, sig = at[ok], sig[ok]
    bound, single = np.searchsorted(at, w.ptr), np.flatnonzero(alone)
    rest, value = np.searchsorted(single, w.ptr), mix(h[single] ^ U64(0x5B0751650))
    for d in range(len(w.ptr) - 1):
        own = np.sort(np.concatenate([sig[bound[d] : bound[d + 1]], value[rest[d] : rest[d + 1]]]))
        yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own


def sketch(s: np.ndarray) -> np.ndarray:
    """The whole set, mixed again and sorted."""
    return np.unique(mix(s))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of distinct signatures. Two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def as_text(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, halo, doc_id, text) partitioned by id range and sorted so that every row is followed by its next document.

    The order is by doc_id descending (null last), then text. Each range ends with a copy (halo) of the first
    row of the following range, the last one with the very first row. One shuffle; the driver sees one row per range.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    low = -(1 << 63)
    d = docs.select(F.coalesce("doc_id", F.lit(low)).alias("_k"), "doc_id", "text")
    cuts = sorted({int(c) for c in d.select(F.col("_k").cast("double")).approxQuantile("_k", [i / parts for i in range(1, parts)], 0.2 / parts)} if parts > 1 else set())
    bucket = F.lit(0) if not cuts else sum((F.col("_k") >= F.lit(c)).cast("int") for c in cuts)
    if len(cuts) > 64:
        bucket = F.lit(len(cuts)) - F.size(F.filter(F.lit(cuts), lambda c: c > F.col("_k")))
    d = d.withColumn("bucket", -bucket)  # rises as doc_id falls
    tops = sorted((r.bucket, r.top) for r in d.groupBy("bucket").agg(F.max("_k").alias("top")).collect())
    follow = {top: tops[i - 1][0] for i, (_, top) in enumerate(tops)}
    if follow:
        to = F.create_map(*[F.lit(x) for kv in follow.items() for x in kv])
        d = d.withColumn("_to", F.try_element_at(to, F.col("_k")))
    else:
        d = d.withColumn("_to", F.lit(None).cast("int"))
    own = F.struct(F.col("bucket"), F.lit(0).alias("halo"))
    halo = F.struct(F.col("_to").alias("bucket"), F.lit(1).alias("halo"))
    d = d.select("_k", "doc_id", "text", F.explode(F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, halo))).alias("_p"))
    d = d.select("_p.bucket", "_p.halo", "_k", "doc_id", "text").repartition(parts, "bucket").sortWithinPartitions("bucket", "halo", F.desc("_k"), "text")
    return d.select("bucket", "halo", "doc_id", "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """SCHEMA for each row of ``docs`` (doc_id, text, any others).

    The edited text has its last half (rounded down, in code points) replaced by the first as many code points of the next document by
    descending doc_id; the next of the last is the first. Null text is empty, with an empty fingerprint. Rows of
    equal doc_id follow each other by text, null doc_ids come last. A lone row is its own next. An empty table
    gives an empty result. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # (halo, doc_id, text, sketch) of the row before
        for batch in batches:
            halos, ids, column = batch.column(1).to_pylist(), batch.column(2).to_pylist(), plain(batch.column(3))
            for lo, hi in slices(column, 2 << 20):
                texts = column.slice(lo, hi - lo).to_pylist()
                rows = list(zip(halos[lo:hi], ids[lo:hi], texts, map(sketch, spot_sets(column.slice(lo, hi - lo))), strict=True))
                if last is not None:
                    rows.insert(0, last)
                last = rows[-1]
                pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[0]]
                edited = [a[2][: len(a[2]) - len(a[2]) // 2] + b[2][: len(a[2]) // 2] for a, b in pairs]
                prints = list(map(sketch, spot_sets(pa.array(edited, pa.large_string()))))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([a[1] for a, _ in pairs], pa.int64()),
                        pa.array([len(a[2]) for a, _ in pairs], pa.int64()),
                        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                        pa.array([as_text(a[3]) for a, _ in pairs], pa.string()),
                        pa.array([as_text(p) for p in prints], pa.string()),
                        pa.array([likeness(a[3], p) for (a, _), p in zip(pairs, prints, strict=True)], pa.float64()),
                        pa.array([likeness(a[3], b[3]) for a, b in pairs], pa.float64()),
                    ],
                    names=[c.split()[0] for c in SCHEMA.split(", ")],
                )

    return with_next(docs).mapInArrow(run, SCHEMA)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n, sigs) of each row: its spot signatures, sorted; null and blank texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = plain(batch.column(1))
            for lo, hi in slices(column):
                sets = [s.view(np.int64) for s in spot_sets(column.slice(lo, hi - lo))]
                at = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at).astype(np.int64)), pa.ListArray.from_arrays(at, np.concatenate([*sets, np.zeros(0, np.int64)]))], names=["doc_id", "n", "sigs"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, sigs array<long>")


def search(docs: DataFrame, queries: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(query_id, doc_id, jaccard) of all pairs of ``queries`` and ``docs`` (both doc_id, text) at ``similarity`` or more.

    A row isn't paired with an equal id; null ids and texts without signatures pair with nothing. Partition k holds set lengths from
    (1 / similarity)^k on, so partners lie in the same or a neighbouring partition. Any two such
    sets share one of the first n - ceil(similarity * n) + 1 signatures of each in any common order.
    """

    def prepared(d: DataFrame) -> DataFrame:
        s = signatures(d).filter("n > 0 AND doc_id IS NOT NULL").dropDuplicates(["doc_id", "sigs"])
        return s.withColumn("part", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / similarity)) + 1e-9).cast("int")).withColumn("head", F.expr(f"slice(sigs, 1, cast(n - ceil({similarity}D * n - 1e-9D) + 1 AS int))"))

    q = prepared(queries).select(F.col("doc_id").alias("query_id"), F.col("n").alias("qn"), F.col("sigs").alias("qs"), F.explode(F.expr("array(part - 1, part, part + 1)")).alias("part"), "head")
    q = q.select("query_id", "qn", "qs", "part", F.explode("head").alias("sig"))
    d = prepared(docs).select("doc_id", "n", "sigs", "part", F.explode("head").alias("sig"))
    both = F.size(F.array_intersect("qs", "sigs"))
    pairs = q.join(d, ["part", "sig"]).filter((F.col("query_id") != F.col("doc_id")) & (F.least("qn", "n") >= F.greatest("qn", "n") * similarity - 1e-9))
    # The pair is kept where its least common head signature is met, so it comes once.
    pairs = pairs.filter(F.col("sig") == F.array_min(F.array_intersect(F.expr(f"slice(qs, 1, cast(qn - ceil({similarity}D * qn - 1e-9D) + 1 AS int))"), F.expr(f"slice(sigs, 1, cast(n - ceil({similarity}D * n - 1e-9D) + 1 AS int))"))))
    return pairs.select("query_id", "doc_id", (both / (F.col("qn") + F.col("n") - both)).cast("double").alias("jaccard")).filter(F.col("jaccard") >= similarity - 1e-12)


def op5_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
