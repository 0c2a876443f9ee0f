"""Packing token sequences by length patterns fitted with non-negative least squares.

Only the histogram of piece lengths reaches the driver: at most ``capacity`` counts, whatever
the corpus. Patterns of one to four pieces that fill a sequence exactly are enumerated, repeat
counts are fitted to the histogram by projected gradient steps (non-negative least squares),
rounded down to what is there, and the residual counts are packed best-fit decreasing, again by
length and not by piece. The plan then says for each length which rank goes to which sequence
and offset. Ranks are taken within (length, salt), so a length that a third of all pieces share
is spread over ``SALTS`` groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import lexicon
from .shared import posix, put, save, workspace
from .textkit import plain, slices

CAPACITY = 2048
END_ID = 0
SALTS = 64
#: Second members tried with every first length, and quarter-grid third members.
SECOND, THIRD, STEPS = 48, 6, 400

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def patterns(counts: np.ndarray) -> np.ndarray:
    """Candidate patterns as rows of four lengths (0: unused) that sum to the capacity exactly.

    All pairs; triples and quadruples of every length with evenly spread others, so the number is bounded by
    the capacity alone (about a hundred thousand) and not by the corpus.
    """
    cap = len(counts) - 1
    have = np.flatnonzero(counts[:cap])
    have = have[have > 0]
    if not len(have):
        return np.zeros((0, 4), np.int64)
    second = have[np.unique(np.linspace(0, len(have) - 1, SECOND).astype(int))]
    third = have[np.unique(np.linspace(0, len(have) // 2, THIRD).astype(int))]
    zero = np.zeros(1, np.int64)
    rows = []
    for b, c in ((zero, zero), (second, zero), (second, third)):
        a, b, c = (x.ravel() for x in np.meshgrid(have, b, c, indexing="ij"))
        d = cap - a - b - c
        ok = (d > 0) & (counts[np.maximum(d, 0)] > 0)
        rows.append(np.sort(np.stack([a, b, c, d], 1)[ok], axis=1))
    return np.unique(np.concatenate(rows), axis=0)[:, ::-1]


def fit(rows: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative repeats x that bring the patterns' lengths close to ``counts``.

    Accelerated projected gradient on |A x - counts|^2, A[l, p] the times pattern p uses length l.
    """
    if not len(rows):
        return np.zeros(0)
    cap = len(counts)
    target = counts.astype(float)
    target[0] = 0

    def forward(x):
        y = np.bincount(rows.ravel(), np.repeat(x, rows.shape[1]), cap)
        y[0] = 0
        return y

    def back(r):
        r = r.copy()
        r[0] = 0
        return r[rows].sum(axis=1)

    # A bound of the largest eigenvalue of A'A by power iteration.
    v = np.ones(len(rows))
    for _ in range(12):
        v = back(forward(v))
        v /= np.linalg.norm(v) or 1.0
    rate = 1.0 / (1.05 * max(1.0, float(np.linalg.norm(back(forward(v))))))
    x = z = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0.0, z - rate * back(forward(z) - target))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths in order, sequences)] that holds every counted piece once."""
    cap = len(counts) - 1
    left = counts.astype(np.int64).copy()
    out = [((cap,), int(left[cap]))] if left[cap] else []
    left[cap] = left[0] = 0
    rows = patterns(left)
    x = fit(rows, left)
    for i in np.argsort(-x, kind="stable"):
        lengths = [int(v) for v in rows[i] if v]
        n = int(np.floor(x[i] + 1e-9))
        if n < 1:
            break
        for v in set(lengths):
            n = min(n, int(left[v]) // lengths.count(v))
        if n > 0:
            for v in lengths:
                left[v] -= n
            out.append((tuple(lengths), n))
    return out + best_fit(left)


def best_fit(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: runs of equal sequences, kept by their free space."""
    cap = len(left) - 1
    free: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    spaces: list[int] = []
    import bisect

    def push(space: int, run: tuple[int, ...], n: int) -> None:
        if space not in free:
            free[space] = []
            bisect.insort(spaces, space)
        free[space].append((run, n))

    for v in range(cap, 0, -1):
        n = int(left[v])
        while n:
            at = bisect.bisect_left(spaces, v)
            if at < len(spaces):
                space = spaces[at]
                run, k = free[space].pop()
                if not free[space]:
                    del free[space]
                    spaces.pop(at)
                used = min(n, k)
                if k > used:
                    push(space, run, k - used)
                push(space - v, (*run, v), used)
                n -= used
            else:
                many = cap // v
                full, rest = divmod(n, many)
                if full:
                    push(cap - many * v, (v,) * many, full)
                if rest:
                    push(cap - rest * v, (v,) * rest, 1)
                n = 0
    return [(run, k) for runs in free.values() for run, k in runs]


def slots(sequences: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Columns (length, first rank, first sequence, offset), sorted; one for each place in a pattern."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for lengths, n in sequences:
        at = 0
        for v in lengths:
            rows.append((v, taken.get(v, 0), base, at))
            taken[v] = taken.get(v, 0) + n
            at += v
        base += n
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 4)


def pieces(docs: DataFrame, tokenizer: str, folder: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """PIECES of every document: its ids, then ``end_id``; cut only where longer than the capacity."""
    docs = docs.select("doc_id", "text")
    lexicon.build(docs, folder, tokenizer)
    bits, root = lexicon.buckets_of(docs.sparkSession), posix(folder)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon.Lexicon.open(root, tokenizer)
        for batch in batches:
            doc, text = batch.column(0), plain(batch.column(1))
            for lo, hi in slices(text):
                w = lexicon.units(text.slice(lo, hi - lo))
                ids, size = lex.encode(w, bits)
                bound = np.concatenate([[0], np.cumsum(size)])[w.ptr]
                out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
                for d, key in enumerate(doc.slice(lo, hi - lo).to_pylist()):
                    own = np.append(ids[bound[d] : bound[d + 1]], np.int32(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(own), capacity)):
                        part = own[at : at + capacity]
                        out["doc_id"].append(key)
                        out["piece"].append(k)
                        out["start"].append(at)
                        out["length"].append(len(part))
                        out["ids_crc32"].append(zlib.crc32(part))
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))

    return docs.mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """PIECES of ``docs`` (doc_id, text, any others) with ``sequence_id`` and ``offset``.

    Null and empty text give one piece that holds only ``end_id``. Repeated rows and null ids are
    packed like any other row. An empty table gives an empty result. Other columns are ignored.
    Pieces of a sequence lie side by side from offset 0.
    """
    spark = docs.sparkSession
    path = workspace(spark, "pack")
    table = save(pieces(docs, tokenizer or lexicon.tokenizer_path(), f"{path}/lexicon", capacity, end_id), f"{path}/pieces")
    table = table.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int"))
    counted = table.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[r.length] = r.n
    where = f"{posix(path)}/slots.bin"
    put(where, slots(plan(counts)).tobytes())

    along = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("length", "_salt", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_salt").orderBy(F.col("doc_id").asc_nulls_last(), "piece", "ids_crc32")
    ranked = table.withColumn("_rank", F.row_number().over(within)).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_rank") - 1)
    columns = [c.split()[0] for c in PIECES.split(", ")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.fromfile(where, np.int64).reshape(-1, 4)
        key = (s[:, 0] << 48) + s[:, 1]
        for batch in batches:
            rank, length = batch.column(5).to_numpy(), batch.column(3).to_numpy()
            at = np.searchsorted(key, (length << 48) + rank, "right") - 1
            cols = [*batch.columns[:5], pa.array(s[at, 2] + rank - s[at, 1]), pa.array(s[at, 3])]
            yield pa.RecordBatch.from_arrays(cols, names=[*columns, "sequence_id", "offset"])

    return ranked.select(*columns, "_rank").mapInArrow(place, f"{PIECES}, sequence_id long, offset long")


def op3_pack_sequences(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
