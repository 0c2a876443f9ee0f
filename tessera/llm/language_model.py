"""Interpolated modified Kneser-Ney bigram model over sorted, memory-mapped arrays.

Two counting passes over the training texts:

1. Word hashes are counted per partition and merged by hash bucket into sorted arrays; a word's id is its
   place in them.
2. Adjacent ids (from a start mark to an end token) become 64-bit keys ``first << 32 | second``. Each
   partition hands on one blob of sorted keys and counts per key range, so Spark moves few large
   rows. One task per range merges its blobs, writes the sorted keys and counts, and sums what contexts
   and continuations need. Ranges are by first word; a first word with more than its share of all
   tokens is cut by second word, so no range outgrows the others.

Everything lies in the shared folder as flat files. Scoring workers memory-map them and look up a whole
slice of texts at once with sorted searches. A bigram of context h with count c scores

    (max(c - D(c), 0) + (D1 N1(h) + D2 N2(h) + D3 N3+(h)) * p(w)) / c(h),

p(w) being the same formula over continuation counts (in how many contexts w occurs), interpolated with
the uniform distribution over all training words and one unknown word.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import posix, put, workspace
from .textkit import U64, counted, plain, slices, split
from .toxicity import remainder

#: Hash of the end token; no word has it but by a chance of 2^-64.
END = np.uint64(0xE0D0E0D0E0D0E0D1)
#: Bigrams of training per range, and distinct ones a worker holds before it hands them on.
PER_RANGE, FLUSH = 3_000_000, 4_000_000

_BLOB = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
BLOB = "part int, keys binary, counts binary"


def squeeze(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys as differences, and counts, with bytes of one place side by side, deflated."""
    gaps = np.diff(keys, prepend=U64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    width = max(1, (int(counts.max(initial=0)).bit_length() + 7) // 8)
    many = counts.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width]
    return zlib.compress(np.ascontiguousarray(gaps), 1), zlib.compress(np.ascontiguousarray(many), 1)


def unsqueeze(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    gaps = np.frombuffer(zlib.decompress(keys), np.uint8).reshape(8, -1).T
    many = np.zeros((len(gaps), 8), np.uint8)
    if len(gaps):
        planes = np.frombuffer(zlib.decompress(counts), np.uint8).reshape(-1, len(gaps))
        many[:, : len(planes)] = planes.T
    return np.cumsum(np.ascontiguousarray(gaps).view("<u8").ravel(), dtype=U64), many.view("<u8").ravel().astype(np.int64)


def packed(counts: np.ndarray) -> bytes:
    """Counts in four bytes each, or in eight where one needs more; ``Store.counts`` tells by the size."""
    return counts.astype("<u4" if int(counts.max(initial=0)) < 1 << 32 else "<u8").tobytes()


def _blobs(keys: np.ndarray, counts: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    """One row per part; ``part`` must not fall along ``keys``."""
    at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    out: dict[str, list] = {"part": [], "keys": [], "counts": []}
    for lo, hi in zip(at, np.append(at[1:], len(part))[: len(at)], strict=True):
        k, c = squeeze(keys[lo:hi], counts[lo:hi])
        out["part"].append(int(part[lo]))
        out["keys"].append(k)
        out["counts"].append(c)
    return pa.RecordBatch.from_pydict(out, schema=_BLOB)


def _merge(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    parts = [unsqueeze(k.as_py(), c.as_py()) for k, c in zip(table["keys"], table["counts"], strict=True)]
    keys, counts = counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
    return table["part"][0].as_py(), keys, counts


class _Tally:
    """Counts of keys gathered slice by slice; merged when they have grown."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        k, c = counted(keys)
        self.parts.append((k, c))
        self.size += len(k)
        if len(self.parts) >= 8:
            self.parts = [self.total()]
            self.size = len(self.parts[0][0])

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        return counted(np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts]))


class Store:
    """The model's files as one worker sees them."""

    def __init__(self, root: str, bits: int, base: list[int], ranges: Ranges | None = None, facts: dict | None = None):
        self.root, self.bits, self.base, self.ranges, self.facts = root, bits, np.array(base, np.int64), ranges, facts
        self.maps: dict[str, np.ndarray] = {}

    def file(self, name: str, kind: str) -> np.ndarray:
        if name not in self.maps:
            path = f"{self.root}/{name}"
            self.maps[name] = np.memmap(path, kind, "r") if os.path.exists(path) and os.path.getsize(path) else np.zeros(0, kind)
        return self.maps[name]

    def counts(self, name: str, n: int) -> np.ndarray:
        """The ``n`` counts that ``packed`` wrote."""
        path = f"{self.root}/{name}"
        wide = os.path.exists(path) and os.path.getsize(path) == 8 * n
        return self.file(name, "<u8" if wide else "<u4")

    def ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of each of the sorted distinct hashes."""
        ident, count = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        bound = np.searchsorted(h >> U64(64 - self.bits), np.arange((1 << self.bits) + 1).astype(U64))
        for b in np.flatnonzero(np.diff(bound)):
            known = self.file(f"words-{b}", "<u8")
            if len(known):
                part = h[bound[b] : bound[b + 1]]
                at = np.minimum(np.searchsorted(known, part), len(known) - 1)
                hit = known[at] == part
                ident[bound[b] : bound[b + 1]] = np.where(hit, self.base[b] + at, -1)
                count[bound[b] : bound[b + 1]] = np.where(hit, self.counts(f"counts-{b}", len(known))[at], 0)
        return ident, count

    def bigrams(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct keys."""
        out = np.zeros(len(keys), np.int64)
        part = self.ranges.of(keys)
        at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
        for lo, hi in zip(at, np.append(at[1:], len(part))[: len(at)], strict=True):
            known = self.file(f"keys-{part[lo]}", "<u8")
            if len(known):
                i = np.minimum(np.searchsorted(known, keys[lo:hi]), len(known) - 1)
                out[lo:hi] = np.where(known[i] == keys[lo:hi], self.counts(f"times-{part[lo]}", len(known))[i], 0)
        return out


class Ranges:
    """Key ranges that rise with the key: cuts of the first id, and of the second below frequent firsts."""

    def __init__(self, n_ids: int, tokens: int, frequent: dict[int, int]):
        self.n, want = n_ids, max(1, -(-tokens // PER_RANGE))
        cuts = {U64(i * n_ids // want) << U64(32) for i in range(want)}
        for i, c in frequent.items():
            many = -(-c // PER_RANGE)
            cuts |= {(U64(i) << U64(32)) + U64(j * n_ids // many) for j in range(many)} | {U64(i + 1) << U64(32)}
        self.cuts = np.array(sorted(cuts), U64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cuts, keys, "right") - 1


def _stream(text: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every token with an END behind each row, place of each row's END)."""
    w = split(text)
    h = w.hashes()
    ends = w.ptr[1:] + np.arange(len(w.ptr) - 1)
    out = np.empty(len(h) + len(ends), U64)
    is_word = np.ones(len(out), bool)
    is_word[ends] = False
    out[is_word], out[ends] = h, END
    return out, ends


def train(docs: DataFrame, path: str) -> Store:
    """Count ``docs.text`` into files below ``path``; what returns to the driver has one row per bucket."""
    spark = docs.sparkSession
    root = posix(path)
    os.makedirs(root, exist_ok=True)
    bits = max(3, int(spark.conf.get("spark.sql.shuffle.partitions")).bit_length() - 1)
    docs = docs.select("text")

    many = pa.list_(pa.int64())
    bucket = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("total", pa.int64()), ("at", many), ("c", many)])
    summed = pa.schema([("kind", pa.string()), ("n", pa.int64()), ("times", many)])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for batch in batches:
            text = plain(batch.column(0))
            for lo, hi in slices(text):
                tally.add(_stream(text.slice(lo, hi - lo))[0])
                if tally.size > FLUSH:
                    k, c = tally.total()
                    yield _blobs(k, c, (k >> U64(64 - bits)).astype(np.int64))
                    tally = _Tally()
        k, c = tally.total()
        yield _blobs(k, c, (k >> U64(64 - bits)).astype(np.int64))

    def merge_words(table: pa.Table) -> pa.Table:
        b, k, c = _merge(table)
        put(f"{root}/words-{b}", k.astype("<u8").tobytes())
        put(f"{root}/counts-{b}", packed(c))
        # Words frequent enough to have their own ranges are few: at most one in PER_RANGE / 2 tokens.
        often = np.flatnonzero(c >= PER_RANGE // 2)
        return pa.table({"part": [b], "n": [len(k)], "total": [int(c.sum())], "at": [often.tolist()], "c": [c[often].tolist()]}, schema=bucket)

    rows = docs.mapInArrow(words, BLOB).groupBy("part").applyInArrow(merge_words, "part int, n long, total long, at array<long>, c array<long>").collect()
    size, frequent, base = dict.fromkeys(range(1 << bits), 0), {}, []
    for r in rows:
        size[r.part] = r.n
    for b in range(1 << bits):
        base.append(base[-1] + size[b - 1] if b else 0)
    n_ids, tokens = sum(size.values()), sum(r.total for r in rows)
    if n_ids >= 1 << 32:
        raise ValueError("more than 2^32 distinct words")
    for r in rows:
        frequent |= {base[r.part] + i: c for i, c in zip(r.at, r.c, strict=True)}
    begin = n_ids  # the start mark's id, the greatest
    end_count = int(Store(root, bits, base).ids(np.array([END]))[1][0])
    if end_count >= PER_RANGE // 2:
        frequent[begin] = end_count  # as many starts as ends
    ranges = Ranges(n_ids + 1, tokens, frequent)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, tally = Store(root, bits, base), _Tally()
        for batch in batches:
            text = plain(batch.column(0))
            for lo, hi in slices(text):
                tally.add(_keys(s, _stream(text.slice(lo, hi - lo)), begin)[0])
                if tally.size > FLUSH:
                    k, c = tally.total()
                    yield _blobs(k, c, ranges.of(k))
                    tally = _Tally()
        k, c = tally.total()
        yield _blobs(k, c, ranges.of(k))

    step = max(1, -(-(n_ids + 1) // (1 << bits)))

    def merge_pairs(table: pa.Table) -> pa.Table:
        part, k, c = _merge(table)
        put(f"{root}/keys-{part}", k.astype("<u8").tobytes())
        put(f"{root}/times-{part}", packed(c))
        first, second = (k >> U64(32)).astype(np.int64), k & U64(0xFFFFFFFF)
        out = {"kind": [], "part": [], "keys": [], "counts": []}

        def emit(kind: str, ids: np.ndarray, n: np.ndarray) -> None:
            b = _blobs(ids.astype(U64), n, ids.astype(np.int64) // step)
            out["kind"] += [kind] * b.num_rows
            for name in ("part", "keys", "counts"):
                out[name] += b.column(name).to_pylist()

        emit("in", *counted(second))
        for kind, mask in (("n1", c == 1), ("n2", c == 2), ("n3", c > 2)):
            emit(kind, *counted(first[mask]))
        emit("all", *counted(first, c))
        times = np.bincount(np.minimum(c, 5), minlength=6)[1:5]
        out["kind"].append("times")
        out["part"].append(-1)
        out["keys"].append(times.astype("<i8").tobytes())
        out["counts"].append(b"")
        return pa.table(out, schema=pa.schema([("kind", pa.string()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))

    def merge_sums(table: pa.Table) -> pa.Table:
        part, kind = table["part"][0].as_py(), table["kind"][0].as_py()
        if kind == "times":
            times = np.sum([np.frombuffer(x.as_py(), "<i8") for x in table["keys"]], axis=0)
            return pa.table({"kind": [kind], "n": [0], "times": [times.tolist()]}, schema=summed)
        _, ids, n = _merge(table)
        dense = np.zeros(step, np.int64)
        dense[ids.astype(np.int64) - part * step] = n
        put(f"{root}/{kind}-{part}", packed(dense))
        return pa.table({"kind": [kind], "n": [int(n.sum())], "times": [np.bincount(np.minimum(n, 5), minlength=6)[1:5].tolist()]}, schema=summed)

    sums = docs.mapInArrow(pairs, BLOB).groupBy("part").applyInArrow(merge_pairs, f"kind string, {BLOB}")
    back = sums.groupBy("kind", "part").applyInArrow(merge_sums, "kind string, n long, times array<long>").collect()

    def discounts(kind: str) -> list[float]:
        """Modified Kneser-Ney discounts from how many items occur once to four times; 0.5, 1, 1.5 where those are too few."""
        n = np.sum([r.times for r in back if r.kind == kind] or [[0] * 4], axis=0).astype(float)
        if not n.all():
            return [0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
        return [min(max(v, 0.05), i + 0.95) for i, v in enumerate(d)]

    inn = [r for r in back if r.kind == "in"]
    kinds = sum(r.n for r in inn)
    few = np.sum([r.times[:2] for r in inn] or [[0, 0]], axis=0)
    facts = {"tokens": tokens, "ids": n_ids, "begin": begin, "step": step, "d2": discounts("times"), "d1": discounts("in"), "kinds": kinds, "few": few.tolist()}
    return Store(root, bits, base, ranges, facts)


def _keys(s: Store, stream: tuple[np.ndarray, np.ndarray], begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key of each token with its predecessor, predecessor id, id, count, place of distinct id) of a stream."""
    tokens, ends = stream
    h, back = np.unique(tokens, return_inverse=True)
    ident, count = s.ids(h)
    ids = ident[back]
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    before[starts] = begin
    return (before.astype(U64) << U64(32)) | (ids.astype(U64) & U64(0xFFFFFFFF)), before, ids, count[back], back


def _dense(s: Store, kind: str, ids: np.ndarray) -> np.ndarray:
    """Values of one kind for ids; 0 for -1."""
    out = np.zeros(len(ids))
    u, back = np.unique(ids, return_inverse=True)
    got = np.zeros(len(u))
    part = np.where(u < 0, -1, u // s.facts["step"])
    for p in np.unique(part[part >= 0]):
        a = s.counts(f"{kind}-{p}", s.facts["step"])
        if len(a):
            m = part == p
            got[m] = a[u[m] - p * s.facts["step"]]
    out[:] = got[back]
    return out


def _discount(c: np.ndarray, d: list[float]) -> np.ndarray:
    return np.where(c <= 0, 0.0, np.where(c == 1, d[0], np.where(c == 2, d[1], d[2])))


def probabilities(s: Store, text: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probability, training count, row ends) of every token of a slice of texts."""
    f = s.facts
    stream = _stream(text)
    key, before, ids, count, _ = _keys(s, stream, f["begin"])
    known = (before >= 0) & (ids >= 0)
    k, back = np.unique(key[known], return_inverse=True)
    c2 = np.zeros(len(key))
    c2[known] = s.bigrams(k)[back]
    u, where = np.unique(np.concatenate([ids, before]), return_inverse=True)
    w_at, h_at = where[: len(ids)], where[len(ids) :]
    c1 = _dense(s, "in", u)
    n_few = f["few"]
    rest = f["kinds"]
    distinct = f["ids"]
    spare = f["d1"][0] * n_few[0] + f["d1"][1] * n_few[1] + f["d1"][2] * max(0, distinct - n_few[0] - n_few[1])
    if rest:
        p1 = (np.maximum(c1 - _discount(c1, f["d1"]), 0) + spare / (distinct + 1)) / rest
    else:
        p1 = np.full(len(u), 1.0 / (distinct + 1))
    total = _dense(s, "all", u)
    gamma = f["d2"][0] * _dense(s, "n1", u) + f["d2"][1] * _dense(s, "n2", u) + f["d2"][2] * _dense(s, "n3", u)
    low, all_h = p1[w_at], total[h_at]
    seen = all_h > 0
    p = np.where(seen, (np.maximum(c2 - _discount(c2, f["d2"]), 0) + gamma[h_at] * low) / np.where(seen, all_h, 1), low)
    return p, count, stream[1]


def score(docs: DataFrame, store: Store) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of each row of ``docs`` (doc_id, text)."""
    made = (store.root, store.bits, store.base.tolist(), store.ranges, store.facts)
    v, n = store.facts["ids"], store.facts["tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Store(*made)
        for batch in batches:
            text = plain(batch.column(1))
            cols: list[list] = [[], [], [], []]
            for lo, hi in slices(text):
                p, c, ends = probabilities(s, text.slice(lo, hi - lo))
                at = np.concatenate([[0], ends + 1])[:-1]
                cols[0].append(ends + 1 - at)
                cols[1].append(np.add.reduceat((c > 0).astype(np.int64), at))
                cols[2].append(np.add.reduceat(np.log10((c + 1) / (n + v + 1)), at))
                cols[3].append(np.add.reduceat(np.log10(p), at))
            none = np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate([*x, none]).astype(t)) for x, t in zip(cols, ("i8", "i8", "f8", "f8"), strict=True))], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def language_model(docs: DataFrame, train_on=None) -> DataFrame:
    """Scores of each row of ``docs`` (doc_id, text, any others) by a model of those that aren't held out.

    Returns doc_id, held_out (crc32(doc_id) mod 7 is 2; a null doc_id isn't), n_tokens, n_known, train_tokens,
    base_score (add-one unigrams), score (the bigram model) and perplexity. Null text is empty: one end
    token. Repeated rows count as often as they occur. Without training tokens every token has
    probability 1. An empty table gives an empty result; other columns are ignored.
    """
    held = remainder(7) == 2
    store = train(docs.filter(~held) if train_on is None else train_on, workspace(docs.sparkSession, "lm"))
    out = score(docs, store)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(store.facts["tokens"]).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model(spark.read.parquet(f"{sf_dir}/documents.parquet"))
