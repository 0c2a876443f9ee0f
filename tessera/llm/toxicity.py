"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word's vector is the mean of the embeddings of its character 3- to 6-grams (with word
boundaries, hashed into ``BUCKETS`` rows), a window's vector the mean of its words', and a linear softmax
of two classes scores the window. A document scores as its worst window: a few abusive words in
a book must not be averaged away. A misspelt or inflected word shares most n-grams with words
seen in training, so it need not have been seen itself.

Since bag and softmax are linear, scoring needs one number per n-gram, the embedding's product with the
difference of the two class vectors; whole texts are scored over their code point arrays.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import plain, slices

SIZES = (3, 4, 5, 6)
BUCKETS = 1 << 18
DIM = 12
WINDOW, HOP = 8, 4
#: Labelled documents that training reads at most, with label 0 and with label 1; chosen by a hash of doc_id.
MOST_TRAINED = (3500, 2000)
REJECT = 0.7
#: Rounds of picking windows, and gradient steps in each.
ROUNDS, STEPS = 10, 30
RATE, MOMENTUM, DECAY, SCALE = 0.6, 0.9, 3e-4, 20.0
#: An empty bag is no evidence: the bias alone never gets far on the side of label 1.
MOST_BIAS = -1.5
#: Documents an n-gram must occur in to be learned.
LEAST = 6

_KEY = np.random.default_rng(7).integers(0, 1 << 32, 8, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_letters: np.ndarray | None = None


def _is_letter(cp: np.ndarray) -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([unicodedata.category(chr(i))[0] in "LMN" for i in range(0x110000)])
    return _letters[cp]


def grams(texts: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(first word of each text and the end, [(word, bucket) arrays by size], words in all) of lower-cased texts."""
    low = [t.lower() for t in texts]
    cp = np.frombuffer(("\n" + "\n".join(low) + "\n" * 8).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _is_letter(cp)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    word = np.cumsum(begin, dtype=np.int32) - 1
    at = np.concatenate([[0], np.cumsum(np.array([len(t) + 1 for t in low], np.int64))])
    first = (word[at] + 1).astype(np.int64)
    c = np.where(inside, cp, np.uint32(0))
    out = []
    n = len(c)
    key = c[: n - 1] * _KEY[0] + c[1:] * _KEY[1]
    ok = np.ones(n - 1, bool)
    for size in range(3, max(SIZES) + 1):
        m = n - size + 1
        key = key[:m] + c[size - 1 :] * _KEY[size - 1]
        ok = ok[:m] & inside[size - 2 : n - 1]
        if size in SIZES:
            i = np.flatnonzero(ok)
            k = key[i] ^ np.uint32(size)
            k = (k ^ (k >> np.uint32(15))) * np.uint32(0x9E3779B1)
            out.append((word[i + 1], (k >> np.uint32(14)).astype(np.int32)))
    return first, out, np.int64(word[-1] + 1)


def word_scores(parts, n_words: int, table: np.ndarray) -> np.ndarray:
    """The mean of the table's values over each word's n-grams."""
    total, count = np.zeros(n_words), np.zeros(n_words)
    for word, bucket in parts:
        total += np.bincount(word, table[bucket], n_words)
        count += np.bincount(word, minlength=n_words)
    return total / np.maximum(count, 1)


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end word, text) of every window; a text without words has one that is empty."""
    size = np.diff(first)
    many = np.where(size <= WINDOW, 1, -(-(size - WINDOW) // HOP) + 1)
    text = np.repeat(np.arange(len(size)), many)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    lo = first[:-1][text] + np.minimum(nth * HOP, np.maximum(size[text] - WINDOW, 0))
    return lo, np.minimum(lo + WINDOW, first[1:][text]), text


class Model:
    """The trained n-gram values and bias; ``score`` gives the probability of the label."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table.astype(np.float32), float(bias)

    def score(self, texts: list[str]) -> np.ndarray:
        first, parts, n = grams(texts)
        s = np.concatenate([[0.0], np.cumsum(word_scores(parts, int(n), self.table))])
        lo, hi, text = windows(first)
        mean = (s[hi] - s[lo]) / np.maximum(hi - lo, 1)
        worst = np.maximum.reduceat(mean, np.searchsorted(text, np.arange(len(texts))))
        return 1 / (1 + np.exp(-np.clip(worst + self.bias, -30, 30)))


def _tokens(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, word number of every token, first token of each text and the end)."""
    ids: dict[str, int] = {}
    streams, lengths = [], []
    for t in texts:
        own = "".join(x if _letter_char(x) else " " for x in t.lower()).split()
        streams.append(np.fromiter((ids.setdefault(w, len(ids)) for w in own), np.int32, len(own)))
        lengths.append(len(own))
    return list(ids), np.concatenate([*streams, np.zeros(0, np.int32)]), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def _letter_char(x: str) -> bool:
    return unicodedata.category(x)[0] in "LMN"


class _Spans:
    """The words of some token spans, so that one gradient step costs no more than those."""

    def __init__(self, token, lo, hi, words: _Words):
        i4 = np.int32  # a bounded sample: all places fit
        size = (hi - lo).astype(i4)
        at = np.repeat((lo - np.cumsum(size) + size).astype(i4), size) + np.arange(int(size.sum()), dtype=i4)
        self.ids, own = np.unique(token[at], return_inverse=True)
        del at
        self.own, self.span, self.share = own.astype(i4), np.repeat(np.arange(len(lo), dtype=i4), size), 1.0 / np.maximum(size, 1)
        n = (words.begin[self.ids + 1] - words.begin[self.ids]).astype(i4)
        flat = np.repeat((words.begin[self.ids] - np.cumsum(n) + n).astype(i4), n) + np.arange(int(n.sum()), dtype=i4)
        self.bucket, self.word = words.bucket[flat], np.repeat(np.arange(len(self.ids), dtype=i4), n)
        self.count = words.count[self.ids]

    def means(self, table: np.ndarray) -> np.ndarray:
        s = np.bincount(self.word, table[self.bucket], len(self.ids)) / self.count
        return np.bincount(self.span, s[self.own], len(self.share)) * self.share

    def back(self, g: np.ndarray, n: int) -> np.ndarray:
        q = np.bincount(self.own, (g * self.share)[self.span], len(self.ids)) / self.count
        return np.bincount(self.bucket, q[self.word], n)


class _Words:
    """N-gram buckets of every distinct training word; rare n-grams are left out, but count in the mean."""

    def __init__(self, vocabulary: list[str], documents: np.ndarray):
        # A stretch of the vocabulary at a time, twice: once for the frequencies, once for the frequent n-grams.
        n, step = len(vocabulary), 50_000
        self.count = np.zeros(n)
        frequency = np.zeros(BUCKETS)
        for lo in range(0, n, step):
            for w, b in grams(vocabulary[lo : lo + step])[1]:
                self.count[lo : lo + step] += np.bincount(w, minlength=len(vocabulary[lo : lo + step]))
                frequency += np.bincount(b, documents[lo + w], BUCKETS)
        self.count = np.maximum(self.count, 1)
        self.used = np.flatnonzero(frequency >= LEAST)
        place = np.full(BUCKETS, -1, np.int32)
        place[self.used] = np.arange(len(self.used))
        words, buckets = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for lo in range(0, n, step):
            parts = grams(vocabulary[lo : lo + step])[1]
            w, b = np.concatenate([p[0] for p in parts]) + np.int32(lo), place[np.concatenate([p[1] for p in parts])]
            w, b = w[b >= 0], b[b >= 0]
            order = np.argsort(w, kind="stable")
            words.append(w[order])
            buckets.append(b[order])
        self.word, self.bucket = np.concatenate(words), np.concatenate(buckets)
        self.begin = np.searchsorted(self.word, np.arange(n + 1))

    def scores(self, table: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, table[self.bucket], len(self.count)) / self.count


def train(texts: list[str], labels: np.ndarray, rounds: int = ROUNDS, steps: int = STEPS, seed: int = 1) -> Model:
    """Fit embeddings and softmax together by gradient steps with momentum, classes weighted alike.

    The first round averages whole documents; before each later one the worst window of every
    document joins the examples (for label 1 it takes the place of the last). Steps have one length for all
    embeddings, not one per row, so frequent n-grams learn and rare ones aren't memorised;
    n-grams of fewer than ``LEAST`` documents keep zero vectors. Without both labels the model is constant.
    """
    y = np.asarray(labels, float)
    if not len(texts) or y.min() == y.max():
        return Model(np.zeros(BUCKETS), -4.0 if not len(texts) or y.max() == 0 else 4.0)
    rng = np.random.default_rng(seed)
    vocabulary, token, first = _tokens(texts)
    documents = np.zeros(len(vocabulary), np.int64)
    for lo, hi in zip(first, first[1:], strict=False):
        documents[np.unique(token[lo:hi])] += 1
    words = _Words(vocabulary, documents)
    del vocabulary
    k = len(words.used)
    lo, hi, text = windows(first)
    head = np.searchsorted(text, np.arange(len(texts)))
    emb = rng.normal(0, 0.01, (k, DIM))
    soft = rng.normal(0, 1 / np.sqrt(DIM), (DIM, 2))
    bias = 0.0
    spans, target = _Spans(token, first[:-1], first[1:], words), y
    picked = np.zeros(0, np.int64)
    for r in range(rounds):
        if r:
            cum = np.concatenate([[0.0], np.cumsum(words.scores(emb @ (soft[:, 1] - soft[:, 0]))[token])])
            mean = (cum[hi] - cum[lo]) / np.maximum(hi - lo, 1)
            hit = np.flatnonzero(mean >= np.maximum.reduceat(mean, head)[text])
            pick = np.zeros(len(texts), np.int64)
            pick[text[hit[::-1]]] = hit[::-1]
            picked = np.union1d(picked[y[text[picked]] == 0], pick)
            del spans, cum, mean
            spans, target = _Spans(token, lo[picked], hi[picked], words), y[text[picked]]
        weight = np.where(target == 1, 0.5 / max(1, target.sum()), 0.5 / max(1, len(target) - target.sum()))
        v_emb, v_soft, v_bias, norm = np.zeros_like(emb), np.zeros_like(soft), 0.0, 0.0
        for t in range(steps):
            d = soft[:, 1] - soft[:, 0]
            z = SCALE * spans.means(emb @ d) + bias
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight
            grad = SCALE * spans.back(g, k)
            g_emb, gs = grad[:, None] * d[None, :] + DECAY * emb, grad @ emb
            norm = max(norm, float(np.sqrt((g_emb**2).sum())), 1e-12)
            rate = RATE * (1 - t / steps)
            v_emb = MOMENTUM * v_emb - rate * g_emb / norm
            v_soft = MOMENTUM * v_soft - 0.02 * rate * np.stack([-gs, gs], 1) / max(1e-12, norm)
            v_bias = MOMENTUM * v_bias - 0.5 * float(g.sum())
            emb += v_emb
            soft += v_soft
            bias = min(bias + v_bias, MOST_BIAS)
    table = np.zeros(BUCKETS)
    table[words.used] = SCALE * (emb @ (soft[:, 1] - soft[:, 0]))
    return Model(table, bias)


def remainder(n: int):
    """crc32 of doc_id as text, modulo n; a null doc_id counts as 0."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n)), F.lit(0))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on labelled documents whose remainder is not 1, at most ``MOST_TRAINED`` of each label.

    Ids may repeat in ``docs``: of the rows found, at most ``4 * sum(MOST_TRAINED)`` are read, chosen by a hash of id and text.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter((remainder(3) != 1) & F.col("toxic").isin(0, 1))
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    picked = known.filter("toxic = 1").orderBy(order).limit(MOST_TRAINED[1]).union(known.filter("toxic = 0").orderBy(order).limit(MOST_TRAINED[0]))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").filter("text IS NOT NULL").orderBy(order, F.xxhash64("text")).limit(4 * sum(MOST_TRAINED)).select("text", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            labels += batch.column(1).to_pylist()
        m = train(texts, np.array(labels))
        yield pa.RecordBatch.from_pydict({"table": [m.table.tobytes()], "bias": [m.bias]})

    # The sample is bounded, so one task trains; its memory is a worker's and not the driver's.
    found = rows.coalesce(1).mapInArrow(run, "table binary, bias double").collect()
    return Model(np.frombuffer(found[0].table, np.float32), found[0].bias) if found else train([], np.zeros(0))


def score(docs: DataFrame, model: Model, keep: list[str], to: str = "score") -> DataFrame:
    """``keep`` columns of ``docs`` and ``to``, the model's probability of label 1; null scores as empty."""
    shared = docs.sparkSession.sparkContext.broadcast((model.table, model.bias))
    kept = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    schema, at = kept.schema[: len(keep)], kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in batches:
            text = plain(batch.column(at))
            parts = [m.score(text.slice(lo, hi - lo).to_pylist()) for lo, hi in slices(text)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.concatenate([*parts, np.zeros(0)]))], names=[*keep, to])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return kept.mapInArrow(run, StructType([*schema, StructField(to, DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text, any others).

    ``labels`` is (doc_id, toxic, any others). Null and empty texts score by the bias alone. A doc_id with
    several labels counts as toxic if any says so; null labels and other values are not learned from. Repeated rows
    score alike; empty tables give an empty result or a constant model.
    """
    out = score(docs, fit(docs, labels), ["doc_id"])
    return out.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
