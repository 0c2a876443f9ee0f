"""Language identification with hyperdimensional profiles.

Every letter owns a random +-1 vector. A trigram is bound from its letters' vectors by
elementwise product after permuting (rotating) them by their place, a document is the bundle
(sum) of its trigrams, a language prototype the sum of its documents' bundles scaled to unit length. A
document takes the language with the greatest cosine.

Bundles of whole partitions are summed before anything is shuffled: one row per partition,
language and block of dimensions. The prototypes are languages x ``DIM`` numbers, whatever the corpus.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import plain, slices
from .toxicity import remainder

DIM = 1024
#: Letter vectors. Code points below OWN have their own, all others share the rest by hash, so no script shares with Latin.
LETTERS, OWN = 1024, 512
#: Trigram vectors that a worker keeps; others are bound anew each time.
CACHE = 40_000
UNKNOWN = "und"


class Space:
    """Letter vectors and the trigram vectors bound from them so far."""

    def __init__(self, seed: int = 11):
        base = np.random.default_rng(seed).integers(0, 2, (LETTERS, DIM)).astype(np.int8) * 2 - 1
        self.by_place = [np.roll(base, 2 - i, axis=1) for i in range(3)]
        self.rows = np.zeros((4096, DIM), np.float32)
        self.known = np.zeros(0, np.int64)
        self.place = np.zeros(0, np.int64)
        self.n = 0

    def bind(self, gram: np.ndarray) -> np.ndarray:
        a, b, c = gram // LETTERS**2, gram // LETTERS % LETTERS, gram % LETTERS
        return (self.by_place[0][a] * self.by_place[1][b] * self.by_place[2][c]).astype(np.float32)

    def learn(self, gram: np.ndarray) -> None:
        """Keep the vectors of these sorted distinct trigrams while there is room."""
        if len(self.known):
            gram = gram[self.known[np.minimum(np.searchsorted(self.known, gram), len(self.known) - 1)] != gram]
        gram = gram[: CACHE - self.n]
        if not len(gram):
            return
        while self.n + len(gram) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        for at in range(0, len(gram), 2048):
            self.rows[self.n + at : self.n + at + len(gram[at : at + 2048])] = self.bind(gram[at : at + 2048])
        known, place = np.append(self.known, gram), np.append(self.place, np.arange(self.n, self.n + len(gram)))
        order = np.argsort(known)
        self.known, self.place, self.n = known[order], place[order], self.n + len(gram)

    def bundle(self, gram: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Sum of the trigrams' vectors, each ``count`` times."""
        if not len(self.known):
            hit = np.zeros(len(gram), bool)
        else:
            at = np.minimum(np.searchsorted(self.known, gram), len(self.known) - 1)
            hit = self.known[at] == gram
        out = np.zeros(DIM, np.float32)
        if hit.any():
            out += count[hit].astype(np.float32) @ self.rows[self.place[at[hit]]]
        rest = np.flatnonzero(~hit)
        for lo in range(0, len(rest), 2048):
            part = rest[lo : lo + 2048]
            out += count[part].astype(np.float32) @ self.bind(gram[part])
        return out


_space: Space | None = None


def space() -> Space:
    global _space
    if _space is None:
        _space = Space()
    return _space


_kinds: np.ndarray | None = None


def kinds(cp: np.ndarray) -> np.ndarray:
    """2 for letters, 1 for marks that belong to letters, 0 for all other code points."""
    global _kinds
    if _kinds is None:
        _kinds = np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)], np.uint8)
    return _kinds[cp]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(trigram, index of its text) of every place whose middle is a letter or mark.

    Texts are lower-cased, other characters count as blanks, and every text is framed by blanks. A text
    of marks without any letter has none.
    """
    low = [t.lower() for t in texts]
    cp = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds(cp)
    letter = kind > 0
    own = np.where(cp < OWN, cp, OWN + (cp * np.uint32(2654435761) >> np.uint32(7)) % np.uint32(LETTERS - OWN))
    code = np.where(letter, own, 0).astype(np.int64)
    mid = np.flatnonzero(letter[1:-1]) + 1
    gram = (code[mid - 1] * LETTERS + code[mid]) * LETTERS + code[mid + 1]
    # Text i and the line break behind it take len + 1 places, from place 1 on.
    of = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])
    owner = of[mid - 1]
    lettered = np.bincount(of[np.flatnonzero(kind[1:-1] == 2)], minlength=len(low)) > 0
    return gram[lettered[owner]], owner[lettered[owner]]


def _counts(gram: np.ndarray, owner: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    bound = np.searchsorted(owner, np.arange(n + 1))
    for d in range(n):
        g = np.sort(gram[bound[d] : bound[d + 1]])
        at = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
        yield g[at], np.diff(np.append(at, len(g)))


def prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in code point order and their unit-length prototypes, from ``docs`` (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            text = plain(batch.column(0))
            langs = batch.column(1)
            for lo, hi in slices(text, 2 << 20):
                gram, owner = trigrams(text.slice(lo, hi - lo).to_pylist())
                names = langs.slice(lo, hi - lo).dictionary_encode()
                of = names.indices.to_numpy()[owner] if len(owner) else owner
                for k, lang in enumerate(names.dictionary.to_pylist()):
                    g, c = np.unique(gram[of == k], return_counts=True)
                    old = sums.get(lang)
                    if old is not None:
                        g2, back = np.unique(np.concatenate([old[0], g]), return_inverse=True)
                        g, c = g2, np.bincount(back, np.concatenate([old[1], c])).astype(np.int64)
                    sums[lang] = (g, c)
        out: dict[str, list] = {"lang": [], "block": [], "v": []}
        for lang, (g, c) in sums.items():
            v = np.zeros(DIM)
            for at in range(0, len(g), 4096):
                v += c[at : at + 4096].astype(np.float64) @ space().bind(g[at : at + 4096]).astype(np.float64)
            for b in range(DIM // 64):
                out["lang"].append(lang)
                out["block"].append(b)
                out["v"].append(v[b * 64 : b * 64 + 64].tolist())
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("lang", pa.string()), ("block", pa.int32()), ("v", pa.list_(pa.float64()))]))

    part = docs.select("text", "lang").mapInArrow(run, "lang string, block int, v array<double>")
    sums = part.groupBy("lang", "block").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(64)])
    rows = sorted((tuple(r) for r in sums.collect()), key=lambda r: (r[0].encode(), r[1]))  # languages x DIM / 64
    langs = list(dict.fromkeys(r[0] for r in rows))
    table = np.array([r[2:] for r in rows], float).reshape(len(langs), DIM)
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    ok = norm[:, 0] > 0
    return [x for x, k in zip(langs, ok, strict=True) if k], table[ok] / norm[ok]


def identify(docs: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of ``docs`` (doc_id, text)."""
    protos = table.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = space()
        for batch in batches:
            text = plain(batch.column(1))
            names, best = [], []
            for lo, hi in slices(text, 2 << 20):
                gram, owner = trigrams(text.slice(lo, hi - lo).to_pylist())
                if s.n < CACHE:
                    s.learn(np.unique(gram))
                for g, c in _counts(gram, owner, hi - lo):
                    if not len(g) or not len(langs):
                        names.append(UNKNOWN)
                        best.append(0.0)
                        continue
                    v = s.bundle(g, c)
                    cos = protos @ v / max(float(np.linalg.norm(v)), 1e-9)
                    k = int(np.argmax(cos))
                    names.append(langs[k])
                    best.append(float(min(1.0, max(0.0, cos[k]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(best, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs`` (doc_id, text, lang, any others).

    Learns from rows with a text and a language whose crc32(doc_id) mod 5 is not 0 (null doc_id: 0). Null
    texts and texts without a letter are ``und`` with score 0, as is everything if nothing was
    learned. Ties go to the first language by code point. Repeated rows get equal answers; an empty
    table gives an empty result. Other columns are ignored.
    """
    held = remainder(5) == 0
    langs, table = prototypes(docs.filter(~held & F.col("text").isNotNull() & F.col("lang").isNotNull()))
    out = identify(docs, langs, table)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
