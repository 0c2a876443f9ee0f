"""Token ids of every distinct text unit, computed once and memory-mapped by all workers.

A unit is a lower-cased (A-Z) run of non-white-space bytes, with one final ``.,;:!?`` split off
behind a letter. The public tokenizers used here drop white space and never merge across it or
across that boundary, so a text's ids are its units' ids laid end to end. Natural text repeats
its units, so each distinct one is encoded once: the first pass gathers distinct units by hash
bucket, one task per bucket encodes them and writes sorted hash arrays to the shared folder,
and the second pass only looks ids up. A unit that is not found is encoded on the spot.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import posix, put
from .textkit import LOWER, U64, Words, plain, slices, split

DEFAULT_TOKENIZER = "word_bpe_49k.json"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True
#: Never part of a unit that is encoded together with others.
_BREAK = b"\x01"
#: Distinct units a worker keeps before it hands them on.
_FLUSH = 200_000


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def units(column: pa.LargeStringArray) -> Words:
    """The units of every row, as word bounds over the lower-cased bytes.

    A word with ``<|`` keeps its case, since only one spelling of a special token is special.
    """
    w = split(column, lower=False)
    low = LOWER[w.buf]
    special = np.flatnonzero((w.buf[:-1] == 60) & (w.buf[1:] == 124))
    for i in np.unique(np.searchsorted(w.starts, special, "right") - 1):
        low[w.starts[i] : w.ends[i]] = w.buf[w.starts[i] : w.ends[i]]
    w.buf = low
    size = w.ends - w.starts
    before = np.maximum(w.ends - 2, w.starts)
    latin = (w.buf[np.maximum(before - 1, 0)] == 0xC3) & (w.buf[before] >= 0x80) & ~np.isin(w.buf[before], (0x97, 0xB7)) & (size > 2) if len(size) else np.zeros(0, bool)
    cut = (size > 1) & _STOP[w.buf[w.ends - 1]] & (_LETTER[w.buf[before]] | latin) if len(size) else np.zeros(0, bool)
    at = np.arange(len(size)) + np.cumsum(cut) - cut
    n = len(size) + int(cut.sum())
    starts, ends = np.empty(n, np.int64), np.empty(n, np.int64)
    starts[at], ends[at] = w.starts, w.ends - cut
    starts[at[cut] + 1], ends[at[cut] + 1] = w.ends[cut] - 1, w.ends[cut]
    return Words(w.buf, starts, ends, np.append(at, n)[w.ptr])


def _gather(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.cumsum(sizes)
    at = np.arange(total[-1] if len(total) else 0) + np.repeat(starts - total + sizes, sizes)
    return buf[at]


class Encoder:
    """One tokenizer of this process; ``many`` encodes units separately but in few calls."""

    _open: dict[str, Encoder] = {}

    @classmethod
    def open(cls, path: str) -> Encoder:
        if path not in cls._open:
            cls._open.clear()
            cls._open[path] = cls(path)
        return cls._open[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        mark = self.t.encode(_BREAK.decode(), add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def one(self, unit: bytes) -> np.ndarray:
        return np.array(self.t.encode(unit.decode("utf-8", "replace"), add_special_tokens=False).ids, np.int32)

    def many(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units end to end, number of ids of each)."""
        flat, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for lo in range(0, len(units), 2000):
            part = units[lo : lo + 2000]
            got = None
            if self.mark is not None and not any(b"<|" in u or _BREAK in u for u in part):
                text = (b" " + _BREAK + b" ").join(part).decode("utf-8", "replace")
                ids = np.array(self.t.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
                marks = np.flatnonzero(ids == self.mark)
                if len(marks) == len(part) - 1:
                    got = np.delete(ids, marks), np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1
            if got is None:
                ones = [self.one(u) for u in part]
                got = np.concatenate(ones), np.array([len(o) for o in ones], np.int64)
            flat.append(got[0])
            sizes.append(got[1])
        return np.concatenate(flat), np.concatenate(sizes)


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct values, place of each one's first occurrence, number of each element's value), by a hash table."""
    codes, values = pd.factorize(h)
    if not len(codes):
        return values, codes, codes
    top = np.maximum.accumulate(codes)
    first = np.flatnonzero(np.concatenate([[True], top[1:] > top[:-1]]))
    order = np.argsort(values)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return values[order], first[order], rank[codes]


def buckets_of(spark) -> int:
    """Bits of the unit hash that choose a bucket; follows the session's shuffle partitions."""
    return max(3, int(spark.conf.get("spark.sql.shuffle.partitions")).bit_length() - 1)


def build(docs: DataFrame, folder: str, tokenizer: str) -> None:
    """Encode the distinct units of ``docs.text`` into sorted hash arrays below ``folder``."""
    bits = buckets_of(docs.sparkSession)
    root = posix(folder)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, U64)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not kept:
                return
            h = np.concatenate([k[0] for k in kept])
            size = np.concatenate([k[1] for k in kept])
            flat = np.concatenate([k[2] for k in kept])
            order = np.argsort(h)
            begin = np.cumsum(size) - size
            h, size, begin = h[order], size[order], begin[order]
            bound = np.searchsorted(h >> U64(64 - bits), np.arange((1 << bits) + 1).astype(U64))
            out: dict[str, list] = {"bucket": [], "hashes": [], "sizes": [], "bytes": []}
            for b in np.flatnonzero(np.diff(bound)):
                lo, hi = bound[b], bound[b + 1]
                out["bucket"].append(int(b))
                out["hashes"].append(h[lo:hi].tobytes())
                out["sizes"].append(size[lo:hi].astype(np.uint32).tobytes())
                out["bytes"].append(_gather(flat, begin[lo:hi], size[lo:hi]).tobytes())
            kept.clear()
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("sizes", pa.binary()), ("bytes", pa.binary())]))

        for batch in batches:
            text = plain(batch.column(0))
            for lo, hi in slices(text):
                w = units(text.slice(lo, hi - lo))
                h, at, _ = distinct(w.hashes())
                if len(seen):
                    new = seen[np.minimum(np.searchsorted(seen, h), len(seen) - 1)] != h
                    h, at = h[new], at[new]
                if len(h):
                    size = w.ends[at] - w.starts[at]
                    kept.append((h, size, _gather(w.buf, w.starts[at], size)))
                    seen = np.union1d(seen, h)
                if len(seen) > _FLUSH:
                    yield from flush()
                    seen = np.zeros(0, U64)
        yield from flush()

    def encode(table: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(x.as_buffer(), U64) for x in table["hashes"]])
        size = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table["sizes"]]).astype(np.int64)
        flat = b"".join(x.as_py() for x in table["bytes"])
        begin = np.cumsum(size) - size
        h, at = np.unique(h, return_index=True)
        ids, counts = Encoder.open(tokenizer).many([flat[b : b + n] for b, n in zip(begin[at].tolist(), size[at].tolist(), strict=True)])
        start = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        data = np.array([len(h), start[-1]], np.int64).tobytes() + h.tobytes() + start.tobytes() + ids.astype("<i4").tobytes()
        bucket = table["bucket"][0].as_py()
        put(f"{root}/{bucket}.lex", data)
        return pa.table({"n": [len(h)]})

    os.makedirs(root, exist_ok=True)
    blobs = docs.select("text").mapInArrow(gather, "bucket int, hashes binary, sizes binary, bytes binary")
    blobs.groupBy("bucket").applyInArrow(encode, "n long").write.format("noop").mode("overwrite").save()


class Lexicon:
    """Reader of what ``build`` wrote; opened once per worker process and folder."""

    _open: dict[str, Lexicon] = {}

    def __init__(self, folder: str, tokenizer: str):
        self.parts, self.tokenizer, self.encoder = {}, tokenizer, None
        names = sorted(x for x in os.listdir(folder) if x.endswith(".lex"))
        for name in names:
            raw = np.memmap(f"{folder}/{name}", np.uint8, "r")
            n, m = raw[:16].view(np.int64)
            self.parts[int(name[:-4])] = (raw[16 : 16 + 8 * n].view(U64), raw[16 + 8 * n : 24 + 16 * n].view(np.int64), raw[24 + 16 * n : 24 + 16 * n + 4 * m].view(np.int32))

    @classmethod
    def open(cls, folder: str, tokenizer: str) -> Lexicon:
        if folder not in cls._open:
            cls._open.clear()
            cls._open[folder] = cls(folder, tokenizer)
        return cls._open[folder]

    def encode(self, w: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units laid end to end, number of ids of each unit)."""
        h, first, back = distinct(w.hashes())
        bound = np.searchsorted(h >> U64(64 - bits), np.arange((1 << bits) + 1).astype(U64))
        size = np.zeros(len(h), np.int64)
        flat: list[np.ndarray] = []
        for b in np.flatnonzero(np.diff(bound)):
            lo, hi = bound[b], bound[b + 1]
            known, start, ids = self.parts.get(int(b), (np.zeros(1, U64), np.zeros(2, np.int64), np.zeros(0, np.int32)))
            at = np.minimum(np.searchsorted(known, h[lo:hi]), len(known) - 1)
            hit = known[at] == h[lo:hi]
            n = np.where(hit, start[at + 1] - start[at], 0)
            got = _gather(ids, start[at], n)
            if not hit.all():
                self.encoder = self.encoder or Encoder.open(self.tokenizer)
                parts = np.split(got, np.cumsum(n)[:-1])
                for i in np.flatnonzero(~hit):
                    parts[i] = self.encoder.one(w.word(int(first[lo + i])))
                    n[i] = len(parts[i])
                got = np.concatenate(parts)
            size[lo:hi] = n
            flat.append(got)
        pool = np.concatenate([*flat, np.zeros(0, np.int32)])
        begin = np.cumsum(size) - size
        return _gather(pool, begin[back], size[back]), size[back]


def token_counts(docs: DataFrame, text: str, tokenizer: str, folder: str) -> DataFrame:
    """``docs`` with a last column ``n_tokens``; null text counts 0."""
    build(docs.select(F.col(text).alias("text")), folder, tokenizer)
    bits, root = buckets_of(docs.sparkSession), posix(folder)

    @F.pandas_udf("long")
    def count(s):
        column, lex = plain(pa.Array.from_pandas(s, type=pa.large_string())), Lexicon.open(root, tokenizer)
        out = []
        for lo, hi in slices(column):
            w = units(column.slice(lo, hi - lo))
            n = np.concatenate([[0], np.cumsum(lex.encode(w, bits)[1])])
            out.append(n[w.ptr[1:]] - n[w.ptr[:-1]])
        return pd.Series(np.concatenate([*out, np.zeros(0, np.int64)]))

    return docs.withColumn("n_tokens", count(F.col(text)))
