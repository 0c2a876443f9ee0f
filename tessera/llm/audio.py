"""Media columns: chroma fingerprints of audio and the alignment of recordings.

A binary WAV column is decoded, folded to mono and ``RATE``, cut into overlapping frames, and the
spectrum of each is summed into 12 pitch classes. Sixteen filters compare rectangles of that
image of pitch class by time, each read from its integral image with a few lookups; each
comparison is quantised to two Gray-coded bits, so every frame position becomes one packed 32-bit integer.

Recordings are aligned as in any acoustic index: equal keys of a query and a recording vote for a difference of positions, the
histogram's best difference is verified by the share of differing bits over the whole overlap. A key holds the
upper ``KEY_BITS`` bits of two prints ``LAG`` positions apart, 40 bits in all, so chance meetings stay
far below the true ones however many recordings there are. A query is fingerprinted at ``PHASES`` starts within
one hop, since frames half a hop apart would share few keys. Recordings are spread over ``SALTS``
parts of each key, so a key that a third of them share is no single task.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import save, workspace

RATE, FRAME, HOP = 5512, 2048, 512
LOW_HZ, HIGH_HZ = 55.0, 2200.0
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
#: (kind, first pitch class, pitch classes, frames); kinds are named in `_areas`.
FILTERS = [(0, 0, 4, 3), (0, 4, 4, 3), (0, 8, 4, 3), (1, 0, 12, 4), (1, 2, 8, 8), (1, 6, 6, 14), (2, 0, 6, 6), (2, 6, 6, 6), (2, 0, 12, 12), (3, 0, 8, 8), (3, 4, 8, 8), (3, 0, 12, 14), (4, 0, 9, 4), (4, 3, 9, 8), (5, 0, 8, 9), (5, 4, 8, 12)]
SPAN = max(f[3] for f in FILTERS)
KEY_BITS, LAG = 20, 8
SALTS, PHASES = 8, 4
#: An alignment needs so many equal keys, so long an overlap and at most this share of differing bits.
VOTES, OVERLAP, MOST_ERROR = 2, 12, 0.3
_GRAY = np.array([0, 1, 3, 2], np.uint32)


def write_wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    """16-bit mono PCM of samples in -1 to 1."""
    data = (np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def read_wav(data: bytes) -> tuple[int, np.ndarray] | None:
    """(rate, mono samples) of 8-, 16- or 32-bit PCM; None for anything else or broken files."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt " and size >= 16 and at + 24 <= len(data):
            form = struct.unpack_from("<HHIIHH", data, at + 8)
        if name == b"data":
            if form is None or form[0] != 1 or form[5] not in (8, 16, 32) or not form[1] or not form[2]:
                return None
            width = form[5] // 8 * form[1]
            body = data[at + 8 : at + 8 + size]
            body = body[: len(body) // width * width]
            x = np.frombuffer(body, {8: "u1", 16: "<i2", 32: "<i4"}[form[5]]).astype(np.float32)
            x = (x - 128) / 128 if form[5] == 8 else x / float(1 << (form[5] - 1))
            return form[2], x.reshape(-1, form[1]).mean(axis=1)
        at += 8 + size + size % 2
    return None


def resample(x: np.ndarray, rate: int) -> np.ndarray:
    if rate == RATE or not len(x):
        return x
    k = rate // RATE
    if k > 1:  # a moving average before thinning
        x = np.convolve(x, np.ones(k, np.float32) / k, "same")
    at = np.arange(int(len(x) * RATE / rate)) * (rate / RATE)
    return np.interp(at, np.arange(len(x)), x).astype(np.float32)


_hz = np.fft.rfftfreq(FRAME, 1 / RATE)
_used = np.flatnonzero((_hz >= LOW_HZ) & (_hz <= HIGH_HZ))
_class = np.round(12 * np.log2(_hz[_used] / 440.0)).astype(int) % 12
_fold = np.zeros((len(_used), 12), np.float32)
_fold[np.arange(len(_used)), _class] = 1
_hann = np.hanning(FRAME).astype(np.float32)


def chroma(x: np.ndarray) -> np.ndarray:
    """(frames, 12) pitch class energies, smoothed over time, each frame of unit length (silence: zeros)."""
    if len(x) < FRAME:
        return np.zeros((0, 12))
    out = []
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    for lo in range(0, len(frames), 256):
        spectrum = np.abs(np.fft.rfft(frames[lo : lo + 256] * _hann, axis=1)[:, _used]).astype(np.float32)
        out.append(spectrum**2 @ _fold)
    c = np.concatenate(out).astype(np.float64)
    if len(c) >= len(SMOOTH):
        n = len(c) - len(SMOOTH) + 1
        c = sum(w * c[k : k + n] for k, w in enumerate(SMOOTH))
    norm = np.sqrt((c**2).sum(axis=1, keepdims=True))
    return np.where(norm > 0.01, c / np.maximum(norm, 1e-12), 0.0)


def _areas(image: np.ndarray, kind: int, y: int, h: int, w: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The two rectangle sums that a filter compares, at each of the first n positions of an integral image."""

    def area(t1, t2, y1, y2):
        return image[t2 : t2 + n, y2] - image[t1 : t1 + n, y2] - image[t2 : t2 + n, y1] + image[t1 : t1 + n, y1]

    total = area(0, w, y, y + h)
    if kind == 0:  # the rectangle itself
        return total, np.zeros(n)
    if kind == 1:  # lower against upper half
        a = area(0, w, y, y + h // 2)
    elif kind == 2:  # earlier against later half
        a = area(0, w // 2, y, y + h)
    elif kind == 3:  # quarters crosswise
        a = area(0, w // 2, y, y + h // 2) + area(w // 2, w, y + h // 2, y + h)
    elif kind == 4:  # middle pitch band against its neighbours
        a = area(0, w, y + h // 3, y + h - h // 3)
    else:  # middle of time against its neighbours
        a = area(w // 3, w - w // 3, y, y + h)
    return a, total - a


def _responses(c: np.ndarray) -> np.ndarray:
    n = len(c) - SPAN + 1
    image = np.zeros((len(c) + 1, 13))
    image[1:, 1:] = c.cumsum(axis=0).cumsum(axis=1)
    out = np.empty((n, len(FILTERS)))
    for i, f in enumerate(FILTERS):
        a, b = _areas(image, *f, n)
        out[:, i] = np.log1p(np.maximum(a, 0)) - np.log1p(np.maximum(b, 0))
    return out


_cuts: np.ndarray | None = None


def cuts() -> np.ndarray:
    """(filters, 3) quartiles of the responses over fixed random chords of one to three tones, so that all four codes are used."""
    global _cuts
    if _cuts is None:
        rng, r = np.random.default_rng(3), []
        for _ in range(60):
            x = []
            for _ in range(40):
                at = np.arange(int(rng.integers(300, 2500))) / RATE
                tones = [np.sin(2 * np.pi * hz * at) * rng.uniform(0.1, 0.4) for hz in rng.uniform(110, 1400, rng.integers(1, 4))]
                x.append(sum(tones) + rng.normal(0, 0.01, len(at)))
            r.append(_responses(chroma(np.concatenate(x).astype(np.float32))))
        _cuts = np.quantile(np.concatenate(r), [0.25, 0.5, 0.75], axis=0).T
    return _cuts


def fingerprint(data: bytes | None, skip: int = 0) -> np.ndarray:
    """Packed integers of a WAV file, one each frame position from sample ``skip`` on; none for null, broken, short or silent media."""
    got = read_wav(data) if data else None
    if got is None:
        return np.zeros(0, np.uint32)
    c = chroma(resample(got[1], got[0])[skip:])
    if len(c) < SPAN or not c.any():
        return np.zeros(0, np.uint32)
    r, limits = _responses(c), cuts()
    code = sum((r >= limits[None, :, k]).astype(np.int64) for k in range(3))
    bits = _GRAY[code]
    return (bits << (2 * np.arange(len(FILTERS), dtype=np.uint32))[::-1]).sum(axis=1).astype(np.uint32)


def _prints(keys: list, media: Iterator[bytes | None], key: str, phases: int) -> pa.RecordBatch:
    skips = [HOP * i // phases for i in range(phases)]
    found = [fingerprint(m, skip) for m in media for skip in skips]
    at = np.cumsum([0, *map(len, found)]).astype(np.int32)
    prints = pa.ListArray.from_arrays(at, np.concatenate([*found, np.zeros(0, np.uint32)]).astype(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(keys, object), phases).tolist(), pa.int64()), pa.array(list(range(phases)) * len(keys), pa.int32()), prints], names=[key, "phase", "prints"])


def fingerprints(media: DataFrame, key: str, column: str, phases: int = 1) -> DataFrame:
    """(key, phase, prints array<long>): ``phases`` rows for each row of ``media``, at starts spread over one hop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _prints(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1)), key, phases)

    return media.select(F.col(key).cast("long").alias(key), column).mapInArrow(run, f"{key} long, phase int, prints array<long>")


def _keyed(df: DataFrame, prints: str, place: str) -> DataFrame:
    """``df`` with one row for each place whose print and the one ``LAG`` behind it make the key ``k``."""
    low = 32 - KEY_BITS
    later = F.slice(prints, LAG + 1, F.greatest(F.size(prints) - LAG, F.lit(0)))
    keys = F.zip_with(later, F.slice(prints, 1, F.size(later)), lambda a, b: F.shiftleft(F.shiftright(b, low), KEY_BITS).bitwiseOR(F.shiftright(a, low)))
    return df.select("*", F.posexplode(keys).alias(place, "k"))


def align(queries: DataFrame, recordings: DataFrame) -> DataFrame:
    """(query_id, class_id, shift, votes, overlap, bit_error) of all pairs that align.

    ``queries`` (query_id, phase, prints) and ``recordings`` (rec_id, prints): equal prints are one class, named by the
    least rec_id, so copies of a recording cost one posting list. Query position plus ``shift`` is the recording's
    position; of several phases the one with the least bit error (then the first) stands for the query. Rows without prints align
    with nothing; null ids are left out.
    """
    path = workspace(queries.sparkSession, "align")
    classes = save(recordings.filter("size(prints) > 0 AND rec_id IS NOT NULL").groupBy("prints").agg(F.min("rec_id").alias("class_id")), f"{path}/classes")
    asked = save(queries.filter("size(prints) > 0 AND query_id IS NOT NULL").select("query_id", "phase", F.col("prints").alias("asked")), f"{path}/queries")
    q = _keyed(asked, "asked", "i").select("query_id", "phase", "i", "k", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    c = _keyed(classes, "prints", "j").select("class_id", "j", "k", F.pmod(F.xxhash64("class_id"), F.lit(SALTS)).cast("int").alias("salt"))
    votes = q.join(c, ["k", "salt"]).groupBy("query_id", "phase", "class_id", (F.col("j") - F.col("i")).alias("shift")).agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("query_id", "phase", "class_id").agg(F.max(F.struct("votes", (-F.col("shift")).alias("s"))).alias("b")).filter(F.col("b.votes") >= VOTES).select("query_id", "phase", "class_id", (-F.col("b.s")).alias("shift"), "b.votes")
    both = best.join(asked, ["query_id", "phase"]).join(classes, "class_id")
    skip_q, skip_c = F.greatest(-F.col("shift"), F.lit(0)), F.greatest(F.col("shift"), F.lit(0))
    both = both.withColumn("overlap", F.least(F.size("asked") - skip_q, F.size("prints") - skip_c)).filter(F.col("overlap") >= OVERLAP)
    differing = F.aggregate(F.zip_with(F.slice("asked", skip_q + 1, F.col("overlap")), F.slice("prints", skip_c + 1, F.col("overlap")), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    both = both.withColumn("bit_error", differing / (F.col("overlap") * 32.0)).filter(F.col("bit_error") <= MOST_ERROR)
    least = both.groupBy("query_id", "class_id").agg(F.min(F.struct("bit_error", "phase", "shift", "votes", "overlap")).alias("b"))
    return least.select("query_id", "class_id", "b.shift", "b.votes", "b.overlap", "b.bit_error")


def render(values: np.ndarray, noise: float = 0.0, seed: int = 0) -> np.ndarray:
    """A melody of a vector: each value a note of about an eighth of a second, two partials; deterministic."""
    v = np.nan_to_num(np.asarray(values, float), posinf=0, neginf=0)
    note = np.clip(np.round(v / 0.125 * 6), -14, 14)
    n = 660
    phase = np.cumsum(np.repeat(440 * 2 ** (note / 12), n)) * (2 * np.pi / RATE)
    x = (0.5 * np.sin(phase) + 0.2 * np.sin(2 * phase)).astype(np.float32)
    if noise:
        x = x + np.random.default_rng(seed).normal(0, noise, len(x)).astype(np.float32)
    return x


def recording(key: int | None, vector: list | None, excerpt: bool = False) -> bytes | None:
    """A vector as a WAV file. An excerpt begins in the middle of the ninth note, ends before the last eight, and is noisy."""
    if vector is None:
        return None
    x = render([0.0 if y is None else y for y in vector], 0.05 * excerpt, key or 0)
    return write_wav(x[8 * 660 + 330 : max(len(x) - 8 * 660, 0)] if excerpt else x)


def recordings(vectors: DataFrame, excerpt: bool = False) -> DataFrame:
    """(vec_id, media): each vector of (vec_id, embedding) as a WAV file; null vectors have null media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                media = [recording(k, v, excerpt) for k, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], names=["vec_id", "media"])

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "vec_id long, media binary")


def rendered(vectors: DataFrame, excerpt: bool = False, phases: int = 1) -> DataFrame:
    """``fingerprints(recordings(vectors))`` in one pass: a recording lives only while it is fingerprinted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                keys, part = batch.column(0).slice(lo, 256).to_pylist(), batch.column(1).slice(lo, 256).to_pylist()
                yield _prints(keys, (recording(k, v, excerpt) for k, v in zip(keys, part, strict=True)), "vec_id", phases)

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "vec_id long, phase int, prints array<long>")


def align_excerpts(vectors: DataFrame) -> DataFrame:
    """One row for each of ``vectors`` (vec_id, embedding, any others), rendered as recordings.

    vec_id, n_prints, class_id (the least id with the same prints), is_query, and for queries (ids divisible by
    20, as noisy excerpts against all recordings) the class they align with at the least bit error (then least class), its shift and bit error,
    and how many classes align. Null vectors have no prints and null class. Null ids are no queries; repeated rows repeat. An
    empty table gives an empty result.
    """
    path = workspace(vectors.sparkSession, "audio")
    prints = save(rendered(vectors), f"{path}/prints")
    asked = rendered(vectors.filter("vec_id % 20 = 0").dropDuplicates(["vec_id"]), True, PHASES)
    found = align(asked.withColumnRenamed("vec_id", "query_id"), prints.select(F.col("vec_id").alias("rec_id"), "prints"))
    best = found.groupBy("query_id").agg(F.min(F.struct("bit_error", "class_id", "shift")).alias("b"), F.count(F.lit(1)).alias("n_aligned"))
    h = prints.select("vec_id", F.size("prints").cast("long").alias("n_prints"), F.when(F.size("prints") > 0, F.sha2(F.concat_ws(",", "prints"), 256)).alias("h"))
    classes = h.filter("h IS NOT NULL").groupBy("h").agg(F.min("vec_id").alias("class_id"))
    out = h.join(classes, "h", "left").join(best.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
    is_query = F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False))
    return out.select("vec_id", "n_prints", "class_id", is_query.alias("is_query"), F.col("b.class_id").alias("best_class"), F.col("b.shift").cast("long").alias("shift"), F.round("b.bit_error", 6).alias("bit_error"), F.when(is_query, F.coalesce("n_aligned", F.lit(0))).alias("n_aligned"))


def op9_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_excerpts(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
