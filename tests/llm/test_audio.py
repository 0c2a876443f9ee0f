from collections import Counter

import numpy as np

from tessera.llm import audio
from tessera.llm.audio import HOP, KEY_BITS, LAG, MOST_ERROR, OVERLAP, PHASES, VOTES, align, align_excerpts, chroma, fingerprint, read_wav, recording, render, resample, write_wav


def test_wav_round_trip_and_rejects():
    x = np.sin(np.arange(9000) / 9).astype(np.float32) * 0.7
    rate, y = read_wav(write_wav(x))
    assert rate == audio.RATE and np.abs(x - y).max() < 1e-4
    for bad in (b"", b"RIFF", b"x" * 100, write_wav(x)[:20], write_wav(x).replace(b"fmt ", b"xxxx")):
        assert read_wav(bad) is None
        assert len(fingerprint(bad)) == 0
    assert len(fingerprint(None)) == len(fingerprint(write_wav(x[:100]))) == len(fingerprint(write_wav(np.zeros(40000)))) == 0


def test_chroma_finds_the_pitch_class():
    t = np.arange(audio.RATE * 2) / audio.RATE
    for semitone in (0, 3, 7, 14):
        c = chroma(np.sin(2 * np.pi * 440 * 2 ** (semitone / 12) * t).astype(np.float32))
        assert (c.argmax(axis=1) == semitone % 12).all()


def test_integral_image_equals_sums():
    c = chroma(render(np.random.default_rng(5).normal(0, 0.125, 40)))
    r = audio._responses(c)
    for i, (kind, y, h, w) in enumerate(audio.FILTERS):
        for t in (0, len(r) - 1):
            box = c[t : t + w, y : y + h]
            a = {0: box, 1: box[:, : h // 2], 2: box[: w // 2], 4: box[:, h // 3 : h - h // 3], 5: box[w // 3 : w - w // 3]}.get(kind)
            a = a.sum() if a is not None else box[: w // 2, : h // 2].sum() + box[w // 2 :, h // 2 :].sum()
            b = 0 if kind == 0 else box.sum() - a
            assert abs(r[t, i] - (np.log1p(a) - np.log1p(b))) < 1e-9


def test_noise_and_rate_change_few_bits():
    v = np.random.default_rng(6).normal(0, 0.125, 64)
    a, b = fingerprint(write_wav(render(v))), fingerprint(write_wav(render(v, 0.05, 1)))
    high = np.interp(np.arange(0, 64 * 660, 0.5), np.arange(64 * 660), render(v))
    c = fingerprint(write_wav(high, audio.RATE * 2))
    other = fingerprint(write_wav(render(v[::-1])))
    err = lambda x, y: np.mean([bin(int(p) ^ int(q)).count("1") for p, q in zip(x, y)]) / 32
    assert err(a, b) < 0.1 and err(a, c) < 0.1 and err(a, other) > 0.3
    assert len(resample(high.astype(np.float32), audio.RATE * 2)) == 64 * 660


def brute(queries, recs):
    keys = lambda p: [(p[i] >> (32 - KEY_BITS), p[i + LAG] >> (32 - KEY_BITS)) for i in range(len(p) - LAG)]
    rec_keys = {r: keys(b) for r, b in recs.items()}
    out = {}
    for (q, phase), a in queries.items():
        own = keys(a)
        for r, b in recs.items():
            if not set(own) & set(rec_keys[r]):
                continue
            votes = Counter(j - i for i, x in enumerate(own) for j, y in enumerate(rec_keys[r]) if x == y)
            if not votes:
                continue
            shift, n = min(votes.items(), key=lambda v: (-v[1], v[0]))
            i, j = max(-shift, 0), max(shift, 0)
            m = min(len(a) - i, len(b) - j)
            if n >= VOTES and m >= OVERLAP:
                e = sum(bin(x ^ y).count("1") for x, y in zip(a[i : i + m], b[j : j + m])) / (32 * m)
                if e <= MOST_ERROR:
                    out[q, r] = min(out.get((q, r), (2.0,)), (e, phase, shift, n, m))
    return {k: (shift, n, m, round(e, 9)) for k, (e, _, shift, n, m) in out.items()}


def phases(wav):
    return [fingerprint(wav, HOP * i // PHASES).tolist() for i in range(PHASES)]


def test_alignment_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    vectors = {i: rng.normal(0, 0.125, 64) for i in range(12)}
    recs = {i: fingerprint(write_wav(render(v))).tolist() for i, v in vectors.items()}
    asked = {(100 + i, k): p for i in range(6) for k, p in enumerate(phases(write_wav(render(vectors[i], 0.03, i)[5888 + 60 * i : 36000])))} | {(200, 0): [], (201, 0): recs[3][5:]}
    rd = spark.createDataFrame([*recs.items(), (50, recs[4]), (51, []), (None, recs[1])], "rec_id long, prints array<long>")
    qd = spark.createDataFrame([(*k, p) for k, p in asked.items()] + [(None, 0, recs[1])], "query_id long, phase int, prints array<long>")
    got = {(r.query_id, r.class_id): (r.shift, r.votes, r.overlap, round(r.bit_error, 9)) for r in align(qd, rd).collect()}
    assert got == brute(asked, recs)
    assert all((100 + i, i) in got for i in range(6)) and got[201, 3][3] == 0.0


def test_whole_table(spark):
    """Recall over all queries of sf0.1: every excerpt finds its recording (README states it)."""
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = align_excerpts(vectors.withColumnRenamed("label", "media")).collect()
    assert len(rows) == vectors.count()
    asked = [r for r in rows if r.is_query]
    assert len(asked) == vectors.filter("vec_id % 20 = 0").count() and np.mean([r.best_class == r.class_id for r in asked]) >= 0.9
    assert all(r.best_class is None for r in rows if not r.is_query)


def test_query_equals_brute_force(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    recs = {r.vec_id: fingerprint(recording(r.vec_id, list(r.embedding))).tolist() for r in vectors}
    first = {}
    for k in sorted(recs):
        first.setdefault(tuple(recs[k]), k)
    asked = {(r.vec_id, k): p for r in vectors if r.vec_id % 20 == 0 for k, p in enumerate(phases(recording(r.vec_id, list(r.embedding), True)))}
    found = brute(asked, {k: list(p) for p, k in first.items() if p})
    for r in align_excerpts(spark.createDataFrame(vectors)).collect():
        own = sorted((e, c, s) for (q, c), (s, _, _, e) in found.items() if q == r.vec_id)
        assert (r.n_prints, r.class_id) == (len(recs[r.vec_id]), first[tuple(recs[r.vec_id])] if recs[r.vec_id] else None)
        assert (r.best_class, r.shift, r.n_aligned) == ((own[0][1], own[0][2], len(own)) if own else (None, None, 0 if r.vec_id % 20 == 0 else None))


def test_one_pass_equals_media_column(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(20)
    media = audio.fingerprints(audio.recordings(vectors, True), "vec_id", "media")
    assert sorted(media.collect()) == sorted(audio.rendered(vectors, True).collect())


def test_long_recording(spark):
    v = np.random.default_rng(9).normal(0, 0.125, 3000).tolist()
    got = align_excerpts(spark.createDataFrame([(20, v), (21, v[:64])], "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: r.best_class for r in got} == {20: 20, 21: None} and max(r.n_prints for r in got) > 3000


def test_odd_rows(spark):
    v = [0.1, -0.2] * 32
    rows = [(0, v), (0, v), (1, None), (None, v), (2, []), (20, [float("nan")] * 64), (40, [0.1]), (60, [None] * 64)]
    got = align_excerpts(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: r for r in got}
    assert by[0].class_id == 0 and by[1].class_id is None and by[1].n_prints == 0 and not by[None].is_query and by[40].n_aligned == 0
    assert align_excerpts(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
