import zlib

import numpy as np

from tessera.llm.toxicity import WINDOW, grams, toxicity, train, windows


def test_grams_and_windows():
    first, parts, n = grams(["Ab cd", "", "e"])
    assert first.tolist() == [0, 2, 2, 3] and n == 3
    assert sorted(parts[0][0].tolist()) == [0, 0, 1, 1, 2]  # <ab ab> <cd cd> <e>
    lo, hi, text = windows(np.array([0, 0, 3, 3 + 3 * WINDOW + 1]))
    assert text.tolist()[:2] == [0, 1] and (hi - lo).max() == WINDOW and hi[-1] == 3 + 3 * WINDOW + 1 and (lo[0], hi[0]) == (0, 0)


def test_unseen_misspellings():
    rng = np.random.default_rng(0)
    clean = [f"{a}{b}" for a in ("sta", "mor", "len", "tir", "pod") for b in ("ing", "ed", "or", "ly", "um", "ak")]
    bad = ["grobnik", "grobnaz", "grobnul", "xgrobno", "grobnes", "sgrobna"]
    def doc(toxic):
        w = list(rng.choice(clean, 60))
        if toxic:
            w[rng.integers(60)] = rng.choice(bad)
        return " ".join(w)
    y = np.array([i % 2 for i in range(200)])
    m = train([doc(v) for v in y], y)
    p = m.score(["staing " * 30 + "grobnik " + "mored " * 500, "staing " * 30 + "grobnyx " + "mored " * 500, "staing lenor " * 400, "", " "])
    assert p[0] > 0.7 and p[1] > 0.7 and p[2] < 0.3 and p[3] < 0.7 and p[3] == p[4], p


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity(docs.withColumnRenamed("n_chars", "toxic"), labels).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted for r in held if truth[r.doc_id] == 1]) > 0.7
    assert np.mean([r.predicted for r in held if truth[r.doc_id] == 0]) < 0.03


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (2, "x"), (3, "İ Ω 😀" * 50)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity(docs, none).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == 0 for r in rows)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None), (None, 1), (3, 7)], "doc_id long, toxic int").selectExpr("*", "1 AS text")
    assert len(toxicity(docs, labels).collect()) == 5
    assert toxicity(docs.limit(0), labels).collect() == []


def test_letters_of_all_planes():
    from tessera.llm.toxicity import _is_letter, _letter_char

    cp = np.concatenate([np.arange(0x10000, 0x20000, 7), np.array([0x10330, 0x1E900, 0x10400, 0x1D400, 0x20000, 0x1F600, 0xE0001])]).astype(np.uint32)
    assert _is_letter(cp).tolist() == [_letter_char(chr(c)) for c in cp]
    assert _is_letter(cp[-7:]).tolist() == [True] * 5 + [False] * 2
