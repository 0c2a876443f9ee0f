import zlib

import numpy as np

from tessera.llm.language_id import DIM, language_id, space, trigrams


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = language_id(docs.withColumnRenamed("n_chars", "score")).collect()
    assert {r.doc_id for r in rows} == set(truth) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98


def test_odd_rows(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de")] * 20)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "12 34 !!", "en"), (103, "the dog", None), (None, "und die", None), (104, "a", None), (105, "жук", None), (103, "the dog", None)]
    got = language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and by[100].score == 0.0
    assert by[103].lang_pred == "en" and by[None].lang_pred == "de" and by[104].lang_pred in ("en", "de") and by[105].lang_pred in ("en", "de")


def test_nothing_learned(spark):
    assert language_id(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []
    got = language_id(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()
    assert got[0].lang_pred == "und" and got[0].score == 0.0


def test_bundles_equal_binding_one_by_one():
    gram, owner = trigrams(["Ab c", "", "xyz"])
    assert owner.tolist() == [0, 0, 0, 2, 2, 2]
    s = space()
    base = np.random.default_rng(11).integers(0, 2, (512, DIM)).astype(np.int8) * 2 - 1
    want = sum(np.roll(base[a], 2) * np.roll(base[b], 1) * base[c] for a, b, c in ((0, 97, 98), (97, 98, 0), (0, 99, 0)))
    own = gram[owner == 0]
    assert (s.bundle(own, np.ones(len(own))) == want).all()
    s.learn(np.unique(own))
    assert (s.bundle(own, np.ones(len(own))) == want).all()


def test_letters_only(spark):
    texts = ["½ ²³", "１２３", "٣٤ ۴", "12 34", "\u0301\u0302", "", None, "...", "𝐀𝐁𝐂", "𐐀𐐁", "Ж", "ß", "é"]
    docs = spark.createDataFrame([(0, "the cat sat on the mat", "en"), *((i, t, None) for i, t in enumerate(texts, 1))], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id(docs).collect()}
    learned = any(r.lang_pred != "und" for r in got.values())
    assert all((got[i].lang_pred == "und") == (i <= 8 or not learned) for i in range(1, len(texts) + 1))
    assert all(got[i].score == 0 for i in range(1, 9))


def test_other_scripts_share_no_vector_with_latin():
    from tessera.llm.language_id import LETTERS, trigrams

    code = lambda t: set((trigrams([t])[0] // LETTERS % LETTERS).tolist())
    assert not code("abcdefghijklmnopqrstuvwxyzäöüß") & code("абвгдежзийклмнопрстуфхцчшщъыьэюяαβγδεζηθικλμνξοπρστυφχψω")
