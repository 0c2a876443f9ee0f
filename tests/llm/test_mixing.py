from collections import defaultdict

from pyspark.sql import functions as F

from tessera.llm.mixing import mix, repeated


def water(sizes, weights=(5.0, 2.0, 1.0), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > most * sizes[s]]
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
            free.remove(s)
    return out


def check(rows, words):
    sizes, taken, biggest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        n = len(words(r.text))
        assert r.size == n and r.taken == r.copies * n and 0 <= r.copies <= 3
        sizes[r.source] += n
        taken[r.source] += r.taken
        biggest[r.source] = max(biggest[r.source], n)
    want = water(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * biggest[s] + 1


def test_targets_and_copies(spark, documents, words):
    docs = documents.withColumn("target", F.lit("clash")).withColumn("_rn", F.lit(1))
    rows = mix(docs).collect()
    assert len(rows) == documents.count()
    check(rows, words)
    again = mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.copies) for r in rows) == sorted((r.doc_id, r.copies) for r in again)


def test_hot_source_and_odd_rows(spark, words):
    rows = [(i, "hot", "w " * (i % 50)) for i in range(3000)] + [(i, f"s{i % 3}", "a b\tc" * (i % 9)) for i in range(3000, 4000)]
    rows += [(None, "s1", "x y"), (7, None, "p q r"), (8, None, None), (9, "zero", None), (9, "zero", ""), (7, None, "p q r")]
    check(mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect(), words)


def test_source_that_looks_like_null(spark, words):
    rows = [(1, None, "a b"), (2, "\0", "c d e"), (3, "0", "f"), (4, "1", "g h"), (5, "", "i j")]
    got = mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3, 4, 5]
    check(got, words)


def test_one_id_for_all_rows_and_long_text(spark, words):
    rows = [(None, "s", f"word{i} " * (i % 7)) for i in range(2000)] + [(1, "t", "w " * 60000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    check(mix(docs).collect(), words)
    assert mix(docs).filter("size > 0").groupBy("source").agg(F.countDistinct("copies")).count() == 2


def test_repeated_keeps_columns(spark, words):
    docs = spark.createDataFrame([(i, "s", "a b", 7, 8, "x") for i in range(30)], "doc_id long, source string, text string, size int, row int, copies string")
    got = repeated(docs)
    assert got.columns == docs.columns and {(r.size, r.row, r.copies) for r in got.collect()} == {(7, 8, "x")} and got.count() == 30


def test_empty(spark):
    assert mix(spark.createDataFrame([], "doc_id long, source string, text string")).collect() == []
