import os

import pytest

from tessera.functions import fmt, paths
from tessera.operators import archive as ar
from tessera.operators import content, names, vectors
from tessera.operators.ordering import in_order


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_alignment(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(n,) for n in (0, 1, 64, 65, 100)], "n long")
    assert [tuple(r) for r in d.select(ar.align_up(F.col("n")), ar.padding_for(F.col("n"))).collect()] == [(0, 0), (64, 63), (64, 0), (128, 63), (128, 28)]


def test_paths_and_formats(spark):
    from pyspark.sql import functions as F

    for path, n, want in (("a/b/c", 1, "b/c"), ("a/b/c", 2, "c"), ("a/b", 2, None), ("a/", 1, None), ("/a/b", 1, "a/b"), ("x", 0, "x")):
        assert one(spark, paths.strip_components(F.lit(path), n)) == want
    assert one(spark, paths.clean_name(F.lit("./a/b//"))) == "a/b"
    for mode, kind, want in ((0o100644, "file", "-rw-r--r--"), (0o041777, "dir", "drwxrwxrwt"), (0o104755, "file", "-rwsr-xr-x"), (0o120777, "symlink", "lrwxrwxrwx"), (0o102644, "file", "-rw-r-Sr--"), (0, "odd", "?---------")):
        assert one(spark, fmt.format_mode(F.lit(mode), F.lit(kind))) == want
    for n, want in ((0, "0.00 B"), (1023, "1023.00 B"), (1024, "1.00 KB"), (1152, "1.12 KB"), (5 << 40, "5.00 TB"), (5 << 50, "5120.00 TB")):
        assert one(spark, fmt.format_bytes(F.lit(n))) == want
    assert one(spark, fmt.format_memory(F.lit(1024))) == "1024.0 B" and one(spark, fmt.format_count(F.lit(2_500_000))) == "2M"
    assert one(spark, fmt.json_bytes(F.lit(b'a"\\\n\x01\x7f\xe9'))) == 'a\\"\\\\\\n\\u0001\\u007f\\u00e9'
    assert one(spark, paths.common_prefix(F.lit("café"), F.lit("cafè"))) == 4
    assert fmt.format_duration(0.5) == "500.00 ms" and fmt.format_duration(75) == "1 m 15.0 s"


def test_order_is_the_same_at_any_parallelism(spark):
    rows = [(f"k{i * 7919 % 1000:04d}", i) for i in range(1000)]
    for parts in (1, 3, 16):
        d = in_order(spark.createDataFrame(rows, "name string, n long").repartition(5), ["name"], "id", {"before": "n"}, parts)
        want = 0
        for i, r in enumerate(d.orderBy("name").collect()):
            assert r.id == i and r.before == want
            want += r.n
    assert in_order(spark.createDataFrame([], "name string, n long"), ["name"], "id").collect() == []


def test_duplicate_names_find_the_first(spark):
    f = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "file_id long, name string")
    w = content.request(spark, ["b", "a", "z", "a"])
    assert sorted((r.pos, r.file_id) for r in content.find(f, w).collect()) == [(0, 2), (1, 0), (3, 0)]
    assert [r.name for r in content.missing(f, w).collect()] == ["z"]


def test_dedup_of_another_size_is_not_merged(spark):
    f = spark.createDataFrame([(0, "file", 3, "h"), (1, "file", 4, "h"), (2, "file", 3, "h"), (3, "file", 0, "e"), (4, "file", 0, "e"), (5, "dir", 0, "e")], "file_id long, entry_type string, logical_size long, digest string")
    assert {r.file_id: r.canonical_id for r in ar.canonical_files(f).collect()} == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4, 5: 5}


def test_names(spark):
    f = spark.createDataFrame([(i, n) for i, n in enumerate(["a", "a-b", "a/b", "a/c/d"])], "file_id long, name string")
    assert [(r.prefix_len, r.suffix_len) for r in names.front_coding(f).orderBy("file_id").collect()] == [(0, 1), (1, 2), (1, 2), (2, 3)]
    assert {r.prefix: (r.is_entry, r.n_children) for r in names.trie_nodes(f).collect()} == {"a": (True, 2), "a-b": (True, 0), "a/b": (True, 0), "a/c": (False, 1), "a/c/d": (True, 0)}
    assert names.recommend_format(f).first().name_format == "raw" and names.is_sorted(f).first().is_sorted


def test_vectors(spark):
    d = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, [-1.0, 0.0])], "id long, v array<float>")
    assert [round(r.similarity, 6) for r in vectors.similarity(d, "id", "v").orderBy("id").collect()] == [1.0, 0.0, 0.0, 0.707107, -1.0]
    assert [r.similarity for r in vectors.similarity(d, "id", "v", "euclidean").orderBy("id").collect()] == [0.0, -2.0, -1.0, -1.0, -4.0]
    assert [r.id for r in vectors.vector_order(d, "id", "v").orderBy("position").collect()] == [0, 3, 1, 2, 4]
    assert [r.id for r in vectors.vector_order(d, "id", "v", batch_size=2).orderBy("position").collect()] == [0, 1, 3, 2, 4]
    same = spark.createDataFrame([(i, [1.0]) for i in range(4)], "id long, v array<float>")
    assert [r.id for r in vectors.vector_order(same, "id", "v").orderBy("position").collect()] == [0, 1, 2, 3]
    assert vectors.batch_size(64) == 1747626 and vectors.batch_size(10**9) == 1000
    with pytest.raises(KeyError):
        vectors.similarity(d, "id", "v", "manhattan")


def test_streaming(spark, tmp_path):
    from tessera.streaming import ingest

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.write.parquet(f"{tmp_path}/in")
    s = ingest.read_documents(spark, f"{tmp_path}/in", docs.schema)
    q = ingest.running_totals(s).writeStream.outputMode("complete").format("memory").queryName("totals").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("totals").selectExpr("sum(n_files) AS n").first().n == docs.count()
    ingest.index_batches(s, f"{tmp_path}/idx", f"{tmp_path}/cp", num_hashes=4).awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/idx").count() == docs.count()


def lanes_and_pairs(spark, bit_width):
    """Sketches of few values with lanes of all ones, and the scores of all pairs by brute force."""
    import random

    from tessera.operators import minhash

    r = random.Random(3)
    none = minhash.empty_lane(bit_width)
    rows = [(i, [r.choice([-5, 1, 2, 3, none]) for _ in range(4)]) for i in range(40)] + [(40, [none] * 4), (41, None)]
    index = spark.createDataFrame(rows, "file_id long, sketch array<bigint>").repartition(3)
    queries = index.filter("file_id % 5 = 0").selectExpr("file_id AS query", "sketch")
    scores = {(q, f): sum(x == y != none for x, y in zip(a, b)) / 4 for q, a in rows if q % 5 == 0 for f, b in rows if a and b}
    return index, queries, {k: v for k, v in scores.items() if v > 0}


@pytest.mark.parametrize("bit_width", [32, 64])
def test_search_counts_lanes_in_blocks_without_a_shuffle(spark, monkeypatch, bit_width):
    from tessera.operators import minhash

    index, queries, want = lanes_and_pairs(spark, bit_width)
    for at_once in (3, 4096):
        monkeypatch.setattr(minhash, "LANE_QUERIES", at_once, raising=False)
        found = minhash.search_all(index, queries, 4, bit_width)
        assert sorted((r.query, r.file_id, r.score) for r in found.collect()) == sorted((q, f, s) for (q, f), s in want.items())
        assert {(r.query, r.file_id) for r in minhash.search_all(index, queries, 4, bit_width, 0.5).collect()} == {k for k, s in want.items() if s > 0.5}
    plan = minhash.search_all(index, queries, 4, bit_width)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert minhash.search_all(index, queries.limit(0), 4, bit_width).collect() == []


def test_search_makes_each_sketch_once(spark):
    from tessera.operators import minhash

    files = spark.createDataFrame([(i, f"f{i}", "file", bytes([i]) * 20) for i in range(4)], "file_id long, name string, entry_type string, content binary")
    _, queries, _ = lanes_and_pairs(spark, 64)
    plan = minhash.search_all(minhash.build(files, 4), queries, 4, 64)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == 1


def test_best_of_a_search_are_cut_in_its_tasks(spark, monkeypatch):
    from tessera.operators import minhash

    index, queries, scores = lanes_and_pairs(spark, 64)
    want = sorted((q, f, s) for q in {q for q, _ in scores} for s, f in [(-s, f) for s, f in sorted((-s, f) for (x, f), s in scores.items() if x == q)[:3]])
    for at_once in (3, 4096):
        monkeypatch.setattr(minhash, "LANE_QUERIES", at_once)
        handed = minhash.search_all(index, queries, 4, 64, top_n=3)
        assert sorted((r.query, r.file_id, r.score) for r in minhash.best(handed, 3).collect()) == want
        assert max(r["count"] for r in handed.groupBy("query").count().collect()) <= 3 * index.rdd.getNumPartitions()


def test_nearest_vectors_in_small_steps(spark, monkeypatch):
    import random

    import numpy as np

    r = random.Random(5)
    rows = [(i, [float(r.choice([-1, 0, 1])) for _ in range(2)]) for i in range(400)] + [(400, None), (401, [1.0, 2.0, 3.0]), (402, [3.0, 2.0, 1.0]), (403, [float("nan"), 1.0])]
    d = spark.createDataFrame(rows, "id long, v array<float>").repartition(3)
    asked = d.filter("id % 50 = 0 OR id = 401").selectExpr("id AS query", "v AS vector")
    whole = {i: np.array(v) for i, v in rows if v}
    want = []
    for q in [i for i in whole if i % 50 == 0 or i == 401]:
        a = []
        for f, v in whole.items():
            if len(v) == len(whole[q]):
                scale = np.linalg.norm(whole[q]) * np.linalg.norm(v)
                s = 0.0 if scale < 1e-8 else float(whole[q] @ v / scale)
                a.append((-2.0 if np.isnan(s) else -round(s, 6), f))  # NaN is the greatest
        want += [(q, f, -s) for s, f in sorted(a)[:7]]
    for at_once in (2, 4096):
        monkeypatch.setattr(vectors, "BLOCK", at_once)
        # Rounded, so that ties don't depend on the last bit.
        got = [(x.query, x.id, 2.0 if np.isnan(x.similarity) else round(x.similarity, 6)) for x in vectors.top_k(d, asked, "id", "v", 7).collect()]
        assert sorted((q, s) for q, _, s in got) == sorted((q, s) for q, _, s in want)
        assert sum(s == 2.0 for _, _, s in got) == 8 and {f for q, f, _ in got if q == 401} == {401, 402}


def test_files_are_numbered_without_their_content(spark):
    import hashlib

    e = spark.createDataFrame([(n, "file", c, 420, 7, None) for n, c in (("b", b"x" * 30), ("a", b"x" * 30), ("c", b""))], "name string, entry_type string, content binary, mode long, mtime long, symlink_target string")
    at = ar.build_archive(e, ar.WriteOptions(block_size=8, dedup=True))
    kept = spark.read.parquet(*[os.path.dirname(f) for f in at.files.inputFiles()[:1]])
    assert "file_id" in kept.columns and "content" not in kept.columns
    assert [(r.name, bytes(r.hash)) for r in at.files.orderBy("file_id").collect()] == [(n, hashlib.sha256(c).digest()) for n, c in (("a", b"x" * 30), ("b", b"x" * 30), ("c", b""))]
    assert {r.name: bytes(r.content) for r in content.read_files(at).collect()} == {"a": b"x" * 30, "b": b"x" * 30, "c": b""}
