import itertools

import pytest

from tessera.llm.near_dedup import near_duplicates

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, words, k):
    w = words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute(rows, words, k, percent):
    sets = [(d, shingles(t, words, k)) for d, t in rows]
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in itertools.combinations(sets, 2):
        if s and t and min(len(s), len(t)) * 100 >= percent * max(len(s), len(t)) and 100 * len(s & t) >= percent * len(s | t):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {(d, len(s), find(d), find(d) == d) for d, s in sets}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_equals_brute_force(spark, words, width, percent):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {tuple(r) for r in near_duplicates(docs, width, percent).collect()}
    assert got == brute(rows, words, width, percent)


def test_families_and_odd_rows(spark, words):
    base = [f"w{i}" for i in range(120)]
    rows = [(1000 + i, " ".join(base[:i % 90 + 3] + [f"x{i}"] + base[i % 90 + 4 :])) for i in range(700)]  # all near one another
    rows += [(i, " ".join(base[i : i + 60])) for i in range(60)]  # a chain whose ends are far apart
    rows += [(2000, None), (2001, ""), (2002, " \t"), (2003, "one two"), (2004, "ONE  two"), (2005, "two one"), (2006, "one two"), (2006, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS sid", "2 AS label", "text AS least", "'x' AS lang")
    got = [tuple(r) for r in near_duplicates(docs, 3, 85).collect()]
    assert len(got) == len(rows)
    assert set(got) == brute(list(dict(rows).items()), words, 3, 85)


def test_null_ids_and_shared_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (1, "a b c d"), (2, "a b c d"), (2, "e f g h"), (3, "e f g h"), (4, None), (4, "e f g h")], "doc_id long, text string")
    got = sorted((tuple(r) for r in near_duplicates(docs, 3, 85).collect()), key=str)
    assert {x for x in got if x[0] is not None} == {(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 1, False), (4, 2, 1, False)}
    assert [x[2:] for x in got if x[0] is None] == [(None, True)] * 2


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
