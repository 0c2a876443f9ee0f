import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.components import components
from tessera.llm.lexicon import distinct
from tessera.llm.textkit import counted, plain, slices, split

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB \t\n\r\x0b\x0c\x1cé中.0", max_size=40)), max_size=12)


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(0, 3))
def test_words_equal_the_pattern(texts, skip):
    column = plain(pa.array(texts, pa.string()).slice(min(skip, len(texts))))
    w = split(column)
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(upper)) for t in texts[min(skip, len(texts)) :]]
    assert [[w.word(i).decode() for i in range(w.ptr[d], w.ptr[d + 1])] for d in range(len(column))] == want
    words = [x for row in want for x in row]
    by = defaultdict(set)
    for x, h in zip(words, w.hashes().tolist()):
        by[x].add(h)
    assert all(len(v) == 1 for v in by.values()) and len({h for v in by.values() for h in v}) == len(by)


def test_hashes_see_every_byte():
    base = "x" * 100
    words = [base[:n] for n in range(1, 100)] + [base[:i] + "y" + base[i + 1 :] for i in range(100)]
    assert len(set(split(plain(pa.array(words))).hashes().tolist())) == len(words)


def test_slices_and_counts():
    column = plain(pa.array(["a" * n for n in (5, 1, 9, 30, 2, 2)]))
    got = list(slices(column, 10))
    assert [x for lo, hi in got for x in range(lo, hi)] == list(range(6)) and (3, 4) in got
    h = np.random.default_rng(0).integers(0, 50, 999).astype(np.uint64)
    k, c = counted(h)
    assert dict(zip(k.tolist(), c.tolist())) == Counter(h.tolist())
    k2, w = counted(h, np.ones(999, np.int64))
    assert (k2 == k).all() and (w == c).all()
    u, first, back = distinct(h)
    u0, f0, b0 = np.unique(h, return_index=True, return_inverse=True)
    assert (u == u0).all() and (first == f0).all() and (back == b0).all()


def test_components(spark, tmp_path):
    rng = np.random.default_rng(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)] + [tuple(map(int, rng.integers(300, 500, 2))) for _ in range(120)] + [(7, 7), (9, 8), (8, 9)]
    parent: dict[int, int] = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), f"file://{tmp_path}/c").collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long"), f"file://{tmp_path}/d").collect() == []
