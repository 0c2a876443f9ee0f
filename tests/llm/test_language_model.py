import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from tessera.llm import language_model as lm
from tessera.llm.language_model import language_model

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
END, BEGIN = ("</s>",), ("<s>",)


def discounts(counts):
    n = [sum(1 for c in counts if c == k) for k in (1, 2, 3, 4)]
    if not all(n):
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    return [min(max(v, 0.05), i + 0.95) for i, v in enumerate(d)]


def brute(rows, words):
    toks = lambda t: [*words((t or "").translate(LOWER)), END]
    train = [toks(t) for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 7 != 2]
    uni = Counter(w for t in train for w in t)
    bi = Counter((a, b) for t in train for a, b in zip([BEGIN, *t], t))
    n, v = sum(uni.values()), len(uni)
    inn, ctx = Counter(b for _, b in bi), defaultdict(list)
    for (a, _), c in bi.items():
        ctx[a].append(c)
    d2, d1 = discounts(bi.values()), discounts(inn.values())
    disc = lambda c, d: 0 if c <= 0 else d[min(c, 3) - 1]
    spare = sum(disc(c, d1) for c in inn.values())

    def p1(w):
        return (max(inn[w] - disc(inn[w], d1), 0) + spare / (v + 1)) / len(bi) if bi else 1 / (v + 1)

    def p2(a, b):
        if a not in ctx:
            return p1(b)
        c = bi[(a, b)]
        return (max(c - disc(c, d2), 0) + sum(disc(x, d2) for x in ctx[a]) * p1(b)) / sum(ctx[a])

    out = []
    for d, t in rows:
        t = toks(t)
        known = sum(w in uni for w in t)
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t)
        out.append((d, d is not None and zlib.crc32(str(d).encode()) % 7 == 2, len(t), known, n, base, sum(math.log10(p2(a, b)) for a, b in zip([BEGIN, *t], t))))
    return out


def compare(docs, words):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    key = lambda r: (str(r[0]), r[2], round(r[6], 6))
    got, want = sorted((tuple(r) for r in language_model(docs).collect()), key=key), sorted(brute(rows, words), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and np.allclose(g[5:7], w[5:7], rtol=1e-9, atol=1e-9)
    return got


def test_equals_brute_force(spark, documents, words):
    got = compare(documents, words)
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in held) > sum(g[5] for g in held)


def test_many_ranges(spark, documents, words, monkeypatch):
    monkeypatch.setattr(lm, "PER_RANGE", 1500)
    monkeypatch.setattr(lm, "FLUSH", 4000)
    compare(documents.limit(60), words)


def test_odd_rows(spark, words):
    rows = [(None, "a b"), (1, None), (2, ""), (3, "A b  a"), (3, "A b  a"), (4, "x" * 5000 + " é"), (5, "w " * 30000), (None, None)]
    compare(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS part", "text AS keys"), words)
    assert language_model(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_probabilities_sum_to_one(spark, documents, words, tmp_path):
    import pyarrow as pa

    from tessera.llm.textkit import plain

    docs = documents.limit(5)
    store = lm.train(docs, f"file://{tmp_path}/m")
    vocabulary = sorted({w for r in docs.collect() for w in words(r.text.translate(LOWER))})
    p, _, ends = lm.probabilities(store, plain(pa.array(["the " + w for w in [*vocabulary, "zzqq-unknown"]])))
    end = lm.probabilities(store, plain(pa.array(["the"])))[0][1]
    assert abs(p[ends - 1].sum() + end - 1) < 1e-9
