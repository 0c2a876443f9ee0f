import bisect
import hashlib
import re

import numpy as np
import pyarrow as pa

from tessera.llm.spotsigs import ANCHORS, fingerprints, search, spot_sets


def edits(rows):
    """[(doc_id, text, edited, next text)] by descending id, null last, ties by text."""
    rows = sorted(rows, key=lambda r: r[1] or "")
    rows = sorted(rows, key=lambda r: -(1 << 63) if r[0] is None else r[0], reverse=True)
    out = []
    for i, (d, t) in enumerate(rows):
        t, n = t or "", rows[(i + 1) % len(rows)][1] or ""
        out.append((d, t, t[: len(t) - len(t) // 2] + n[: len(t) // 2], n))
    return out


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_sets(text):
    """Signatures as tuples of words, by the definition."""
    words = [w.strip(".,;:!?\"'()[]{}<>*%$&#") for w in re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))]
    words = [w for w in words if w]
    content = [i for i, w in enumerate(words) if w not in ANCHORS]
    out, used = set(), set()
    for i, w in enumerate(words):
        if w in ANCHORS:
            k = bisect.bisect(content, i)
            if k + 1 < len(content):
                out.add((w, words[content[k]], words[content[k + 1]]))
                used |= {i, content[k], content[k + 1]}
    return out | {(w,) for i, w in enumerate(words) if i not in used}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else float(not a and not b)


def sets(texts):
    return list(spot_sets(pa.array(texts, pa.large_string())))


def expect(rows):
    out = []
    for d, t, e, n in edits(rows):
        a, b, c = map(plain_sets, (t, e, n))
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), len(a), len(b), round(jaccard(a, b), 12), round(jaccard(a, c), 12)))
    return sorted(out, key=str)


def shown(rows):
    """Rows with the sizes of the fingerprints in place of them."""
    return sorted(((*r[:3], len(r[3]) // 8, len(r[4]) // 8, round(r[5], 12), round(r[6], 12)) for r in rows), key=str)


def test_whole_table(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = [tuple(r) for r in fingerprints(documents.repartition(5).withColumn("bucket", documents.doc_id)).collect()]
    assert shown(got) == expect(rows)
    of = {}
    for d, t in rows:
        of.setdefault(frozenset(plain_sets(t or "")), set()).add(next(r[3] for r in got if r[0] == d))
    assert all(len(x) == 1 for x in of.values()) and len({x for v in of.values() for x in v}) == len(of)
    assert np.mean([r[5] for r in got]) > np.mean([r[6] for r in got]) + 0.2


def test_odd_rows(spark):
    rows = [(5, "the big dog and the small cat é𝄞"), (4, None), (3, ""), (9, "x"), (-2, "of the"), (8, "..., !!"), (7, "word " * 40000), (6, "x"), (None, "null id")]
    got = [tuple(r) for r in fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert shown(got) == expect(rows)
    by = {r[0]: r for r in got}
    assert by[9][3] == by[6][3] and by[4][3] == "" and by[4][5] == 1.0
    twice = [(1, "a b"), (1, "a b"), (2, "c d")]
    assert shown(tuple(r) for r in fingerprints(spark.createDataFrame(twice, "doc_id long, text string")).collect()) == expect(twice)
    one = fingerprints(spark.createDataFrame([(1, "solo text")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_signatures_are_chains():
    a, b, c = sets(["the cat sat of dog ran away", "The, cat (sat) of dog ran home", "the of cat sat"])
    assert len(set(a) & set(b)) == 2 and len(c) == 2
    assert [len(s) for s in sets(["the w v. " * 3, "word............ (((((((((word)", "alpha beta gamma", "the of and"])] == [1, 1, 3, 3]


def test_small_edit_changes_little_at_any_length():
    text = lambda n: " ".join(f"the w{i} v{i}" for i in range(n))
    for n in range(1, 12):
        a, b = sets([text(n), text(n + 1)])
        assert len(set(a.tolist()) & set(b.tolist())) == n and len(b) == n + 1


def test_search_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(500)
    rows = docs.collect()
    all_sets = {r.doc_id: set(s.tolist()) for r, s in zip(rows, sets([r.text for r in rows]))}
    want = {(q, d) for q in all_sets if q % 20 == 0 for d in all_sets if d != q and all_sets[q] and len(all_sets[q] & all_sets[d]) >= 0.8 * len(all_sets[q] | all_sets[d])}
    got = search(docs, docs.filter("doc_id % 20 = 0"), 0.8).collect()
    assert len(got) == len(want) and {(r.query_id, r.doc_id) for r in got} == want


def test_large_sets_are_whole(spark):
    word = lambda i: f"the w{i} v{i} "
    a, b = "".join(map(word, range(1000))), "".join(map(word, range(10, 1010)))
    got = {r.doc_id: r for r in fingerprints(spark.createDataFrame([(2, a), (1, b)], "doc_id long, text string")).collect()}
    full = [set(s.tolist()) for s in sets([a, b])]
    assert len(full[0]) == 1000 and len(got[2].fingerprint) == 8 * 1000
    assert got[2].near_next == len(full[0] & full[1]) / len(full[0] | full[1]) == 990 / 1010
    changed = a.replace(word(999), "the w999 other ")
    one = fingerprints(spark.createDataFrame([(1, changed)], "doc_id long, text string")).collect()[0]
    assert one.fingerprint != got[2].fingerprint
