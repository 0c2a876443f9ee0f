import re
from collections import Counter

import pytest

from tessera.llm.token_rollup import Rollup, changes, maintain, revisions

V = ("words-1", "pieces-2")


def counts(text):
    t = text or ""
    return {"words-1": len(re.findall(r"[^\x20\x09-\x0D]+", t)), "pieces-2": len(re.findall(r"[0-9]+|[A-Za-z]+|[^\x20\x09-\x0D0-9A-Za-z]", t))}


def as_dict(df):
    return {(r.source, r.lang, r.tokenizer_version): (r.docs, r.tokens, r.chars) for r in df.collect()}


def brute(rows):
    out = {}
    for text, source, lang in rows:
        for v, n in counts(text).items():
            a, b, c = out.get((source, lang, v), (0, 0, 0))
            out[source, lang, v] = (a + 1, b + n, c + len(text or ""))
    return out


def test_insert_revise_delete(spark, tmp_path):
    rows = [("a 12 b!", "s", "en"), ("a 12 b!", "s", "en"), (None, "s", None), ("", None, "en"), ("é x y", None, None)] + [("hot doc", "hot", "en")] * 50
    docs = spark.createDataFrame(rows, "text string, source string, lang string").selectExpr("*", "upper(text) || ' more' AS revised", "1 AS tokens", "2 AS docs")
    r = Rollup(spark, f"file://{tmp_path}/r")
    assert r.totals().collect() == []
    assert r.commit("b1", changes(docs, V, 1)) and not r.commit("b1", changes(docs, V, 1))
    assert as_dict(r.totals()) == brute(rows)
    assert r.commit("b2", revisions(docs, V, "text", "revised"))
    new = [(t and t.upper() + " more" if t else (" more" if t == "" else None), s, x) for t, s, x in rows]
    assert as_dict(r.totals()) == brute(new)
    r.compact()
    assert as_dict(r.totals()) == brute(new) and r.batches() == ["b1", "b2"]
    assert not r.commit("b2", changes(docs, V, 1))
    assert r.commit("b3", changes(docs, V, -1, "revised")) and r.totals().collect() == []
    r.compact()
    assert r.totals().collect() == [] and r.batches() == ["b1", "b2", "b3"]
    with pytest.raises(ValueError):
        r.commit("a/b", changes(docs, V, 1))


def test_failed_batch_leaves_nothing(spark, tmp_path):
    docs = spark.createDataFrame([("x", "s", "en")], "text string, source string, lang string")
    r = Rollup(spark, f"file://{tmp_path}/r")
    with pytest.raises(Exception):
        r.commit("bad", changes(docs, V, 1).selectExpr("source", "lang", "tokenizer_version", "docs", "CAST(raise_error('x') AS BIGINT) AS tokens", "chars"))
    assert r.batches() == [] and r.totals().collect() == []
    assert r.commit("bad", changes(docs, V, 1)) and as_dict(r.totals()) == brute([("x", "s", "en")])


def test_commit_during_compaction(spark, tmp_path):
    docs = spark.createDataFrame([("x y", "s", "en")], "text string, source string, lang string")
    r = Rollup(spark, f"file://{tmp_path}/r")
    r.commit("b1", changes(docs, V, 1))
    whole, once = r._summed, []

    def between(base, deltas):
        if not once:
            once.append(r.commit("b2", changes(docs, V, 1)))
        return whole(base, deltas)

    r._summed = between
    r.compact()
    assert once == [True] and as_dict(r.totals()) == brute([("x y", "s", "en")] * 2) and r.batches() == ["b1", "b2"]
    assert not r.commit("b1", changes(docs, V, 1)) and not r.commit("b2", changes(docs, V, 1))


def test_life_of_documents(spark, documents, tmp_path):
    got = as_dict(maintain(documents, f"file://{tmp_path}/r").totals())
    rows = {(re.sub("[0-9]+", "", r.text), r.source, r.lang) for r in documents.collect()}
    assert got == brute(rows) and Counter(v for _, _, v in got)
    assert maintain(documents.limit(0), f"file://{tmp_path}/e").totals().collect() == []
