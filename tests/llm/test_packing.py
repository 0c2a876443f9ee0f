import zlib
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import lexicon
from tessera.llm.packing import best_fit, pack, plan


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(lexicon.tokenizer_path())


def verify(rows, texts, tokenizer, capacity):
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
    assert set(got) == set(texts)
    for d, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want = [(k, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes())) for k, at in enumerate(range(0, len(ids), capacity))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got[d]) == want
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for places in seqs.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seqs)


@pytest.mark.parametrize("capacity", [2048, 300])
def test_round_trip(spark, documents, tokenizer, capacity):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = pack(documents, capacity=capacity).collect()
    n = verify(rows, texts, tokenizer, capacity)
    assert n <= 1.02 * sum(r.length for r in rows) / capacity + 2


ODD = [
    None, "", " \n", "a", "It's THE end.", "don't've 'stop. x'", "café. naïve, Ü! é. …. ×.", "12.5, a1b2. <|endoftext|> <|ENDOFTEXT|>.",
    "中文。 Жизнь. ΣΣΣ. İı", "a b. c d", "x\x01y . .. ...", "word. " * 5000, "z" * 3000, "\U0001f600\U0001f600!", "tab\tsep\x0bvt\x0cff\rcr\x1cfs",
]


def test_odd_texts(spark, tokenizer):
    texts = dict(enumerate(ODD))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "'x' AS length", "1 AS piece", "2 AS _salt")
    verify(pack(docs).collect(), texts, tokenizer, 2048)


def test_repeated_null_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "b c"), (3, "d"), (3, "d")], "doc_id long, text string")
    rows = pack(docs).collect()
    assert len(rows) == 4 and len({r.sequence_id for r in rows}) == 1 and sorted(r.offset for r in rows)[0] == 0
    assert pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_plan_holds_all_pieces():
    rng = np.random.default_rng(1)
    for scale in (0.2, 3, 400):
        counts = np.zeros(2049, np.int64)
        counts[1:] = rng.poisson(scale * np.exp(-np.arange(2048) / 500) + 0.01)
        counts[2048] = 7
        got = np.zeros(2049, np.int64)
        for lengths, n in plan(counts):
            assert n > 0 and sum(lengths) <= 2048
            for v in lengths:
                got[v] += n
        assert (got == counts).all()
        total = int((counts * np.arange(2049)).sum())
        assert sum(n for _, n in plan(counts)) <= 1.01 * total / 2048 + 2
    assert best_fit(np.zeros(10, np.int64)) == []


def test_token_counts(spark, documents, tokenizer, tmp_path):
    docs = documents.limit(40)
    for r in lexicon.token_counts(docs, "text", lexicon.tokenizer_path(), f"file://{tmp_path}/lex").collect():
        assert r.n_tokens == len(tokenizer.encode(r.text, add_special_tokens=False).ids)
