import itertools
import re
from collections import Counter

import pytest

import corpus_pipeline
from tessera.llm import toxicity

from .test_mixing import check
from .test_near_dedup import brute
from .test_packing import verify


@pytest.fixture(scope="module")
def outputs(spark, sf, tmp_path_factory):
    path = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], sf).write.parquet(f"{path}/{i}")
        out.append(spark.read.parquet(f"{path}/{i}"))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark, sf, outputs, words):
    docs, clean, thin, masked, mixed, packed = outputs
    assert all(x.schema.names == docs.schema.names for x in outputs[:-1])
    before, after = rows(docs), rows(clean)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    ids = list(before)
    want = {d for d, p in zip(ids, model.score([before[d].text for d in ids])) if p < 0.7}
    assert set(after) == want and all(after[d] == before[d] for d in after)
    kept = {d for d, _, _, k in brute([(d, r.text) for d, r in after.items()], words, 5, 80) if k}
    assert set(rows(thin)) == kept and all(r == after[d] for d, r in rows(thin).items())
    pattern = re.compile(r'AKIA[A-Z0-9]{16}|(?<=password=)[0-9a-f]{18}|(?<=token = ")[0-9a-f]{40}', re.I)
    hidden = rows(masked)
    assert {d: r.text for d, r in hidden.items()} == {d: pattern.sub("[SECRET]", r.text) for d, r in rows(thin).items()}
    copies = Counter(r.doc_id for r in mixed.collect())

    class Row:
        def __init__(self, r, copies, sizes, targets):
            self.text, self.source, self.size, self.copies = r.text, r.source, len(words(r.text)), copies
            self.taken, self.source_size, self.target = self.size * copies, sizes[r.source], targets[r.source]

    from .test_mixing import water

    sizes = Counter()
    for r in hidden.values():
        sizes[r.source] += len(words(r.text))
    targets = water(sizes)
    check([Row(r, copies[d], sizes, targets) for d, r in hidden.items()], words)
    got = packed.collect()
    assert Counter(r.doc_id for r in got if r.piece == 0) == copies
    from tokenizers import Tokenizer

    from tessera.llm.lexicon import tokenizer_path

    first = {}
    for r in sorted(got, key=lambda r: r.sequence_id):
        first.setdefault((r.doc_id, r.piece), r)
    t = Tokenizer.from_file(tokenizer_path())
    for (d, piece), r in itertools.islice(first.items(), 50):
        n = len(t.encode(hidden[d].text, add_special_tokens=False).ids) + 1
        assert r.length == min(2048, n - 2048 * piece)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    assert verify and len(seqs) <= sum(r.length for r in got) / 2048 * 1.02 + 2


def test_run(spark, sf, outputs):
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == Counter(r.doc_id for r in outputs[-1].collect())


def test_odd_rows(spark, sf):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (2, "", None, "s", 0), (3, "the of " * 20000, "en", None, 1), (4, "a B c", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    for rows_ in (docs, docs.limit(0)):
        out = rows_
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, sf)
            assert name == "pack" or out.columns == docs.columns
        out.collect()


def test_rows_that_share_an_id_or_have_none(spark, sf):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(1, a, 5), (1, b, 5), (None, a, 6), (None, "x y", 6), (2, b, 7), (2, b, 7), (3, "", 8), (3, "", 8), (4, None, 9)], "doc_id long, text string, _key int")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, a, 5), (1, b, 5), (None, "x y", 6), (3, "", 8), (3, "", 8), (4, None, 9)], key=str)


def test_clashing_columns(spark, sf):
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 5, 1, 2, 3, 4, 5, 6)], "doc_id long, text string, lang string, source string, n_chars long, score int, size int, target int, _found int, _key int, row int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    assert [tuple(r)[5:] for r in docs.distinct().collect()] in ([(1, 2, 3, 4, 5, 6)], [])
    assert docs.columns[5:] == ["score", "size", "target", "_found", "_key", "row"]
