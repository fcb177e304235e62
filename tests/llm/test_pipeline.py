"""The corpus pipeline, stage by stage, against brute-force versions."""

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from almagest.llm import mixing, quality
from almagest.sources.tables import read

from .test_dedup import brute_components, brute_fingerprint

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = read(spark, sf_dir, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.written(spark, stage(spark, docs, sf_dir), name)
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_return_columns_of_documents(stages):
    assert [n for n, *_ in stages] == [n for n, _ in corpus_pipeline.STAGES]
    assert all(after.columns == DOCUMENTS for _, _, after in stages[:-1])


def test_quality_stage(stages, spark, sf_dir):
    _, docs, after = stages[0]
    want = {r.doc_id for r in quality.judge(spark, docs, read(spark, sf_dir, "labels")).collect() if r.kept}
    assert {r.doc_id for r in after.collect()} == want
    label = {r.doc_id: r for r in read(spark, sf_dir, "labels").collect()}
    clean = [d for d, r in label.items() if r.quality == 1 and r.toxic == 0]
    assert np.mean([d in want for d in clean]) > 0.98


def test_simhash_stage(stages):
    _, docs, after = stages[1]
    rows = docs.collect()
    comp = brute_components([brute_fingerprint(r.text) for r in rows], [r.doc_id for r in rows], 2)
    assert {r.doc_id for r in after.collect()} == set(comp) and after.count() == len(set(comp))


def test_suffix_stage(stages):
    _, docs, after = stages[2]
    rows = {r.doc_id: r.text.encode() for r in docs.collect()}
    seen = Counter(hash(b[i:i + 400]) for b in rows.values() for i in range(len(b) - 399))
    for r in after.collect():
        b = rows[r.doc_id]
        mark = bytearray(len(b))
        for i in range(len(b) - 399):
            if seen[hash(b[i:i + 400])] > 1:
                mark[i:i + 400] = b"\1" * 400
        assert r.text == bytes(c for c, m in zip(b, mark) if not m).decode("utf-8", "ignore") and r.n_chars == len(r.text)


def test_mixing_stage(stages, spark):
    _, docs, after = stages[3]
    want = Counter({r.doc_id: len(r.positions) for r in mixing.plan(spark, docs).collect()})
    assert Counter(r.doc_id for r in after.collect()) == +want


def test_packing_stage(stages):
    _, docs, after = stages[4]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sum(len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.collect())
    fill = Counter()
    for r in after.collect():
        fill[r.sequence_id] += r.length
    assert sum(fill.values()) == want and max(fill.values()) <= 4096


def test_run_is_the_chain(stages, spark, sf_dir):
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    key = lambda df: Counter(tuple(r) for r in df.select(cols).collect())
    assert key(corpus_pipeline.run(spark, sf_dir)) == key(stages[-1][2])
