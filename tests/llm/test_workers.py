"""What tasks leave in a Python worker that other tasks use after them."""

import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame

from almagest.llm import packing, quality, simhash, suffix_dedup

from .helpers import docs_of, prose

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def held_mb():
    with open("/proc/self/smaps_rollup") as f:
        return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", f.read()))) / 1024


@pytest.fixture
def first_task(spark, monkeypatch):
    """The function that the first task of a query runs."""
    def of(query):
        class Found(Exception):
            pass

        def caught(self, run, *_, **__):
            raise Found(run)

        with monkeypatch.context() as m:
            m.setattr(type(docs), "mapInArrow", caught)
            with pytest.raises(Found) as e:
                query(docs)
        return e.value.args[0]

    docs: DataFrame = docs_of(spark, [(1, "some words")])
    return of


def queries(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    return {"quality": lambda docs: quality.features(spark, docs, labels),
            "simhash": lambda docs: simhash.fingerprints(docs),
            "suffix_dedup": lambda docs: suffix_dedup.repeated_spans(spark, docs),
            "packing": lambda docs: packing.pack(spark, docs, TOKENIZER)}


@pytest.mark.parametrize("name", ["quality", "simhash", "suffix_dedup", "packing"])
def test_a_task_gives_its_memory_back(name, spark, first_task):
    run = first_task(queries(spark)[name])
    text = prose(1, 800, 3_000)

    def batches(n):
        for _ in range(2):
            ids = pa.array(np.arange(n))
            yield pa.RecordBatch.from_arrays([ids, ids, ids, pa.array([text] * n)], names=["doc_id", "k1", "k2", "text"])

    for _ in run(batches(20)):  # modules, tokenizer, words
        pass
    pa.default_memory_pool().release_unused()
    before = held_mb()
    for _ in run(batches(10_000)):
        pass
    assert held_mb() - before < 30


def test_other_operators_tasks_drop_the_table_of_words(spark, first_task):
    packed, marked = first_task(queries(spark)["packing"]), first_task(queries(spark)["simhash"])
    ids = pa.array([1])
    batch = pa.RecordBatch.from_arrays([ids, ids, ids, pa.array(["lorem ipsum"])], names=["doc_id", "k1", "k2", "text"])
    want = [b.to_pydict() for b in packed(iter([batch]))]
    table = packing.word_ids(TOKENIZER, packing.END_ID)
    assert "lorem" in table.code
    list(packed(iter([batch])))
    assert packing.word_ids(TOKENIZER, packing.END_ID) is table
    list(marked(iter([batch])))
    assert "lorem" not in packing.word_ids(TOKENIZER, packing.END_ID).code
    assert [b.to_pydict() for b in packed(iter([batch]))] == want
