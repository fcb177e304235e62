"""A training corpus from raw documents in five stages, each an operator of
``almagest.llm`` and each working on all that its predecessor kept. A stage's
result is written as Parquet and read again as the next one's documents.

The quality classifier needs learned weights, suffix de-duplication a hash of
bytes that SQL functions do not give, and packing a tokenizer, so there is no
SQL for the whole; the tests hold every stage against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from almagest.llm import mixing, packing, quality, simhash, suffix_dedup
from almagest.llm.common import written
from almagest.sources.tables import read


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    return quality.keep_good(spark, docs, read(spark, sf_dir, "labels"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(spark, docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur elsewhere."""
    return suffix_dedup.remove_repeats(spark, docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixing.mix(spark, docs)


def packing_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents packed into sequences, in training order."""
    return packing.pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"), order=mixing.written_order())


STAGES = [("quality_classifier", quality_classifier), ("simhash_dedup", simhash_dedup),
          ("suffix_array_dedup", suffix_array_dedup), ("mixing_sources", mixing_sources),
          ("packing_sequences", packing_sequences)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), name)
    return docs
