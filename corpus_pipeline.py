"""A training corpus from raw documents: language, quality, near copies,
repeated passages, packing. Each stage takes (spark, docs, sf_dir); the
harness, and ``run``, write its result and read it again for the next one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from flightloom.llm import dart_minhash, language_id, packing, quality_rules, suffix_dedup
from flightloom.llm.common import documents, saved


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, or without a language that has two fifths of their words, go."""
    return language_id.keep_identified(docs, *language_id.trained_on(docs))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return dart_minhash.keep_one(spark, docs)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of some 50 words that repeat are cut out of the texts; every document stays."""
    return suffix_dedup.dedup_rows(spark, docs, suffix_dedup.PASSAGE, suffix_dedup.PASSAGE_GRAM)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences."""
    return packing.pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_stage),
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", passage_stage),
    ("packing", packing_stage),
]

#: Tokenizers, expectation-maximisation and signatures have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(spark, docs, name)
    return docs
