"""From raw documents to token ids: language ID, exact and near dedup, decontamination, encoding.

Every stage works on all that the one before kept, written as a table in between. All but
the last return the columns of ``documents``. No SQL can express the language model, the
fingerprints or the tokenizer, so ``ORACLE_SQL`` is None; ``tests/llm`` compares the
whole run with plain loops.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from codestrata.llm import bpe, decontaminate, exact_dedup, langid, simhash
from codestrata.session import cut_lineage, release

ORACLE_SQL = None


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the language model, trained on these documents, rejects."""
    return langid.keep_known(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first of equal texts."""
    return exact_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each SimHash component."""
    return simhash.keep_one(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that an item of the benchmark contaminates."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the token ids of each text, and digest of what they decode to."""
    return bpe.op3(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", known_languages),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("decontamination", benchmark_free),
    ("BPE", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, over ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
        if before is not None:
            release(before)
        before = docs
    return docs
