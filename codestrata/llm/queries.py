"""Registered queries of the subpackage, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from codestrata.llm import bpe, decontaminate, divergence, exact_dedup, kd_shards, langid, license_scan, line_dedup, ngram_join, simhash, substring_dedup, token_counts, whitening
from codestrata.llm.common import documents

#: Public vocabularies, as installed on every machine.
BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
COUNTED = public_tokenizers.path("byte_bpe_50k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": lambda spark, sf: exact_dedup.op1(documents(spark, sf)),
    "op2_kd_shards": lambda spark, sf: kd_shards.op2(documents(spark, sf)),
    "op3_byte_bpe": lambda spark, sf: bpe.op3(documents(spark, sf), BPE_RANKS, public_tokenizers.PATTERN),
    "op4_decontaminate": lambda spark, sf: decontaminate.contaminated(
        documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet")),
    "op5_line_dedup": lambda spark, sf: line_dedup.decisions(documents(spark, sf)),
    "op6_language_id": lambda spark, sf: langid.op6(documents(spark, sf)),
    "op7_token_counts": lambda spark, sf: token_counts.op7(documents(spark, sf), COUNTED),
    "op8_substring_dedup": lambda spark, sf: substring_dedup.repeated_spans(documents(spark, sf)),
    "op9_simhash": lambda spark, sf: simhash.op9(documents(spark, sf)),
    "op10_license_scan": lambda spark, sf: license_scan.op10(documents(spark, sf)),
    "op11_divergence": lambda spark, sf: divergence.audit(documents(spark, sf)),
    "op12_ngram_join": lambda spark, sf: ngram_join.op12(documents(spark, sf)),
    "op13_whitening": lambda spark, sf: whitening.op13(spark.read.parquet(f"{sf}/embeddings.parquet")),
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op11_divergence": divergence.ORACLE_SQL,
    "op1_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
                   FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
}
