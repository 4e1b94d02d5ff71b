"""Corpus statistics: counts, histograms, digests and duplicates.

All of these are plain aggregations with partial (map-side) states, so one huge
project or one very common text costs one partial row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from codestrata.functions import fixed, text
from codestrata.functions.chunks import chunks
from codestrata.operators.filters import is_key_file


def file_stats(files: DataFrame) -> DataFrame:
    if "size" not in files.columns:
        files = files.select("project", F.octet_length("content").cast("bigint").alias("size"))
    return files.groupBy("project").agg(
        F.count("*").alias("total_files"),
        F.sum("size").alias("total_bytes"),
        F.round(F.sum("size") / F.lit(1024.0 * 1024.0), 6).alias("total_size_mb"),
    )


def ext_histogram(files: DataFrame) -> DataFrame:
    return files.groupBy("project", text.extension("path").alias("ext")).agg(F.count("*").alias("n_files"))


def folders(files: DataFrame) -> DataFrame:
    """Distinct folders; parents are made distinct first, then expanded upwards."""
    parents = files.filter(F.instr("path", "/") > 0).select("project", text.dirname("path").alias("dir")).distinct()
    up = text.ancestors(F.concat(F.col("dir"), F.lit("/x")))
    return parents.select("project", F.explode(up).alias("dir")).distinct()


def folder_count(files: DataFrame) -> DataFrame:
    return folders(files).groupBy("project").agg(F.count("*").alias("n_folders"))


def duplicate_contents(files: DataFrame) -> DataFrame:
    return (files.groupBy(text.content_hash("content").alias("content_hash"))
            .agg(F.count("*").alias("n_files"), F.min(F.struct("project", "path")).alias("first"))
            .filter("n_files > 1")
            .select("content_hash", "n_files",
                    F.col("first.project").alias("first_project"), F.col("first.path").alias("first_path")))


def row_digest(*cols: Column | str) -> Column:
    return F.md5(F.concat_ws("\x1f", *[text.col(c).cast("string") for c in cols]).cast("binary"))


def group_digest(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Digest of a set of rows that does not depend on their order.

    Row digests are added up (two 60-bit halves), so no group is ever sorted or
    collected and partial sums combine before the shuffle.
    """
    digest = row_digest(*cols)
    high, low = (F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(20,0)") for start in (1, 17))
    sums = df.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.sum(high).alias("_hi"), F.sum(low).alias("_lo"))
    return sums.select(
        *keys, "n_rows",
        F.md5(F.concat_ws(":", F.col("n_rows").cast("string"), F.col("_hi").cast("string"),
                          F.col("_lo").cast("string")).cast("binary")).alias("digest"))


def chunk_rows(files: DataFrame, max_tokens: int = fixed.CHUNK_TOKENS) -> DataFrame:
    """One row per chunk."""
    return (files.select("project", "path", F.posexplode(chunks("content", max_tokens)).alias("chunk_no", "c"))
            .select("project", "path", "chunk_no", "c.start_line", "c.end_line", "c.tokens", "c.content"))


def chunk_stats(files: DataFrame, max_tokens: int = fixed.CHUNK_TOKENS) -> DataFrame:
    packed = files.select("project", "path", chunks("content", max_tokens).alias("cs"))
    total = F.aggregate("cs", F.lit(0).cast("bigint"), lambda s, c: s + c["tokens"])
    n = F.size("cs")
    label = (F.when(n == 0, F.lit("No chunks"))
             .when(n == 1, F.concat(F.lit("Single chunk: "), total.cast("string"), F.lit(" tokens")))
             .otherwise(F.concat(n.cast("string"), F.lit(" chunks, "), total.cast("string"), F.lit(" total tokens"))))
    return packed.select("project", "path", n.alias("n_chunks"), total.alias("total_tokens"), label.alias("summary"))


def first_chunk(files: DataFrame, max_tokens: int = fixed.CHUNK_TOKENS) -> DataFrame:
    """Text handed to a file summarizer: chunk 0, with a note when there are more."""
    packed = files.select("project", "path", chunks("content", max_tokens).alias("cs")).filter(F.size("cs") > 0)
    note = F.concat(F.lit("\n\n[NOTE: This file has "), F.size("cs").cast("string"),
                    F.lit(" chunks, analyzing first chunk only]"))
    head = F.get("cs", F.lit(0))["content"]
    return packed.select("project", "path", F.size("cs").alias("n_chunks"),
                         F.when(F.size("cs") > 1, F.concat(head, note)).otherwise(head).alias("content"))


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First n rows per key; the rank filter is applied before the shuffle too."""
    from pyspark.sql import Window
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)


def key_files(files: DataFrame, n: int = fixed.KEY_FILE_LIMIT) -> DataFrame:
    hits = files.filter(is_key_file("path")).select("project", "path")
    return top_n(hits, ["project"], [F.col("path")], n)
