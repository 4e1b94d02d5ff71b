"""Result cache: append-only parquet, one row per stored result, latest row wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from codestrata.functions import fixed, text
from codestrata.session import cut_lineage, size_in_bytes

CACHE = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("content_hash", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("result", T.StringType()),
])

# Stored entries of the earlier file-per-entry layout.
STORED_ENTRY = T.StructType([
    T.StructField("content_hash", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("result", T.StructType([
        T.StructField("language", T.StringType()),
        T.StructField("purpose", T.StringType()),
        T.StructField("key_types", T.ArrayType(T.StringType())),
        T.StructField("functions", T.ArrayType(T.StringType())),
        T.StructField("imports", T.ArrayType(T.StringType())),
        T.StructField("side_effects", T.ArrayType(T.StringType())),
        T.StructField("risks", T.ArrayType(T.StringType())),
        T.StructField("complexity", T.StringType()),
    ])),
])


def cache_write(df: DataFrame, path: str, kind: str) -> None:
    """Append ``(key, content_hash, ts, result)`` rows of one kind."""
    rows = df.select(F.lit(kind).alias("kind"), "key", "content_hash", "ts", "result")
    rows.write.mode("append").partitionBy("kind").parquet(path)


def cache_read(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Latest row per (kind, key); the kind filter prunes partitions."""
    rows = spark.read.schema(CACHE).parquet(path)
    if kind is not None:
        rows = rows.filter(F.col("kind") == kind)
    return latest(rows)


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Time and hash of the latest row of each key; results are neither read nor moved."""
    return rows.groupBy(*keys).agg(F.max(F.struct("ts", "content_hash")).alias("c")).select(*keys, "c.content_hash", "c.ts")


def latest(rows: DataFrame) -> DataFrame:
    """Latest row per (kind, key). Of rows with one time and hash, the largest result counts."""
    newest = _newest(rows, ["kind", "key"])
    return rows.join(newest, ["kind", "key", "content_hash", "ts"], "left_semi").groupBy("kind", "key", "content_hash", "ts").agg(
        F.max("result").alias("result")).select("kind", "key", "content_hash", "ts", "result")


def _valid_keys(cache: DataFrame, now: Column, kind: str, ttl_hours: int) -> DataFrame:
    """(key, content_hash, ts) of entries that are not too old."""
    return _newest(cache.filter(F.col("kind") == kind), ["key"]).filter(~text.is_expired("ts", now, ttl_hours))


def cache_hits(files: DataFrame, cache: DataFrame, now: Column, kind: str = "file",
               ttl_hours: int = fixed.CACHE_TTL_HOURS) -> DataFrame:
    """Stored results of files (with a ``key`` column) whose content has not changed."""
    hashed = files.withColumn("content_hash", text.content_hash("content")).drop("content")
    hits = hashed.join(_valid_keys(cache, now, kind, ttl_hours), ["key", "content_hash"])
    # only now the results of those keys are fetched
    stored = cache.filter(F.col("kind") == kind).select("key", "content_hash", "ts", "result")
    wanted = hits.select("key", "content_hash", "ts").distinct()
    results = stored.join(wanted, ["key", "content_hash", "ts"], "left_semi").groupBy("key", "content_hash", "ts").agg(F.max("result").alias("result"))
    return hits.join(results, ["key", "content_hash", "ts"]).drop("ts")


def cache_todo(files: DataFrame, cache: DataFrame, now: Column, kind: str = "file",
               ttl_hours: int = fixed.CACHE_TTL_HOURS, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Files without a valid result: other content, no entry, or an entry too old.

    Contents are hashed where they are read and only (key, hash) pairs meet the
    cache.  The missing keys, usually few, are written, so their size is known:
    up to ``broadcast_bytes`` they go to the files, beyond it both sides shuffle on
    the key, which is unique.
    """
    hashed = files.withColumn("content_hash", text.content_hash("content"))
    pairs = hashed.select("key", "content_hash")
    missing = cut_lineage(pairs.join(_valid_keys(cache, now, kind, ttl_hours).drop("ts"), ["key", "content_hash"], "left_anti"))
    keys = missing.select("key")
    if size_in_bytes(missing) <= broadcast_bytes:
        keys = F.broadcast(keys)
    return hashed.join(keys, "key", "left_semi")


def split_by_cache(files: DataFrame, cache: DataFrame, now: Column, kind: str = "file",
                   ttl_hours: int = fixed.CACHE_TTL_HOURS) -> tuple[DataFrame, DataFrame]:
    """(hits with their result, files still to do)."""
    return cache_hits(files, cache, now, kind, ttl_hours), cache_todo(files, cache, now, kind, ttl_hours)


def read_cache_json(spark: SparkSession, folder: str) -> DataFrame:
    """Stored file summaries: one JSON document per file."""
    rows = (spark.read.schema(STORED_ENTRY).option("multiLine", "true").option("pathGlobFilter", "*_file_*.json")
            .json(folder).withColumn("source", F.input_file_name()))
    return rows.select(
        F.regexp_extract("source", r"([^/]+)_file_[0-9a-f]{8}\.json$", 1).alias("name"),
        "content_hash", F.to_timestamp("timestamp").alias("ts"),
        F.lower("result.language").alias("language"), "result.purpose", "result.key_types", "result.complexity")
