"""Incremental analysis of changed files, and a callback for progress.

Batches write under their batch number, so a replayed batch lands in the same
place and the results do not depend on how often it ran.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from codestrata.operators import summaries
from codestrata.session import cut_lineage, exists
from codestrata.sources import cache


# --- changed files -----------------------------------------------------------------

def analyze_batch(files: DataFrame, cache_path: str, now=None, summarize: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Summarize the files of a batch whose content is not in the cache; append them to it."""
    spark = files.sparkSession
    now = F.current_timestamp() if now is None else now
    keyed = files.withColumn("key", F.concat_ws("/", "project", "path"))
    stored = spark.createDataFrame([], cache.CACHE) if not exists(spark, cache_path) else spark.read.schema(cache.CACHE).parquet(cache_path)
    todo = cut_lineage(cache.cache_todo(keyed, stored, now))
    made = (summarize or summaries.summarize_files)(todo.select("project", "path", "content"))
    hashes = todo.select("project", "path", "key", "content_hash")
    rows = made.join(hashes, ["project", "path"]).select(
        "key", "content_hash", now.cast("timestamp").alias("ts"), F.to_json(F.struct(*made.columns)).alias("result"))
    cache.cache_write(rows, cache_path, "file")
    return rows


def analyze_incremental(files_stream: DataFrame, cache_path: str, checkpoint: str, now=None,
                        summarize: Callable[[DataFrame], DataFrame] | None = None, **trigger) -> StreamingQuery:
    """Only new or changed contents are processed; rows stored twice by a replay count once."""
    def handle(batch: DataFrame, _: int) -> None:
        analyze_batch(batch, cache_path, now, summarize)

    writer = files_stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


# --- progress callback ----------------------------------------------------------------

class ProgressCallback(StreamingQueryListener):
    """Calls ``fn(name, batch, input_rows)`` after every micro-batch."""

    def __init__(self, fn: Callable[[str, int, int], None]):
        self.fn = fn

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.fn(p.name, p.batchId, p.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def on_progress(spark: SparkSession, fn: Callable[[str, int, int], None]) -> ProgressCallback:
    listener = ProgressCallback(fn)
    spark.streams.addListener(listener)
    return listener
