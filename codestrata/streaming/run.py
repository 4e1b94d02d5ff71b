"""Run a streaming query over what is available and read its result back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from codestrata.session import shared_dir


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process all available input, then return the sink's rows.

    Append streams go to parquet files in the shared folder.  Complete and update
    streams go through ``foreachBatch``: every batch overwrites (complete) or is
    added (update) under its batch number, so a replayed batch writes the same
    place again.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out, checkpoint = f"{base}/out", f"{base}/checkpoint"
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", out).start()
    else:
        def put(batch: DataFrame, number: int) -> None:
            part = "0" if mode == "complete" else str(number)
            batch.write.mode("overwrite").parquet(f"{out}/batch={part}")
        query = writer.outputMode(mode).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.parquet(out).select(*stream.columns)
