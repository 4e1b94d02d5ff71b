"""File sources: folder trees and tables as ``files(project, path, content, size)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from codestrata.functions import text

PROGRESS = T.StructType([
    T.StructField("run_id", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("type", T.StringType()),
    T.StructField("stage", T.StringType()),
    T.StructField("progress", T.IntegerType()),
    T.StructField("message", T.StringType()),
])

FILES = T.StructType([
    T.StructField("project", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("content", T.StringType()),
])


def scan_files(spark: SparkSession, root: str, project: str | None = None, glob: str | None = None,
               max_bytes: int | None = None) -> DataFrame:
    """Recursive scan of a folder tree; folders yield no row, unreadable files are skipped.

    Without ``project`` the first folder under the root names the project.  The
    size limit is pushed into the source, so larger files are never read, and the
    content column is only read by plans that use it.
    """
    reader = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
              .option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true"))
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.load(root)
    if max_bytes is not None:
        raw = raw.filter(F.col("length") <= max_bytes)
    base = root.split("://", 1)[-1].split(":", 1)[-1].rstrip("/")
    plain = F.regexp_replace("path", r"^[a-zA-Z0-9]+:/+", "/")
    relative = text.relative_path(plain, F.lit("/" + base.lstrip("/")))
    files = raw.select(relative.alias("rel"), F.col("length").alias("size"), F.col("content").alias("bytes"))
    if project is not None:
        return with_content(files.select(F.lit(project).alias("project"), F.col("rel").alias("path"), "size", "bytes"))
    nested = files.filter(F.instr("rel", "/") > 0)
    return with_content(nested.select(
        text.first_segment("rel").alias("project"),
        F.regexp_replace("rel", r"^[^/]*/", "").alias("path"), "size", "bytes"))


def with_content(files: DataFrame) -> DataFrame:
    """Decode ``bytes`` as UTF-8; malformed sequences become replacement characters."""
    return files.withColumn("content", F.make_valid_utf8(F.col("bytes").cast("string"))).drop("bytes")


def read_progress_stream(spark: SparkSession, folder: str, fmt: str = "json", max_files: int | None = None) -> DataFrame:
    """Progress events as a stream of files in a folder."""
    reader = spark.readStream.schema(PROGRESS)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.format(fmt).load(folder)


def read_files_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Files table (parquet) as a stream."""
    reader = spark.readStream.schema(FILES)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)
