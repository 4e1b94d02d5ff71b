"""Helpers shared by the operators: inputs, code shipping, joins that survive hot keys."""

from __future__ import annotations

import contextlib
import math
import re
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.session import cut_lineage

PACKAGE = Path(__file__).resolve().parents[1]

#: A group is hot when it has over one HOT-th of all rows; so there are fewer than HOT such groups.
HOT = 1000

#: Column of the number or name of a row.
ROW = "_row_no"

#: Groups that are broadcast without regard to their size.
SMALL = 500_000

#: Texts are handed to Python functions in slices of so many rows.
SLICE = 128

#: Texts over this many bytes are worked on piece by piece.
LONG = 1 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application."""
    sc = spark.sparkContext
    if hasattr(sc, "_codestrata_llm"):
        return
    folder = tempfile.mkdtemp(prefix="codestrata-code-")  # on the driver; Spark copies the file to the executors
    path = f"{folder}/codestrata_llm.zip"
    with zipfile.ZipFile(path, "w") as out:
        for f in [PACKAGE / "__init__.py", PACKAGE / "session.py", *sorted(Path(__file__).parent.glob("*.py"))]:
            out.write(f, f.relative_to(PACKAGE.parent))
    sc.addPyFile(path)
    sc._codestrata_llm = path
    with contextlib.suppress(Exception):  # a bound on bytes exists since 4.1
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into short ones, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def segments(data: bytes, limit: int = LONG) -> Iterator[bytes]:
    """A long text in pieces that end before white space, so that no word is cut."""
    at = 0
    while len(data) - at > limit:
        cut = _WHITE.search(data, at + limit)
        if not cut:
            break
        yield data[at:cut.start()]
        at = cut.start()
    yield data[at:]


_WHITE = re.compile(rb"[\x20\x09-\x0D]")


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, spread: Column,
           share: int = HOT, n_groups: int | None = None) -> DataFrame:
    """Left join of ``groups`` (one row for each ``key``) to ``rows``, whatever the size of a group.

    If the caller has counted the groups, of a few numbers each, and they are at most ``SMALL``, all are broadcast.

    Groups with over one ``share``-th of all ``total`` rows are fewer than ``share`` and are broadcast.
    Their rows take no part in the shuffled join: they get a salt that no group has,
    made from ``spread``, and so are dealt out evenly.
    """
    facts = [c for c in groups.columns if c != key]
    if n_groups is not None and n_groups <= SMALL:
        few = F.broadcast(groups.withColumnRenamed(key, "_key"))
        return rows.join(few, rows[key] == few["_key"], "left").drop("_key")
    hot = groups.filter(F.col(size) * F.lit(share) > F.lit(total)).select(
        F.col(key).alias("_key"), F.struct(*facts).alias("_hot"))
    rest = groups.select(F.col(key).alias("_key"), F.lit(0).cast("long").alias("_salt"), F.struct(*facts).alias("_rest"))
    left = rows.join(F.broadcast(hot), rows[key] == hot["_key"], "left").drop("_key")
    left = left.withColumn("_salt", F.when(F.col("_hot").isNull(), F.lit(0).cast("long"))
                           .otherwise(F.abs(F.xxhash64(spread) % F.lit(1 << 40)) + 1))
    joined = left.join(rest, (left[key] == rest["_key"]) & (left["_salt"] == rest["_salt"]), "left")
    return joined.select(*[left[c] for c in rows.columns],
                         *[F.coalesce(F.col(f"_hot.{c}"), F.col(f"_rest.{c}")).alias(c) for c in facts])


def parts(rows: int, each: int) -> int:
    """Number of partitions, so that none has more than about ``each`` rows."""
    return max(1, math.ceil(rows / each))


def numbered(docs: DataFrame) -> DataFrame:
    """Documents with a name for each row in the column ``_row_no``: a doc_id may be null or repeat.

    Rows of a Parquet table, read as it is, are named by file and place in it, so no text is copied.
    Others are written once with a number for each. A column of that name is kept aside for ``without``.
    """
    docs = docs.withColumnRenamed(ROW, _ASIDE) if ROW in docs.columns else docs
    placed = _placed(docs)
    return cut_lineage(docs.withColumn(ROW, F.monotonically_increasing_id())) if placed is None else placed


_ASIDE = f"{ROW} of the input"


def _placed(docs: DataFrame) -> DataFrame | None:
    """Rows of a plain Parquet scan with file and place as their name, None for anything else."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation" or "_metadata" in docs.columns:
        return None
    try:
        return docs.withColumn(ROW, F.concat_ws("#", "_metadata.row_index", "_metadata.file_path"))
    except AnalysisException:  # a format without places
        return None


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of ``numbered`` documents whose name is not in ``dropped``, with the columns that the documents had."""
    gone = dropped.select(F.col(ROW).alias("_gone_row"))
    return without_names(docs.join(gone, docs[ROW] == gone["_gone_row"], "left_anti"))


def without_names(rows: DataFrame) -> DataFrame:
    """Columns as they were before ``numbered``."""
    return rows.drop(ROW).withColumnRenamed(_ASIDE, ROW)
