"""Session helpers: recommended settings and lineage cuts that survive executor loss."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # plans here are built from many small expressions; skip recording a call site for each
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build(app: str = "codestrata", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and scratch tables of this application.

    It lies in the shared folder that the session names in ``spark.checkpoint.dir``.
    Only a local session that names none, as in tests, gets a folder of its own.
    """
    sc = spark.sparkContext
    if not hasattr(sc, "_codestrata_scratch"):
        named = sc._conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="codestrata-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc._codestrata_scratch = f"{named.rstrip('/')}/codestrata-{sc.applicationId}-{uuid.uuid4().hex[:8]}"
        atexit.register(_forget, sc)
    return sc._codestrata_scratch


def _forget(sc) -> None:
    """Scratch tables go with the application that made them."""
    if sc._jsc is not None:
        with contextlib.suppress(Exception):  # the context may be ending
            _delete(sc, sc._codestrata_scratch)


def _delete(sc, path: str) -> None:
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


@contextlib.contextmanager
def short_lived_shuffles(spark: SparkSession):
    """Shuffle files of the writes made inside go as soon as each write ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute a result once: write it as a table in the shared folder and read it back.

    The copy survives lost executors, keeps column pruning and carries its size,
    so that later joins still choose their strategy by size. ``release`` removes it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    with short_lived_shuffles(spark):
        df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._codestrata_path = path
    return kept


def release(*tables: DataFrame) -> None:
    """Remove tables made by ``cut_lineage`` that nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession.sparkContext, table._codestrata_path)


def size_in_bytes(df: DataFrame) -> int:
    """Size the optimizer expects; exact for written tables, large when it cannot tell."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
