"""Sinks: result documents, fact tables and the service graph store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codestrata.functions import fixed

GRAPH_BUCKETS = 64


def write_results(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON document per row."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(path)


def write_facts(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """Fact tables side by side; nested lists stay rows instead of one large document."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path}/{name}")


def _bucket(project: Column) -> Column:
    return F.pmod(F.xxhash64(project), F.lit(GRAPH_BUCKETS)).cast("int")


def save_graph(edges: DataFrame, path: str, generated_at: Column) -> None:
    """Append a generation of edges.

    Partitions are hash buckets of the project: their number stays fixed however
    many projects there are, and a load still prunes to one of them.
    """
    (edges.withColumn("generated_at", generated_at).withColumn("bucket", _bucket(F.col("project")))
     .write.mode("append").partitionBy("bucket").parquet(path))


def load_graph(spark: SparkSession, path: str, project: str, now: Column,
               max_age_hours: int = fixed.GRAPH_TTL_HOURS) -> DataFrame:
    """Newest generation of a project's edges, unless it is too old."""
    rows = spark.read.parquet(path).filter((F.col("bucket") == _bucket(F.lit(project))) & (F.col("project") == project))
    fresh = rows.filter(F.col("generated_at") >= now - F.expr(f"INTERVAL '{int(max_age_hours)}' HOUR"))
    newest = fresh.groupBy("project").agg(F.max("generated_at").alias("generated_at"))
    return fresh.join(newest, ["project", "generated_at"], "left_semi").drop("bucket")
