"""Connected components of a graph that is only ever held as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import attach
from codestrata.session import cut_lineage, release


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of any sortable type to ``(node, component)``; the component is its smallest node.

    Alternates large-star and small-star steps: every node links its larger, then its
    smaller neighbours to the smallest one it knows. The number of steps grows with the
    logarithm of the longest path. Each step is a minimum for each node and a join back;
    a node with many neighbours is handled by ``attach``. Self-links are ignored, repeated
    links count once, a node without links is not returned.
    """
    now = cut_lineage(_both(edges.filter("a <> b")).filter("a > b").distinct())
    state = _state(now)
    while state[0]:
        large = cut_lineage(_star(_both(now), larger=True))
        small = cut_lineage(_star(large.select("a", "b"), larger=False))
        release(now, large)
        now, before, state = small, state, _state(small)
        if state == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Large star: edges hold both directions. Small star: ``a > b`` in every edge."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("_n"))
    total = edges.count()
    least = least.withColumn("least", F.least("least", "a"))
    linked = attach(edges, least, "a", "_n", total, F.col("b"))
    if larger:
        out = linked.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("least").alias("b")).union(
            least.select("a", F.col("least").alias("b")))
    return out.filter("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
