"""Sources and sinks as queries: write, read back, and compare with what was written."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codestrata.functions import text
from codestrata.operators import ddl, discovery, edges
from codestrata.operators.filters import migration_files
from codestrata.plans.registry import ORACLES, query
from codestrata.plans.services import _edges
from codestrata.plans import summary as _summary  # noqa: F401  its macros are used here
from codestrata.session import shared_dir
from codestrata.sources import cache, files as sources, sinks, views
from codestrata.streaming.incremental import analyze_batch
from codestrata.streaming.run import drain
from codestrata.streaming.schema_state import split_errors, with_reason

_DAY = "TIMESTAMP '2024-01-0{} 00:00:00'"


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


@query("scan_roundtrip", """
SELECT 'project=' || source AS project, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, CAST(sum(len(text) + 1) AS BIGINT) AS chars
FROM documents GROUP BY 1""")
def q_scan(spark, sf):
    """Texts written as files, one folder for each source, and scanned again."""
    root = _folder(spark)
    views.corpus(spark, sf).select("project", "content").write.partitionBy("project").text(root)
    return sources.scan_files(spark, root, glob="*.txt").groupBy("project").agg(
        F.sum("size").alias("bytes"), F.sum(F.length("content")).cast("bigint").alias("chars"))


@query("cache_roundtrip", """WITH $CORPUS
SELECT path AS key, md5(content) AS content_hash, CASE WHEN md5(path) < '8' THEN 'second' ELSE 'first' END AS result FROM files""")
def q_cache(spark, sf):
    """Two generations of results of one kind and a row of another; the latest counts."""
    path, rows = _folder(spark), views.corpus(spark, sf).select(F.col("path").alias("key"), text.content_hash("content").alias("content_hash"))
    first = rows.withColumns({"ts": F.expr(_DAY.format(1)).cast("timestamp"), "result": F.lit("first")})
    second = rows.filter(F.md5(F.col("key").cast("binary")) < "8").withColumns(
        {"ts": F.expr(_DAY.format(2)).cast("timestamp"), "result": F.lit("second")})
    cache.cache_write(first, path, "file")
    cache.cache_write(second, path, "file")
    cache.cache_write(first.limit(1), path, "folder")
    return cache.cache_read(spark, path, "file").select("key", "content_hash", "result")


@query("results_roundtrip", "WITH $REPOS SELECT project, path, size FROM facts")
def q_results(spark, sf):
    """Rows as JSON documents and back."""
    path = _folder(spark)
    rows = views.repos(spark, sf).select("project", "path", F.octet_length("content").cast("bigint").alias("size"))
    sinks.write_results(rows, path)
    return spark.read.text(path).select(text.json_decode("value", rows.schema).alias("r")).select("r.*")


@query("graph_roundtrip", """WITH $REPOS, $EDGES
SELECT project, "from", "to", evidence_type FROM best WHERE project = 'hub'""")
def q_graph(spark, sf):
    """Two generations of the service graph; the newer one of a project is loaded."""
    path, best = _folder(spark), edges.dedup_edges(_edges(spark, sf)[1])
    sinks.save_graph(best.limit(1), path, F.expr(_DAY.format(1)))
    sinks.save_graph(best, path, F.expr(_DAY.format(2)))
    return sinks.load_graph(spark, path, "hub", F.expr(_DAY.format(2))).select("project", "from", "to", "evidence_type")


@query("progress_files", """WITH $PROGRESS SELECT run_id, seq, type, stage, progress FROM progress""")
def q_progress(spark, sf):
    """Progress events written as JSON files and read as a stream."""
    path = _folder(spark)
    views.progress(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")).write.json(path)
    return drain(sources.read_progress_stream(spark, path)).select("run_id", "seq", "type", "stage", "progress")


@query("svc_ordered", ORACLES["svc_candidates"])
def q_ordered(spark, sf):
    return discovery.order_candidates(discovery.service_candidates(views.repos(spark, sf)))


@query("incremental_batches", """WITH $CORPUS, $SUMMARIES
SELECT project || '/' || path AS key, purpose, tokens FROM fsum""")
def q_incremental(spark, sf):
    """Files come in two overlapping batches; each content is summarized once and stored in the cache."""
    path, now = _folder(spark), F.expr(_DAY.format(3)).cast("timestamp")
    files = views.corpus(spark, sf)
    analyze_batch(files.filter(F.md5(F.col("path").cast("binary")) < "a"), path, now)
    analyze_batch(files.filter(F.md5(F.col("path").cast("binary")) >= "6"), path, now)
    stored = cache.cache_read(spark, path, "file")
    return stored.select("key", F.get_json_object("result", "$.purpose").alias("purpose"),
                         F.get_json_object("result", "$.tokens").cast("int").alias("tokens"))


@query("split_errors", """WITH $REPOS, $DDL
SELECT project, path, stmt_no FROM stm WHERE type IS NULL
UNION ALL SELECT n.project, n.path, n.stmt_no FROM named n JOIN badcreate b ON b.project = n.project AND b.seq = n.seq""")
def q_errors(spark, sf):
    return split_errors(with_reason(ddl.statements(migration_files(views.repos(spark, sf)))))[1].select("project", "path", "stmt_no")
