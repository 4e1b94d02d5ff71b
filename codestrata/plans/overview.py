"""Whole-project analysis: every fact table from one scan, and the overview row per project."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from codestrata.operators import config, ddl, detection, discovery, edges, stats, summaries
from codestrata.operators.scan import scan
from codestrata.plans import config as _config  # noqa: F401  its query is the check of intake_config
from codestrata.plans.corpus import crawl
from codestrata.plans.registry import ORACLES, query
from codestrata.session import cut_lineage
from codestrata.sources import views


@dataclass
class Analysis:
    """Fact tables of many projects."""

    stats: DataFrame
    types: DataFrame
    services: DataFrame
    edges: DataFrame
    schema: ddl.Schema
    config_totals: DataFrame
    languages: DataFrame
    files: DataFrame


def analyze(files: DataFrame, intake: DataFrame | None = None) -> Analysis:
    """All fact tables; file contents are read once, by the scan.

    ``files`` are the raw files: types, services, edges, migrations and configuration are
    found in them, as ``.env`` files, Makefiles and manifests must be seen unredacted.
    ``intake`` is what ``corpus.crawl`` keeps of them; sizes and languages are those of the
    intake, or of all files if there is none.
    """
    scanned = cut_lineage(scan(files))
    kept = scanned
    if intake is not None:
        kept = cut_lineage(intake.select("project", "path", F.octet_length("content").cast("bigint").alias("size")))
    services = cut_lineage(discovery.discover_services(scanned))
    languages = (kept.groupBy("project", summaries.language_of("path").alias("language"))
                 .agg(F.count("*").alias("n_files")))
    return Analysis(
        stats=stats.file_stats(kept), types=detection.project_type(scanned), services=services,
        edges=edges.dedup_edges(edges.service_edges(scanned, services)),
        schema=ddl.Schema(scanned, persist=True), config_totals=config.config_totals(scanned),
        languages=languages, files=scanned)


def overview(a: Analysis) -> DataFrame:
    """Dashboard counts per project.

    Edges count from the second service on; tables only for projects with a
    backend, as the phases of an analysis are conditional.
    """
    count = lambda df, name: df.groupBy("project").agg(F.count("*").alias(name))
    columns = a.schema.annotated().groupBy("project").agg(
        F.count("*").alias("n_columns"), F.count_if("is_fk").alias("n_references"))
    langs = a.languages.groupBy("project").agg(
        F.count("*").alias("n_languages"), F.min_by("language", F.struct(-F.col("n_files"), F.col("language"))).alias("primary_language"))
    out = a.stats.select("project", "total_files", "total_bytes").join(
        a.types.select("project", "primary_type", "confidence"), "project")
    for part in (count(a.services, "n_services"), count(a.edges, "n_edges"), count(a.schema.tables, "n_tables"), columns,
                 a.config_totals.select("project", "total_variables", "required_count"), langs):
        out = out.join(part, "project", "left")
    out = out.na.fill(0).na.fill({"primary_language": ""})
    backend = F.col("primary_type").isin("Backend", "Fullstack")
    when_backend = {c: F.when(backend, F.col(c)).otherwise(F.lit(0)) for c in ("n_tables", "n_columns", "n_references")}
    return out.withColumns({
        **when_backend,
        "n_edges": F.when(F.col("n_services") > 1, F.col("n_edges")).otherwise(F.lit(0)),
        "confidence_percent": F.round(F.col("confidence") * 10).cast("int"),
        "architecture": F.when(F.col("n_services") > 1, "microservices").otherwise("monolith"),
        "is_incomplete": is_incomplete()})


def is_incomplete():
    """No project info, no files and no languages."""
    return ((F.col("primary_type") == "") & (F.col("total_files") == 0) & (F.col("n_languages") == 0))


_OVERVIEW = """WITH $REPOS, $RULES, $MANIFEST, $STARTUP, $TYPED, $EDGES, $DDL, $CONFIG, $SUMMARIES,
lg AS (SELECT project, CASE ext WHEN '' THEN 'Other' ELSE language END AS language, count(*) AS n FROM (
   SELECT f.project, f.ext, coalesce(s.language, 'Other') AS language FROM facts f LEFT JOIN (SELECT DISTINCT regexp_extract(path, '\\.[^./]*$') AS ext, language FROM fsum) s ON lower(s.ext) = f.ext) x GROUP BY ALL),
o AS (
SELECT t.project, (SELECT count(*) FROM files f WHERE f.project = t.project) AS total_files, (SELECT CAST(sum(size) AS BIGINT) FROM facts f WHERE f.project = t.project) AS total_bytes,
  t.primary_type, t.confidence, (SELECT count(*) FROM services s WHERE s.project = t.project) AS n_services, (SELECT count(*) FROM best b WHERE b.project = t.project) AS n_edges,
  (SELECT count(*) FROM live l WHERE l.project = t.project) AS n_tables, (SELECT count(*) FROM annotated l WHERE l.project = t.project) AS n_columns,
  (SELECT count(*) FROM annotated l WHERE l.project = t.project AND is_fk) AS n_references, c.total_variables, c.required_count,
  (SELECT count(*) FROM lg WHERE lg.project = t.project) AS n_languages, (SELECT first(language ORDER BY n DESC, language) FROM lg WHERE lg.project = t.project) AS primary_language
FROM typed t JOIN ctotals c ON c.project = t.project)
SELECT project, total_files, total_bytes, primary_type, confidence, n_services, CASE WHEN n_services > 1 THEN n_edges ELSE 0 END AS n_edges,
  CASE WHEN primary_type IN ('Backend', 'Fullstack') THEN n_tables ELSE 0 END AS n_tables, CASE WHEN primary_type IN ('Backend', 'Fullstack') THEN n_columns ELSE 0 END AS n_columns,
  CASE WHEN primary_type IN ('Backend', 'Fullstack') THEN n_references ELSE 0 END AS n_references, total_variables, required_count, n_languages, primary_language,
  CAST(round(confidence * 10) AS INTEGER) AS confidence_percent, CASE WHEN n_services > 1 THEN 'microservices' ELSE 'monolith' END AS architecture, false AS is_incomplete FROM o"""


@query("overview", _OVERVIEW)
def q_overview(spark, sf):
    return overview(analyze(views.repos(spark, sf)))


# --- from raw files to facts: intake and analysis as one flow -----------------------------

_INTAKE_OVERVIEW = (_OVERVIEW.replace("$SUMMARIES,", "$SUMMARIES, $IGNORE_CTES, $INTAKE,")
                    .replace("FROM facts f LEFT JOIN", "FROM intake f LEFT JOIN")
                    .replace("(SELECT count(*) FROM files f WHERE f.project = t.project)", "(SELECT count(*) FROM intake f WHERE f.project = t.project)")
                    .replace("CAST(sum(size) AS BIGINT) FROM facts f", "CAST(sum(strlen(redacted)) AS BIGINT) FROM intake f"))


@query("intake_overview", _INTAKE_OVERVIEW)
def q_intake_overview(spark, sf):
    raw = views.repos(spark, sf)
    return overview(analyze(raw, crawl(raw)))


@query("intake_config", ORACLES["config_totals"])
def q_intake_config(spark, sf):
    """Variables that the projects require, from the raw walk, where ``.env`` files are still there."""
    raw = views.repos(spark, sf)
    return analyze(raw, crawl(raw)).config_totals


@query("intake_services", "WITH $REPOS, $EDGES SELECT project, name, path FROM services")
def q_intake_services(spark, sf):
    raw = views.repos(spark, sf)
    return analyze(raw, crawl(raw)).services.select("project", "name", "path")
