"""Required configuration variables per project and service.

Files are parsed row by row; everything after that is grouping on
(project, scope, name).  A variable's sources stay in row form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codestrata.functions import fixed, settings, text
from codestrata.operators.filters import config_files

_REFERENCE_EXTS = (".yaml", ".yml", ".json", ".toml")


def _is_reference_format() -> Column:
    return F.regexp_extract(text.basename("path"), r"\.[^.]*$", 0).isin(*_REFERENCE_EXTS)


def _with_texts(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "description": settings.config_description("name"),
        "type": settings.config_type("name"),
        "example": settings.config_example("name"),
        "required": F.lit(True),
        "source": text.basename("path")})


def _env_names() -> Column:
    """Array of (line number, name) of KEY=VALUE lines without a real value."""
    lines = F.transform(F.split("content", "\n"), lambda line: text.strip(line))
    parts = F.transform(lines, lambda line, i: F.when(
        (line != "") & ~line.startswith("#") & line.contains("="),
        F.struct((i + 1).alias("line_no"), text.strip(F.substring_index(line, "=", 1)).alias("name"),
                 F.btrim(text.strip(F.regexp_replace(line, r"^[^=]*=", "")), F.lit("\"'")).alias("value"))))
    wanted = F.filter(parts, lambda p: p.isNotNull() & settings.is_placeholder(p["value"]))
    return F.transform(wanted, lambda p: F.struct(p["line_no"].alias("line_no"), p["name"].alias("name")))


def _reference_names() -> Column:
    """Distinct names referenced in the text, then secret-like keys without a value."""
    found = F.concat(*[F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in fixed.YAML_REFERENCE_PATTERNS])
    names = F.filter(F.transform(found, settings.env_name), lambda n: n != "")
    lines = F.filter(F.transform(F.split("content", "\n"), lambda line: text.strip(line)),
                     lambda line: line.contains(":") & ~line.startswith("#"))
    keys = F.filter(lines, lambda line: settings.looks_secret(text.strip(F.substring_index(line, ":", 1)))
                    & settings.is_placeholder(text.strip(F.regexp_replace(line, r"^[^:]*:", ""))))
    return F.array_distinct(F.concat(names, F.transform(keys, lambda line: text.strip(F.substring_index(line, ":", 1)))))


def env_required(files: DataFrame) -> DataFrame:
    rows = (config_files(files).filter(~_is_reference_format())
            .select("project", "path", F.explode(_env_names()).alias("v")).select("project", "path", "v.*"))
    return _with_texts(rows)


def yaml_required(files: DataFrame) -> DataFrame:
    rows = (config_files(files).filter(_is_reference_format())
            .select("project", "path", F.explode(_reference_names()).alias("name")))
    return _with_texts(rows)


def required_config(files: DataFrame) -> DataFrame:
    """All formats in one pass: the format decides which parser an input row takes."""
    names = F.when(_is_reference_format(), _reference_names()).otherwise(
        F.transform(_env_names(), lambda v: v["name"]))
    rows = config_files(files).select("project", "path", F.explode(names).alias("name"))
    return _with_texts(rows.distinct())


def config_layout(files: DataFrame) -> DataFrame:
    """Per project: service-like top folders that hold config, and the monorepo flag."""
    top = text.first_segment("path")
    service = F.when((F.instr("path", "/") > 0) & settings.is_service_folder(top), top)
    tops = config_files(files).groupBy("project").agg(F.countDistinct(service).alias("n_service_dirs"))
    return (files.select("project").distinct().join(tops, "project", "left").na.fill(0)
            .withColumn("is_monorepo", F.col("n_service_dirs") > 1))


def scoped_config(files: DataFrame) -> DataFrame:
    """Variables with every scope they belong to."""
    nested = F.instr("path", "/") > 0
    top = text.first_segment("path")
    scope = lambda kind, name: F.struct(F.lit(kind).alias("scope_kind"), name.alias("scope"))
    mono = F.col("is_monorepo")
    scopes = F.array_compact(F.array(
        F.when(~mono, scope("service", F.lit("main"))),
        F.when(mono & nested & settings.is_service_folder(top), scope("service", top)),
        F.when(~nested, scope("global", F.lit("global")))))
    layout = config_layout(files).select("project", "is_monorepo")
    return (required_config(files).join(layout, "project")
            .withColumn("s", F.explode(scopes)).select("*", "s.*").drop("s", "is_monorepo"))


def dedup_config(scoped: DataFrame) -> DataFrame:
    """One row per (project, scope, name); the number of sources instead of their list."""
    return scoped.groupBy("project", "scope_kind", "scope", "name").agg(
        F.max_by("description", F.struct(F.length("description"), F.col("description"))).alias("description"),
        F.min("type").alias("type"),
        F.min(F.when(F.col("example") != "", F.col("example"))).alias("example"),
        F.bool_or("required").alias("required"),
        F.countDistinct("source").alias("n_sources"), F.min("source").alias("first_source"))


def config_sources(scoped: DataFrame) -> DataFrame:
    return scoped.select("project", "scope_kind", "scope", "name", "source").distinct()


def config_totals(files: DataFrame) -> DataFrame:
    counts = dedup_config(scoped_config(files)).groupBy("project").agg(
        F.count("*").alias("total_variables"), F.count_if("required").alias("required_count"))
    joined = config_layout(files).join(counts, "project", "left").na.fill(0)
    n_services = F.when(F.col("is_monorepo"), F.col("n_service_dirs")).otherwise(F.lit(1).cast("bigint"))
    return joined.select(
        "project", F.when(F.col("is_monorepo"), "monorepo").otherwise("single-service").alias("project_type"),
        n_services.alias("n_services"), "total_variables", "required_count",
        settings.config_summary("total_variables", "required_count", n_services).alias("summary"))
