"""Queries for required configuration."""

from __future__ import annotations

from codestrata.functions import fixed
from codestrata.operators import config, filters
from codestrata.plans.registry import define, has_any, literal, query, sql_list
from codestrata.sources import views


def _description_sql(k: str) -> str:
    arms = [f"WHEN contains(lower({k}), {literal(w)}) THEN {literal(s)}"
            for w, s in sorted(fixed.CONFIG_DESCRIPTIONS, key=lambda d: -len(d[0]))]
    arms += [f"WHEN contains(lower({k}), '{w}') THEN {literal(b)} || replace({k}, '{x}', '') || {literal(a)}"
             for w, b, x, a in fixed.CONFIG_GENERIC_DESCRIPTIONS]
    return f"CASE {' '.join(arms)} ELSE {literal(fixed.CONFIG_FALLBACK_DESCRIPTION)} || {k} END"


def _example_sql(k: str) -> str:
    arms = []
    for words, example in fixed.CONFIG_EXAMPLES:
        test = " AND ".join(has_any(f"lower({k})", w.split("|")) for w in words)
        arms.append(f"WHEN {test} THEN {literal(example)}")
    return f"CASE {' '.join(arms)} ELSE {literal(fixed.CONFIG_FALLBACK_EXAMPLE)} END"


_WS = "' ' || chr(9) || chr(13)"


def _empty(v: str) -> str:
    return f"({v} IN ('', '\"\"', '\'\'\'\'\'\'') OR {has_any(f'lower({v})', fixed.PLACEHOLDERS)})"


_TEXTS = (f"{_description_sql('name')} AS description, CASE WHEN contains(lower(name), 'api') AND contains(lower(name), 'key') THEN 'api_key' "
          "WHEN contains(lower(name), 'database') OR contains(lower(name), 'db') THEN 'database_url' "
          "WHEN contains(lower(name), 'secret') OR contains(lower(name), 'token') THEN 'secret' "
          "WHEN contains(lower(name), 'password') OR contains(lower(name), 'pwd') THEN 'credential' ELSE 'config' END AS type, "
          f"{_example_sql('name')} AS example, true AS required, regexp_extract(path, '[^/]*$') AS source")

define("CONFIG", f"""
conf AS MATERIALIZED (
  SELECT project, path, content, regexp_extract(base, '\\.[^.]*$') IN ('.yaml', '.yml', '.json', '.toml') AS refs FROM facts
  WHERE (starts_with(base, '.env') OR ends_with(base, '.yaml') OR ends_with(base, '.yml') OR base IN {sql_list(fixed.CONFIG_SOURCE_NAMES)})
    AND NOT list_has_any(string_split(parent, '/'), [{", ".join(literal(d) for d in fixed.CONFIG_SOURCE_PRUNED)}])),
conflines AS MATERIALIZED (
  SELECT project, path, refs, CAST(i AS INTEGER) AS line_no, trim(string_split(content, chr(10))[i], {_WS}) AS line
  FROM conf, LATERAL (SELECT unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i) u),
kv AS (SELECT project, path, line_no, trim(split_part(line, '=', 1), {_WS}) AS name,
    trim(trim(line[strpos(line, '=') + 1:], {_WS}), '"''') AS v
  FROM conflines WHERE NOT refs AND contains(line, '=') AND NOT starts_with(line, '#')),
env0 AS (SELECT project, path, line_no, name FROM kv WHERE {_empty("v")}),
refnames AS (
  {" UNION ALL ".join(f"SELECT project, path, split_part(unnest(regexp_extract_all(content, {literal(p)}, 1)), ':', 1) AS name FROM conf WHERE refs" for p in fixed.YAML_REFERENCE_PATTERNS)}
  UNION ALL
  SELECT project, path, name FROM (
    SELECT project, path, trim(split_part(line, ':', 1), {_WS}) AS name, trim(line[strpos(line, ':') + 1:], {_WS}) AS v
    FROM conflines WHERE refs AND contains(line, ':') AND NOT starts_with(line, '#')) x
  WHERE {has_any('lower(name)', fixed.SECRET_KEY_TOKENS)} AND {_empty("v")}),
yaml0 AS (SELECT DISTINCT project, path, name FROM refnames WHERE name <> ''),
allvars AS (SELECT *, {_TEXTS} FROM (SELECT DISTINCT project, path, name FROM env0 UNION ALL SELECT * FROM yaml0) x),
layout AS (
  SELECT p.project, coalesce(n, 0) AS n_service_dirs, coalesce(n, 0) > 1 AS is_monorepo FROM (SELECT DISTINCT project FROM files) p
  LEFT JOIN (SELECT project, count(DISTINCT CASE WHEN strpos(path, '/') > 0 AND {has_any("lower(split_part(path, '/', 1))", fixed.CONFIG_SERVICE_TOKENS)}
     THEN split_part(path, '/', 1) END) AS n FROM conf GROUP BY project) c ON c.project = p.project),
scoped AS (
  SELECT a.*, 'service' AS scope_kind, 'main' AS scope FROM allvars a JOIN layout l ON l.project = a.project WHERE NOT is_monorepo
  UNION ALL SELECT a.*, 'service', split_part(path, '/', 1) FROM allvars a JOIN layout l ON l.project = a.project
    WHERE is_monorepo AND strpos(path, '/') > 0 AND {has_any("lower(split_part(path, '/', 1))", fixed.CONFIG_SERVICE_TOKENS)}
  UNION ALL SELECT a.*, 'global', 'global' FROM allvars a WHERE strpos(path, '/') = 0),
dedup AS (SELECT project, scope_kind, scope, name, arg_max(description, len(description)) AS description, min(type) AS type, min(example) AS example,
  bool_or(required) AS required, count(DISTINCT source) AS n_sources, min(source) AS first_source FROM scoped GROUP BY project, scope_kind, scope, name),
ctotals AS (
  SELECT l.project, CASE WHEN is_monorepo THEN 'monorepo' ELSE 'single-service' END AS project_type,
    CASE WHEN is_monorepo THEN n_service_dirs ELSE 1 END AS n_services, coalesce(t, 0) AS total_variables, coalesce(r, 0) AS required_count
  FROM layout l LEFT JOIN (SELECT project, count(*) AS t, count(*) FILTER (required) AS r FROM dedup GROUP BY project) d ON d.project = l.project)""")


@query("config_files", "WITH $REPOS, $CONFIG SELECT project, path FROM conf")
def q_config_files(spark, sf):
    return filters.config_files(views.repos(spark, sf)).select("project", "path")


@query("env_required", f"WITH $REPOS, $CONFIG SELECT *, {_TEXTS} FROM env0")
def q_env(spark, sf):
    return config.env_required(views.repos(spark, sf))


@query("yaml_required", f"WITH $REPOS, $CONFIG SELECT *, {_TEXTS} FROM yaml0")
def q_yaml(spark, sf):
    return config.yaml_required(views.repos(spark, sf))


@query("config_scoped", "WITH $REPOS, $CONFIG SELECT project, path, name, type, example, scope_kind, scope FROM scoped")
def q_scoped(spark, sf):
    return config.scoped_config(views.repos(spark, sf)).select("project", "path", "name", "type", "example", "scope_kind", "scope")


@query("config_dedup", "WITH $REPOS, $CONFIG SELECT * FROM dedup")
def q_dedup(spark, sf):
    return config.dedup_config(config.scoped_config(views.repos(spark, sf)))


@query("config_sources", "WITH $REPOS, $CONFIG SELECT DISTINCT project, scope_kind, scope, name, source FROM scoped")
def q_sources(spark, sf):
    return config.config_sources(config.scoped_config(views.repos(spark, sf)))


@query("config_totals", """WITH $REPOS, $CONFIG
SELECT *, CASE WHEN total_variables = 0 THEN 'No configuration secrets detected. This project may not require additional environment variables.'
  ELSE 'Found ' || total_variables || ' environment variables' ||
    CASE WHEN required_count > 0 THEN ', ' || required_count || ' of which are required to be configured' ELSE '' END ||
    CASE WHEN n_services > 1 THEN ' across ' || n_services || ' services' ELSE '' END ||
    '. Review each variable and provide appropriate values before running the project.' END AS summary
FROM ctotals""")
def q_totals(spark, sf):
    return config.config_totals(views.repos(spark, sf))


@query("config_monorepo", "WITH $REPOS, $CONFIG SELECT project, n_service_dirs, is_monorepo FROM layout")
def q_monorepo(spark, sf):
    return config.config_layout(views.repos(spark, sf))


@query("secret_assignments", f"""WITH $CORPUS,
t AS (SELECT project, path, CAST(i AS INTEGER) AS line_no, trim(string_split(content, chr(10))[i], {_WS}) AS line
  FROM files, LATERAL (SELECT unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i) u),
k AS (SELECT project, path, line_no, trim(split_part(line, '=', 1), {_WS}) AS name, line FROM t
  WHERE contains(line, '=') AND NOT starts_with(line, '#'))
SELECT project, count(*) AS n_assignments, count(*) FILTER ({has_any('lower(name)', fixed.SECRET_KEY_TOKENS)}) AS n_secret_like FROM k GROUP BY project""")
def q_assignments(spark, sf):
    from pyspark.sql import functions as F
    from codestrata.functions import settings, text
    from codestrata.operators.discovery import lines_of
    lines = lines_of(views.corpus(spark, sf)).withColumn("line", text.strip("line"))
    keys = lines.filter(F.col("line").contains("=") & ~F.col("line").startswith("#")).withColumn(
        "name", text.strip(F.substring_index("line", "=", 1)))
    return keys.groupBy("project").agg(F.count("*").alias("n_assignments"),
                                       F.count_if(settings.looks_secret("name")).alias("n_secret_like"))
