"""Queries for project type detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.functions import fixed
from codestrata.operators import detection
from codestrata.plans.registry import define, has_any, literal, query, sql_list
from codestrata.sources import views


def _rule_values() -> str:
    rows = []
    for kind, rule, score, exts, dirs, words in fixed.DETECTION_RULES:
        pos = 0
        for group, tokens in (("ext", exts), ("dir", dirs), ("keyword", words)):
            for t in tokens:
                rows.append(f"({literal(kind)}, {literal(rule)}, {score}, '{group}', {literal(t.lower())}, {pos}, {literal(t)})")
                pos += 1
    return ", ".join(rows)


define("RULES", f"""
rules(type, rule, score, kind, token, pos, label) AS (VALUES {_rule_values()}),
tokfacts AS MATERIALIZED (
  SELECT project, 'ext' AS kind, ext AS token, count(*) AS n, NULL AS first_name FROM facts GROUP BY ALL
  UNION ALL
  SELECT project, 'dir', lower(parent), count(*), NULL FROM facts GROUP BY ALL
  UNION ALL
  SELECT f.project, 'keyword', r.token, count(*), min(lbase)
  FROM facts f JOIN (SELECT DISTINCT token FROM rules WHERE kind = 'keyword') r ON contains(f.lbase, r.token) GROUP BY ALL),
matches AS MATERIALIZED (
  SELECT t.project, r.type, r.rule, r.score, r.kind, r.pos, r.label, t.n, t.first_name
  FROM tokfacts t JOIN rules r ON r.kind = t.kind AND r.token = t.token),
rule_rows AS (
  SELECT project, type, rule, max(score) + sum(CASE WHEN kind = 'ext' AND n > 1 THEN CAST(score AS DOUBLE) * n * 0.1 ELSE 0 END) AS score
  FROM matches GROUP BY ALL),
scores0 AS (
  SELECT p.project, t.type, round(coalesce(s.score, 0.0), 6) AS score
  FROM (SELECT DISTINCT project FROM files) p
  CROSS JOIN (VALUES {", ".join(f"({literal(t)})" for t in fixed.SCORED_TYPES)}) t(type)
  LEFT JOIN (SELECT project, type, sum(score) AS score FROM rule_rows GROUP BY ALL) s ON s.project = p.project AND s.type = t.type)""")

define("MANIFEST", f"""
manifests AS (
  SELECT project, lower(content) AS body FROM facts WHERE ends_with(lpath, 'package.json') AND content <> ''
  QUALIFY row_number() OVER (PARTITION BY project ORDER BY path) = 1),
mflags AS (
  SELECT project, body, {has_any('body', fixed.MANIFEST_FRONTEND_DEPS)} AS fe, {has_any('body', fixed.MANIFEST_BACKEND_DEPS)} AS be,
    {has_any('body', [s.lower() for s in fixed.MANIFEST_FRONTEND_SCRIPTS])} AS fs FROM manifests),
scores AS MATERIALIZED (
  SELECT s.project, s.type, round(CASE
      WHEN s.type = 'Frontend' AND (fe OR fs) THEN score + 6.0
      WHEN s.type = 'Backend' AND (fe OR fs) AND NOT be THEN score * 0.3
      WHEN s.type = 'Backend' AND be AND NOT (fe OR fs) THEN score + 3.0 ELSE score END, 6) AS score
  FROM scores0 s LEFT JOIN mflags m ON m.project = s.project
  UNION ALL
  SELECT project, 'Fullstack', 4.0 FROM mflags WHERE fe AND be)""")

define("STARTUP", f"""
startup AS (
  SELECT project,
    bool_or(pkg AND {has_any('body', fixed.STARTUP_PACKAGE_FRONTEND)}) AS frontend_package,
    bool_or(readme AND {has_any('body', fixed.STARTUP_README_FRONTEND)}) AS frontend_readme,
    bool_or(make AND {has_any('body', fixed.STARTUP_MAKE_FRONTEND)}) AS frontend_make,
    bool_or(pkg AND ({has_any('body', fixed.STARTUP_PACKAGE_BACKEND)}
       OR ({has_any('body', fixed.STARTUP_PACKAGE_BACKEND_DEPS)} AND {has_any('body', fixed.STARTUP_PACKAGE_BACKEND_DEP_SCRIPTS)}))) AS backend_package,
    bool_or(readme AND {has_any('body', fixed.STARTUP_README_BACKEND)}) AS backend_readme,
    bool_or(make AND {has_any('body', fixed.STARTUP_MAKE_BACKEND)}) AS backend_make,
    bool_or(go AND {has_any('body', fixed.STARTUP_GO)}) AS backend_go,
    bool_or(py AND {has_any('body', fixed.STARTUP_PYTHON)}) AS backend_python
  FROM (SELECT project, lower(content) AS body, ends_with(lpath, 'package.json') AND contains(lower(content), '"scripts"') AS pkg,
          contains(lbase, 'readme') AS readme, lbase IN {sql_list(fixed.STARTUP_MAKE_FILES)} AS make,
          ends_with(lpath, 'main.go') OR contains(lpath, 'server.go') OR contains(lpath, 'app.go') AS go,
          lbase IN {sql_list(fixed.STARTUP_PYTHON_FILES)} AS py FROM facts) x
  GROUP BY project),
sflags AS (SELECT *, frontend_package OR frontend_readme OR frontend_make AS has_frontend,
   backend_package OR backend_readme OR backend_make OR backend_go OR backend_python AS has_backend FROM startup)""")

_INTERPRET = " ".join(f"WHEN primary_type = {literal(t)} AND confidence >= {c} THEN {literal(s)}" for t, c, s in fixed.INTERPRETATIONS)
define("TYPED", f"""
ordered AS (
  SELECT project, type, score, row_number() OVER (PARTITION BY project ORDER BY score DESC, list_position(
    [{", ".join(literal(t) for t in fixed.PROJECT_TYPES)}], type)) AS rn FROM scores WHERE score > 0),
tops AS (
  SELECT p.project, coalesce(max(score) FILTER (rn = 1), 0) AS s1, coalesce(max(score) FILTER (rn = 2), 0) AS s2,
    max(type) FILTER (rn = 1) AS t1, max(type) FILTER (rn = 2) AS t2,
    coalesce(max(score) FILTER (type = 'Frontend'), 0) AS fe_score, coalesce(max(score) FILTER (type = 'Backend'), 0) AS be_score
  FROM (SELECT DISTINCT project FROM files) p LEFT JOIN ordered o ON o.project = p.project GROUP BY p.project),
typed AS MATERIALIZED (
  SELECT t.project, CASE WHEN has_frontend AND has_backend THEN 'Fullstack' WHEN s1 < 1 THEN 'Unknown' ELSE t1 END AS primary_type,
    CASE WHEN s1 < 1 OR s2 < 2 OR s1 - s2 < 1 THEN '' ELSE t2 END AS secondary_type,
    round(CASE WHEN has_frontend AND has_backend THEN least((fe_score + be_score) / 2.0, 10.0) WHEN s1 < 1 THEN 0.0 ELSE least(s1, 10.0) END, 6) AS confidence,
    s1 > 0 AS has_evidence
  FROM tops t LEFT JOIN sflags s ON s.project = t.project)""")


@query("rule_scores", "WITH $REPOS, $RULES SELECT project, type, score FROM scores0")
def q_rule_scores(spark, sf):
    return detection.rule_scores(views.repos(spark, sf))


@query("rule_matches", "WITH $REPOS, $RULES SELECT project, type, rule, round(score, 6) AS score FROM rule_rows")
def q_rule_matches(spark, sf):
    return detection.rule_matches(views.repos(spark, sf)).withColumn("score", F.round("score", 6))


@query("manifest_adjust", "WITH $REPOS, $RULES, $MANIFEST SELECT project, type, score FROM scores")
def q_manifest(spark, sf):
    return detection.type_scores(views.repos(spark, sf))


@query("startup_flags", "WITH $REPOS, $STARTUP SELECT * FROM sflags")
def q_startup(spark, sf):
    return detection.startup_flags(views.repos(spark, sf))


@query("project_type", f"""WITH $REPOS, $RULES, $MANIFEST, $STARTUP, $TYPED
SELECT project, primary_type, secondary_type, confidence,
  CASE WHEN confidence >= 8 THEN 'Very High' WHEN confidence >= 6 THEN 'High' WHEN confidence >= 4 THEN 'Medium'
       WHEN confidence >= 2 THEN 'Low' ELSE 'Very Low' END AS band,
  CASE WHEN primary_type = 'Unknown' AND has_evidence THEN {literal(fixed.UNKNOWN_WITH_EVIDENCE)}
       WHEN primary_type = 'Unknown' THEN {literal(fixed.UNKNOWN_WITHOUT_EVIDENCE)} {_INTERPRET} END AS interpretation
FROM typed""")
def q_project_type(spark, sf):
    return detection.project_type(views.repos(spark, sf))


@query("project_type_corpus", """WITH $CORPUS, $RULES, $MANIFEST, $STARTUP, $TYPED
SELECT project, primary_type, secondary_type, confidence FROM typed""")
def q_project_type_corpus(spark, sf):
    return detection.project_type(views.corpus(spark, sf)).drop("band", "interpretation")


_FOUND = "array_to_string(list_filter([{}], lambda t: contains(body, t)), ' ')"
define("EVIDENCE", f"""
evidence AS (
  SELECT project, type AS evidence_key, rule || ': ' || string_agg(CASE kind WHEN 'ext' THEN label || ' files (' || n || ')'
     WHEN 'dir' THEN label || ' directory' ELSE 'file: ' || first_name END, ', ' ORDER BY pos) AS evidence
  FROM matches GROUP BY project, type, rule
  UNION ALL SELECT project, 'Frontend Intelligence', 'Strong frontend dependencies detected: [' ||
     {_FOUND.format(", ".join(literal(t) for t in fixed.MANIFEST_FRONTEND_DEPS))} || ']' FROM mflags WHERE fe
  UNION ALL SELECT project, 'Frontend Intelligence', 'Frontend build/dev scripts detected in package.json' FROM mflags WHERE fs
  UNION ALL SELECT project, 'Backend Intelligence', 'Backend dependencies detected: [' ||
     {_FOUND.format(", ".join(literal(t) for t in fixed.MANIFEST_BACKEND_DEPS))} || ']' FROM mflags WHERE be AND NOT fe AND NOT fs
  UNION ALL SELECT project, 'Fullstack Intelligence', 'Both frontend and backend dependencies detected - likely fullstack/monorepo' FROM mflags WHERE fe AND be
  UNION ALL SELECT project, 'Fullstack', 'Command-based detection: Found both frontend and backend startup commands' FROM sflags WHERE has_frontend AND has_backend)""")


@query("type_evidence", "WITH $REPOS, $RULES, $MANIFEST, $STARTUP, $EVIDENCE SELECT * FROM evidence")
def q_evidence(spark, sf):
    return detection.type_evidence(views.repos(spark, sf))
