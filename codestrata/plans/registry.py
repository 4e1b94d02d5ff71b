"""Catalogue of registered queries and the SQL text each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codestrata.sources import views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

CORPUS_CTE = (
    "files AS MATERIALIZED (SELECT source AS project, source || '/' || lang || '/' || "
    "CAST(doc_id AS VARCHAR) || '.txt' AS path, text AS content FROM documents)"
)


def _repos_cte() -> str:
    source = "part"
    for level in views.LEVELS:
        source = f"(SELECT {', '.join(level)} FROM {source})"
    return f"files AS MATERIALIZED (SELECT * FROM {source})"


REPOS_CTE = _repos_cte()

FACTS_CTE = r"""facts AS MATERIALIZED (
  SELECT project, path, content, strlen(content) AS size,
         regexp_extract(path, '[^/]*$') AS base,
         lower(regexp_extract(path, '[^/]*$')) AS lbase,
         CASE WHEN strpos(path, '/') = 0 THEN '.' ELSE regexp_replace(path, '/[^/]*$', '') END AS parent,
         lower(regexp_extract(regexp_extract(path, '[^/]*$'), '\.[^.]*$')) AS ext,
         lower(path) AS lpath
  FROM files)"""

PROGRESS_CTE = """progress AS MATERIALIZED (
  SELECT user_id AS run_id, event_id AS seq, ts,
         CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'complete' ELSE 'progress' END AS type,
         event_type AS stage, CAST(least(100, floor(value)) AS INTEGER) AS progress
  FROM events)"""

_MACROS = {
    "$CORPUS": CORPUS_CTE + ", " + FACTS_CTE,
    "$REPOS": REPOS_CTE + ", " + FACTS_CTE,
    "$PROGRESS": PROGRESS_CTE,
}


def define(name: str, text: str) -> None:
    """Share a piece of SQL between several checks as ``$name``."""
    _MACROS["$" + name] = text


def expand(sql: str) -> str:
    for _ in range(8):
        before = sql
        for key in sorted(_MACROS, key=len, reverse=True):
            sql = sql.replace(key, _MACROS[key])
        if sql == before:
            break
    return sql


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = expand(sql)
        return fn
    return register


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(tokens) -> str:
    return "(" + ", ".join(literal(t) for t in tokens) + ")"


def sql_array(tokens) -> str:
    return "[" + ", ".join(literal(t) for t in tokens) + "]"


def has_any(expr: str, tokens) -> str:
    """SQL test: the text contains one of the tokens."""
    return "(" + " OR ".join(f"contains({expr}, {literal(t)})" for t in tokens) + ")"
