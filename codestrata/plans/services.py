"""Queries for service discovery, dependency edges, stacks and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.functions import fixed, services as sv
from codestrata.operators import discovery, edges
from codestrata.plans.registry import ORACLES, define, has_any, literal, query, sql_list
from codestrata.session import cut_lineage
from codestrata.sources import views

_DIRS = sql_list(fixed.SERVICE_DIRS)

define("SEGS", f"""
segs AS MATERIALIZED (
  SELECT project, path, len(string_split(path, '/')) AS n, CAST(i AS INTEGER) AS i, string_split(path, '/')[i] AS seg,
    CASE WHEN i < len(string_split(path, '/')) THEN string_split(path, '/')[i + 1] END AS nxt,
    array_to_string(list_slice(string_split(path, '/'), 1, i), '/') AS upto
  FROM files, LATERAL (SELECT unnest(range(1, len(string_split(path, '/')) + 1)) AS i) u),
svc_names AS (
  SELECT f.project, f.path, CASE WHEN strpos(f.path, '/') = 0 THEN f.project
      ELSE coalesce((SELECT arg_min(nxt, i) FROM segs s WHERE s.project = f.project AND s.path = f.path AND i < n AND lower(seg) IN {_DIRS}),
                    string_split(f.path, '/')[-2]) END AS name
  FROM files f WHERE ends_with(path, 'main.go') OR ends_with(path, 'package.json')),
svc_like AS (SELECT DISTINCT project, path FROM segs WHERE lower(seg) IN {_DIRS} OR {has_any('path', fixed.SERVICE_PATH_TOKENS)})""")

define("MAINGO", """
mains AS (SELECT f.project, f.path, f.parent, count(*) OVER (PARTITION BY f.project) AS c FROM facts f WHERE ends_with(path, 'main.go')),
main_go AS (
  SELECT m.project, s.name, m.parent AS path, m.path AS entry_point, 'main_go' AS detection_type,
    CASE WHEN c > 1 THEN 0.9 ELSE 0.7 END AS confidence,
    CASE WHEN c > 1 THEN 'main.go file at ' ELSE 'main.go file in service structure: ' END || m.path AS evidence, 'Go' AS language
  FROM mains m JOIN svc_names s ON s.project = m.project AND s.path = m.path
  WHERE (c > 1 OR EXISTS (SELECT 1 FROM svc_like l WHERE l.project = m.project AND l.path = m.path)) AND s.name <> '')""")

define("MAKEFILE", f"""
makes AS (SELECT project, path, content FROM facts WHERE lbase IN {sql_list(fixed.MAKE_FILES)} AND content <> ''
  QUALIFY row_number() OVER (PARTITION BY project ORDER BY path) = 1),
mlines AS (SELECT project, i AS line_no, trim(string_split(content, chr(10))[i], ' ' || chr(9) || chr(13)) AS line
  FROM makes, LATERAL (SELECT unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i) u),
mhits AS (
  SELECT project, line_no, 'run target' AS kind, regexp_extract(line, '^(run|start)-(\\w+):', 2) AS name FROM mlines
  UNION ALL SELECT project, line_no, 'go run cmd', regexp_extract(line, 'go\\s+run\\s+\\./cmd/(\\w+)', 1) FROM mlines
  UNION ALL SELECT project, line_no, 'docker-compose up', regexp_extract(line, 'docker-compose\\s+up\\s+(\\w+)', 1) FROM mlines
  UNION ALL SELECT project, line_no, 'build target', regexp_extract(line, '^build-(\\w+):', 1) FROM mlines
  UNION ALL SELECT project, line_no, 'build target', CASE WHEN regexp_matches(line, '^build-(\\w+):') THEN '' ELSE regexp_extract(line, '^(\\w+)-build:', 1) END FROM mlines),
makefile AS (
  SELECT project, name, 'cmd/' || name AS path, 'cmd/' || name || '/main.go' AS entry_point, 'makefile' AS detection_type,
    0.8 AS confidence, 'Makefile ' || kind || ' at line ' || line_no AS evidence, 'Go' AS language
  FROM mhits WHERE name <> '' AND NOT (kind = 'docker-compose up' AND name IN ('all', '-d'))
    AND NOT (kind = 'build target' AND lower(name) IN {sql_list(fixed.COMMON_MAKE_TARGETS)}))""")

define("COMPOSE", f"""
comps AS (SELECT project, path, content FROM facts WHERE lbase IN {sql_list(fixed.COMPOSE_FILES)} AND content <> ''
  QUALIFY row_number() OVER (PARTITION BY project ORDER BY path) = 1),
clines AS (SELECT project, path, i AS line_no, string_split(content, chr(10))[i] AS line, trim(string_split(content, chr(10))[i], ' ' || chr(9) || chr(13)) AS t
  FROM comps, LATERAL (SELECT unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i) u),
cstate AS (SELECT *, arg_max(CASE WHEN t = 'services:' THEN 1 ELSE 0 END, line_no)
    FILTER (t = 'services:' OR (line <> '' AND left(line, 1) NOT IN (' ', chr(9)) AND NOT starts_with(t, '#')))
    OVER (PARTITION BY project, path ORDER BY line_no) AS st FROM clines),
compose AS (
  SELECT project, trim(split_part(line, ':', 1), ' ' || chr(9)) AS name, 'service-' || trim(split_part(line, ':', 1), ' ' || chr(9)) AS path,
    path AS entry_point, 'docker_compose' AS detection_type, 0.8 AS confidence,
    'Docker Compose service definition at line ' || line_no AS evidence, 'Unknown' AS language
  FROM cstate WHERE st = 1 AND t <> 'services:' AND contains(line, ':')
    AND ((starts_with(line, '  ') AND NOT starts_with(line, '    ')) OR (starts_with(line, chr(9)) AND NOT starts_with(line, chr(9) || chr(9))))
    AND trim(split_part(line, ':', 1), ' ' || chr(9)) <> ''
    AND lower(trim(split_part(line, ':', 1), ' ' || chr(9))) NOT IN {sql_list(fixed.COMPOSE_KEYS)})""")

define("PACKAGES", """
package_json AS (
  SELECT f.project, s.name, f.parent AS path, f.path AS entry_point, 'package_json' AS detection_type, 0.7 AS confidence,
    'package.json file at ' || f.path AS evidence, 'Node.js' AS language
  FROM facts f JOIN svc_names s ON s.project = f.project AND s.path = f.path
  WHERE ends_with(f.path, 'package.json') AND f.path <> 'package.json' AND s.name <> ''
    AND (SELECT count(*) FROM files g WHERE g.project = f.project AND ends_with(g.path, 'package.json')) > 1)""")

_ENTRIES = ", ".join(f"({i}, {literal(s)})" for i, s in enumerate(fixed.ENTRY_SUFFIXES))
define("DIRECTORIES", f"""
dirhits AS (
  SELECT project, seg, nxt AS name, min(upto || '/' || nxt) AS service_path FROM segs
  WHERE i < n AND lower(seg) IN {_DIRS} AND nxt <> '' AND lower(nxt) NOT IN {sql_list(fixed.COMMON_SUBDIRS)} GROUP BY ALL),
dirlang AS (
  SELECT d.project, d.service_path, arg_min(CASE WHEN ends_with(path, '.go') THEN 'Go' WHEN ends_with(path, '.js') OR ends_with(path, '.ts') THEN 'Node.js'
      WHEN ends_with(path, '.py') THEN 'Python' ELSE 'Java' END, path) AS language
  FROM (SELECT DISTINCT project, service_path FROM dirhits) d JOIN files f ON f.project = d.project AND starts_with(f.path, d.service_path)
  WHERE regexp_matches(path, '\\.(go|js|ts|py|java)$') GROUP BY ALL),
dirent AS (
  SELECT d.project, d.service_path, arg_min(f.path, e.i) AS entry
  FROM (SELECT DISTINCT project, service_path FROM dirhits) d CROSS JOIN (VALUES {_ENTRIES}) e(i, s)
  JOIN files f ON f.project = d.project AND f.path = d.service_path || e.s GROUP BY ALL),
directory AS (
  SELECT d.project, d.name, d.service_path AS path, coalesce(e.entry, d.service_path) AS entry_point, 'directory' AS detection_type,
    0.6 AS confidence, 'Service directory structure: ' || d.service_path AS evidence, coalesce(l.language, 'Unknown') AS language
  FROM dirhits d LEFT JOIN dirent e ON e.project = d.project AND e.service_path = d.service_path
  LEFT JOIN dirlang l ON l.project = d.project AND l.service_path = d.service_path)""")

_PURPOSE_CASE = " ".join(
    f"WHEN w IN {sql_list(words)} THEN {literal(s)}" for words, s in fixed.SERVICE_PURPOSES)
_KIND_CASE = " ".join(f"WHEN {has_any('lower(purpose)', words)} THEN '{kind}'" for words, kind in fixed.SERVICE_KINDS)
define("SERVICES", f"""$SEGS, $MAINGO, $MAKEFILE, $COMPOSE, $PACKAGES, $DIRECTORIES,
cands AS MATERIALIZED (
  SELECT *, 1 AS no FROM main_go UNION ALL SELECT *, 2 FROM makefile UNION ALL SELECT *, 3 FROM compose
  UNION ALL SELECT *, 4 FROM package_json UNION ALL SELECT *, 5 FROM directory),
winners AS (SELECT * FROM cands QUALIFY row_number() OVER (PARTITION BY project, lower(name) ORDER BY confidence DESC, no, path, entry_point, evidence) = 1),
support AS (
  SELECT project, lower(name) AS key, count(DISTINCT evidence) AS n_evidence,
    list_sort(list(DISTINCT no)) AS nos FROM cands GROUP BY ALL),
merged AS (
  SELECT w.project, w.name, w.path, w.entry_point, w.language, w.confidence,
    list_transform(nos, lambda x: [{", ".join(literal(p) for p in fixed.PRODUCERS)}][x]) AS kinds, n_evidence
  FROM winners w JOIN support s ON s.project = w.project AND s.key = lower(w.name)),
found AS (
  SELECT m.project, m.name, m.path, m.entry_point, m.language, m.confidence, array_to_string(kinds, ',') AS detection_types, n_evidence,
    m.language || ' service detected via ' || array_to_string(kinds, ' and ') AS description,
    CASE WHEN f.content IS NULL THEN 'http' WHEN m.language = 'Go' AND contains(f.content, 'grpc') THEN 'grpc'
         WHEN m.language = 'Go' AND contains(f.content, 'graphql') THEN 'graphql'
         WHEN m.language = 'Node.js' AND (contains(f.content, 'apollo') OR contains(f.content, 'graphql')) THEN 'graphql' ELSE 'http' END AS api_type
  FROM merged m LEFT JOIN files f ON f.project = m.project AND f.path = m.entry_point WHERE m.confidence >= 0.5),
words AS (
  SELECT project, name, arg_min(s, i) AS s FROM (
    SELECT project, name, i, CASE {_PURPOSE_CASE} END AS s FROM (
      SELECT project, name, i, string_split(lower(name), '-')[i] AS w
      FROM found, LATERAL (SELECT unnest(range(1, len(string_split(name, '-')) + 1)) AS i) u) x) y
  WHERE s IS NOT NULL GROUP BY ALL),
purposed AS (
  SELECT f.*, coalesce(w.s, CASE api_type WHEN 'http' THEN 'HTTP API service: ' WHEN 'grpc' THEN 'gRPC service: ' ELSE 'GraphQL API: ' END || f.name) AS purpose
  FROM found f LEFT JOIN words w ON w.project = f.project AND w.name = f.name),
services AS MATERIALIZED (SELECT *, CASE {_KIND_CASE} ELSE 'Business Logic' END AS kind FROM purposed)""")

_CAND = "project, name, path, entry_point, detection_type, CAST(confidence AS DOUBLE) AS confidence, evidence, language"


def _producer(name: str, body: str, table: str, fn) -> None:
    query(name, f"WITH $REPOS, {body} SELECT {_CAND} FROM {table}")(lambda spark, sf: fn(views.repos(spark, sf)))


_producer("svc_main_go", "$SEGS, $MAINGO", "main_go", discovery.svc_main_go)
_producer("svc_makefile", "$MAKEFILE", "makefile", discovery.svc_makefile)
_producer("svc_compose", "$COMPOSE", "compose", discovery.svc_compose)
_producer("svc_package_json", "$SEGS, $PACKAGES", "package_json", discovery.svc_package_json)
_producer("svc_directory", "$SEGS, $DIRECTORIES", "directory", discovery.svc_directory)
_producer("svc_candidates", "$SERVICES", "cands", discovery.service_candidates)


@query("svc_merged", """WITH $REPOS, $SERVICES
SELECT project, name, path, entry_point, language, CAST(confidence AS DOUBLE) AS confidence, array_to_string(kinds, ',') AS detection_types,
  n_evidence, language || ' service detected via ' || array_to_string(kinds, ' and ') AS description FROM merged""")
def q_merged(spark, sf):
    return discovery.merge_candidates(discovery.service_candidates(views.repos(spark, sf)))


@query("svc_evidence", """WITH $REPOS, $SERVICES
SELECT DISTINCT project, lower(name) AS service_key, detection_type, evidence FROM cands""")
def q_svc_evidence(spark, sf):
    return discovery.candidate_evidence(discovery.service_candidates(views.repos(spark, sf)))


@query("svc_api_type", "WITH $REPOS, $SERVICES SELECT project, name, entry_point, api_type FROM services")
def q_api_type(spark, sf):
    return discovery.discover_services(views.repos(spark, sf)).select("project", "name", "entry_point", "api_type")


@query("svc_entry_content", """WITH $REPOS, $SERVICES
SELECT s.project, s.name, s.entry_point, f.content FROM services s LEFT JOIN files f ON f.project = s.project AND f.path = s.entry_point""")
def q_entry_content(spark, sf):
    files = views.repos(spark, sf)
    return discovery.with_entry_content(discovery.discover_services(files).select("project", "name", "entry_point"), files)


@query("svc_purpose", "WITH $REPOS, $SERVICES SELECT project, name, purpose, kind FROM services")
def q_purpose(spark, sf):
    return discovery.discover_services(views.repos(spark, sf)).select("project", "name", "purpose", "kind")


define("BYSTACK", f"""
gomain AS (
  SELECT project, path, parent, content, CASE WHEN strpos(path, '/') = 0 THEN project
     WHEN base = 'main.go' AND list_position(string_split(parent, '/'), 'cmd') > 0
     THEN string_split(parent, '/')[list_position(string_split(parent, '/'), 'cmd') + 1] END AS name,
   CASE WHEN {has_any('content', fixed.GO_HTTP_TOKENS)} THEN 'http' WHEN {has_any('content', fixed.GO_GRPC_TOKENS)} THEN 'grpc'
        WHEN {has_any('content', fixed.GO_GRAPHQL_TOKENS)} THEN 'graphql' WHEN {has_any('content', fixed.GO_WORKER_TOKENS)} THEN NULL ELSE 'http' END AS api_type
  FROM facts WHERE ends_with(path, 'main.go')),
nodeent AS (
  SELECT f.project, f.parent, e.i, f.parent || '/' || e.s AS want FROM facts f
  CROSS JOIN (VALUES {", ".join(f"({i}, '{s}')" for i, s in enumerate(fixed.NODE_ENTRY_SUFFIXES))}) e(i, s) WHERE base = 'package.json'),
nodes1 AS (
  SELECT n.project, n.parent, arg_min(f.path, n.i) AS entry FROM nodeent n
  JOIN files f ON f.project = n.project AND f.path = CASE WHEN n.parent = '.' THEN n.want[3:] ELSE n.want END
  WHERE {has_any('f.content', fixed.NODE_SERVER_TOKENS)} GROUP BY ALL),
bystack AS (
  SELECT project, 'go' AS stack, name, parent AS path, path AS entry_point, api_type,
    CASE WHEN {has_any('content', fixed.GO_HTTP_TOKENS)} THEN regexp_extract(content, {literal(fixed.PORT_PATTERN)}, 1) ELSE '' END AS port, '' AS description
  FROM gomain WHERE name IS NOT NULL AND name <> '' AND api_type IS NOT NULL
  UNION ALL SELECT project, 'node.js', regexp_extract(parent, '[^/]*$'), parent, entry, 'http', '', '' FROM nodes1
  UNION ALL SELECT project, 'react.js', regexp_extract(parent, '[^/]*$'), parent, path, 'http', '', 'React microfrontend: ' || regexp_extract(parent, '[^/]*$')
  FROM facts WHERE base = 'package.json' AND regexp_matches(parent, '(^|/)(apps|packages)/[^/]') AND contains(content, 'react')
    AND {has_any('content', fixed.REACT_APP_TOKENS)}),
readmes AS (SELECT project, content FROM facts WHERE lbase = 'readme.md' AND content <> '' QUALIFY row_number() OVER (PARTITION BY project ORDER BY path) = 1),
mentioned AS (
  SELECT DISTINCT project, unnest(regexp_extract_all(content, 'make\\s+run-(\\w+)', 1) || regexp_extract_all(content, 'go\\s+run\\s+\\./cmd/(\\w+)', 1)
    || regexp_extract_all(content, 'docker-compose\\s+up\\s+(\\w+)', 1)) AS name FROM readmes)""")


@query("svc_by_stack", "WITH $REPOS, $BYSTACK SELECT * FROM bystack")
def q_by_stack(spark, sf):
    return discovery.svc_by_stack(views.repos(spark, sf))


@query("svc_readme", "WITH $REPOS, $BYSTACK SELECT project, name FROM mentioned")
def q_readme(spark, sf):
    return discovery.svc_readme(views.repos(spark, sf))


@query("svc_reconciled", """WITH $REPOS, $BYSTACK
SELECT * FROM bystack UNION ALL
SELECT project, 'readme', name, 'cmd/' || name, 'cmd/' || name || '/main.go', 'http', '', 'Service mentioned in README: ' || name
FROM mentioned m WHERE NOT EXISTS (SELECT 1 FROM bystack b WHERE b.project = m.project AND b.name = m.name)""")
def q_reconciled(spark, sf):
    files = views.repos(spark, sf)
    return discovery.reconcile(discovery.svc_by_stack(files), discovery.svc_readme(files))


@query("svc_exposed", f"""WITH $REPOS, $SERVICES
SELECT s.project, s.name, s.entry_point, s.language FROM services s JOIN files f ON f.project = s.project AND f.path = s.entry_point
WHERE (s.language = 'Go' AND ({has_any('content', fixed.GO_HTTP_TOKENS + fixed.GO_GRPC_TOKENS + fixed.GO_GRAPHQL_TOKENS)}
        OR NOT {has_any('content', fixed.GO_WORKER_TOKENS)}))
   OR (s.language = 'Node.js' AND {has_any('content', fixed.NODE_SERVER_TOKENS)})""")
def q_exposed(spark, sf):
    files = views.repos(spark, sf)
    stack = F.when(F.col("language") == "Go", "go").when(F.col("language") == "Node.js", "node.js")
    found = discovery.discover_services(files).select("project", "name", "entry_point", "language", stack.alias("stack"))
    return discovery.exposed_services(found, files).drop("stack")


# --- edges --------------------------------------------------------------------------

def _rx(pattern: str) -> str:
    return literal(pattern)


_IP = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"
_TRIM = "CASE WHEN ends_with({0}, '-service') THEN {0}[:-9] ELSE {0} END"


def _host(expr: str) -> str:
    return (f"CASE WHEN {expr} = 'localhost' OR regexp_matches({expr}, '{_IP}') THEN '' ELSE " + _TRIM.format(expr) + " END")


def _drop_end(expr: str, word: str) -> str:
    return f"regexp_replace({expr}, '{word}$', '')"


define("EDGES", f"""$SERVICES,
alias AS MATERIALIZED (SELECT project, name AS alias FROM services UNION SELECT project, name || '-service' FROM services
  UNION SELECT project, replace(name, '-', '_') FROM services),
rawrefs AS (
  SELECT project, path, 'k8s' AS k, unnest(regexp_extract_all(content, {_rx(fixed.K8S_ENV_PATTERN)}, 1)) AS a,
     unnest(regexp_extract_all(content, {_rx(fixed.K8S_ENV_PATTERN)}, 2)) AS b
  FROM facts WHERE (ends_with(lbase, '.yaml') OR ends_with(lbase, '.yml')) AND contains(content, 'apiVersion:') AND {has_any('content', fixed.K8S_KINDS)}
  UNION ALL
  SELECT project, path, 'config', unnest(regexp_extract_all(content, {_rx(fixed.CONFIG_URL_PATTERN)}, 1)),
     unnest(regexp_extract_all(content, {_rx(fixed.CONFIG_URL_PATTERN)}, 2))
  FROM facts WHERE {" OR ".join(f"ends_with(lbase, '{c}')" for c in fixed.CONFIG_NAMES)}
  UNION ALL
  SELECT project, path, 'import', unnest(regexp_extract_all(content, {_rx(fixed.GO_IMPORT_PATTERN)}, 1)), NULL FROM facts WHERE ends_with(path, '.go')
  UNION ALL
  SELECT project, path, 'grpc', unnest(regexp_extract_all(content, {_rx(fixed.GRPC_CLIENT_PATTERN)}, 0)),
     unnest(regexp_extract_all(content, {_rx(fixed.GRPC_CLIENT_PATTERN)}, 1)) FROM facts WHERE ends_with(path, '.go')
  UNION ALL
  SELECT project, path, 'http', unnest(regexp_extract_all(content, {_rx(fixed.HTTP_CALL_PATTERN)}, 1)), NULL
  FROM facts WHERE {" OR ".join(f"ends_with(path, '{e}')" for e in fixed.CODE_EXTS)}
  UNION ALL
  SELECT project, path, 'dial', unnest(regexp_extract_all(content, {_rx(fixed.GRPC_DIAL_PATTERN)}, 1)), NULL
  FROM facts WHERE {" OR ".join(f"ends_with(path, '{e}')" for e in fixed.CODE_EXTS)}),
stepped AS (
  SELECT *, CASE k
     WHEN 'k8s' THEN b
     WHEN 'config' THEN regexp_replace({_drop_end('b', '-service')}, '^service-', '')
     WHEN 'import' THEN CASE WHEN regexp_matches(a, '(^|/)services/') THEN {_drop_end("regexp_extract(a, '(^|/)services/([^/]*)', 2)", '-service')}
          ELSE {_drop_end(_drop_end("regexp_extract(a, '(^|/)clients/([^/]*)', 2)", 'service'), 'client')} END
     WHEN 'grpc' THEN lower(b)
     WHEN 'http' THEN split_part(split_part(regexp_replace(regexp_replace(a, '^http://', ''), '^https://', ''), '/', 1), ':', 1)
     ELSE split_part(a, ':', 1) END AS t FROM rawrefs),
targets AS (SELECT *, CASE WHEN k IN ('http', 'dial') THEN {_host('t')} ELSE t END AS target FROM stepped),
ownercand AS (
  SELECT project, path, CASE WHEN seg = 'cmd' THEN 0 ELSE 1000 END + 2 * i AS r, {_drop_end('nxt', '-service')} AS o, seg FROM segs WHERE i < n AND seg IN ('cmd', 'services')
  UNION ALL SELECT project, path, 2 * i + 1, nxt, seg FROM segs WHERE i < n AND seg = 'cmd'
  UNION ALL SELECT project, path, 1000 + 2 * i + 1, nxt, 'raw' FROM segs WHERE i < n AND seg = 'services'),
owner AS (SELECT c.project, c.path, arg_min(o, r) AS owner FROM ownercand c JOIN alias a ON a.project = c.project AND a.alias = c.o
   WHERE seg <> 'services' GROUP BY ALL),
pathedges AS (
  SELECT DISTINCT t.project, o.owner AS "from", t.target AS "to",
    CASE WHEN k IN ('k8s', 'config') THEN 'config' WHEN k IN ('import', 'grpc') THEN 'import' ELSE 'network' END AS evidence_type,
    CASE k WHEN 'k8s' THEN 'K8s env var: ' || a || ' -> ' || target WHEN 'config' THEN 'Config: ' || a || ' -> ' || target
      WHEN 'import' THEN 'Import: ' || a WHEN 'grpc' THEN 'gRPC client: ' || a WHEN 'http' THEN 'HTTP call: ' || a ELSE 'gRPC dial: ' || a END AS evidence,
    t.path AS file_path,
    CAST(CASE k WHEN 'k8s' THEN 0.9 WHEN 'config' THEN 0.8 WHEN 'import' THEN 0.9 WHEN 'grpc' THEN 0.95 WHEN 'http' THEN 0.8 ELSE 0.85 END AS DOUBLE) AS confidence, k
  FROM targets t JOIN owner o ON o.project = t.project AND o.path = t.path
  JOIN alias x ON x.project = t.project AND x.alias = t.target
  WHERE t.target <> '' AND t.target <> o.owner),
yl AS (
  SELECT project, path, i AS ln, regexp_replace(string_split(content, chr(10))[i], '\\s+#.*$', '') AS line
  FROM facts, LATERAL (SELECT unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i) u
  WHERE lbase IN {sql_list(fixed.COMPOSE_EDGE_FILES)}),
y1 AS (SELECT *, len(line) - len(ltrim(line)) AS ind, trim(line) AS body FROM yl WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')),
y2 AS (SELECT *, regexp_matches(body, '^-\\s') AS item, regexp_extract(body, '^([^:]+?)\\s*:(\\s|$)', 1) AS k0, trim(regexp_extract(body, '^[^:]+?\\s*:\\s+(.*)$', 1)) AS val FROM y1),
y3 AS (SELECT *, arg_max(k0, ln) FILTER (ind = 0) OVER (PARTITION BY project, path ORDER BY ln) AS section FROM y2),
y4 AS (SELECT *, min(ind) OVER (PARTITION BY project, path) AS si FROM y3 WHERE section = 'services' AND ind > 0),
y5 AS (SELECT *, arg_max(k0, ln) FILTER (ind = si) OVER (PARTITION BY project, path ORDER BY ln) AS svc FROM y4),
y6 AS (SELECT *, min(ind) OVER (PARTITION BY project, path, svc) AS ki FROM y5 WHERE ind > si),
y7 AS (SELECT *, arg_max(k0, ln) FILTER (ind = ki AND NOT item) OVER (PARTITION BY project, path ORDER BY ln) AS key FROM y6),
y8 AS (
  SELECT project, path, svc, key, 'x' AS kd, unnest(list_transform(string_split(regexp_extract(val, '^\\[(.*)\\]$', 1), ','), lambda v: trim(v))) AS v FROM y7 WHERE ind = ki AND NOT item AND val LIKE '[%]'
  UNION ALL SELECT project, path, svc, key, 's', val FROM y7 WHERE ind = ki AND NOT item AND val <> '' AND val NOT LIKE '[%]'
  UNION ALL SELECT project, path, svc, key, 'x', trim(body[2:]) FROM y7 WHERE item
  UNION ALL SELECT project, path, svc, key, 'p', k0 || '=' || val FROM y7 WHERE NOT item AND ind <> ki AND k0 <> ''),
ydep AS (SELECT DISTINCT project, svc AS "from", v AS "to", 'config' AS evidence_type, 'depends_on: ' || v AS evidence, path AS file_path, CAST(1.0 AS DOUBLE) AS confidence
  FROM y8 WHERE key = 'depends_on' AND kd IN ('x', 's')),
yenv AS (SELECT DISTINCT project, svc AS "from", {_drop_end(f"regexp_extract(v, {_rx(fixed.COMPOSE_ENV_PATTERN)}, 2)", '-service')} AS "to", 'config' AS evidence_type,
    'Docker env: ' || v AS evidence, path AS file_path, CAST(0.9 AS DOUBLE) AS confidence
  FROM y8 WHERE key = 'environment' AND kd IN ('x', 'p') AND regexp_matches(v, {_rx(fixed.COMPOSE_ENV_PATTERN)})),
depedges AS (SELECT e.* FROM ydep e WHERE EXISTS (SELECT 1 FROM alias a WHERE a.project = e.project AND a.alias = e."from")
  AND EXISTS (SELECT 1 FROM alias a WHERE a.project = e.project AND a.alias = e."to")),
envedges AS (SELECT e.* FROM yenv e WHERE e."from" <> e."to" AND EXISTS (SELECT 1 FROM alias a WHERE a.project = e.project AND a.alias = e."from")
  AND EXISTS (SELECT 1 FROM alias a WHERE a.project = e.project AND a.alias = e."to")),
edges AS MATERIALIZED (SELECT * EXCLUDE (k) FROM pathedges UNION ALL SELECT * FROM depedges UNION ALL SELECT * FROM envedges),
best AS MATERIALIZED (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY project, "from", "to", evidence_type ORDER BY confidence DESC, file_path, evidence) = 1)""")


def _found(files):
    """Services, computed once: edges look them up several times."""
    return cut_lineage(discovery.discover_services(files))


def _edge_query(name: str, source: str, fn) -> None:
    def run(spark, sf):
        files = views.repos(spark, sf)
        return fn(files, edges.aliases(_found(files)))
    query(name, f'WITH $REPOS, $EDGES SELECT project, "from", "to", evidence_type, evidence, file_path, confidence FROM {source}')(run)


_edge_query("edge_depends_on", "depedges", edges.edge_depends_on)
_edge_query("edge_compose_env", "envedges", edges.edge_compose_env)
_edge_query("edge_k8s", "pathedges WHERE k = 'k8s'", edges.edge_k8s)
_edge_query("edge_config", "pathedges WHERE k = 'config'", edges.edge_config)
_edge_query("edge_import", "pathedges WHERE k IN ('import', 'grpc')", edges.edge_import)
_edge_query("edge_network", "pathedges WHERE k IN ('http', 'dial')", edges.edge_network)


def _edges(spark, sf):
    files = views.repos(spark, sf)
    services = _found(files)
    return services, edges.service_edges(files, services)


@query("file_owners", "WITH $REPOS, $EDGES SELECT project, path, owner FROM owner")
def q_owners(spark, sf):
    files = views.repos(spark, sf)
    return edges.with_owner(files.select("project", "path"), edges.aliases(_found(files))).withColumnRenamed("from", "owner")


@query("edges_all", "WITH $REPOS, $EDGES SELECT * FROM edges")
def q_edges(spark, sf):
    return _edges(spark, sf)[1]


@query("edges_dedup", "WITH $REPOS, $EDGES SELECT * FROM best")
def q_edges_dedup(spark, sf):
    return edges.dedup_edges(_edges(spark, sf)[1])


@query("edge_counts", """WITH $REPOS, $EDGES
SELECT project, "from", count(*) AS n_edges, count(*) FILTER (evidence_type = 'config') AS n_config,
  count(*) FILTER (evidence_type = 'import') AS n_import, count(*) FILTER (evidence_type = 'network') AS n_network
FROM best GROUP BY ALL""")
def q_edge_counts(spark, sf):
    return edges.edge_counts(edges.dedup_edges(_edges(spark, sf)[1]))


@query("graph_nodes", """WITH $REPOS, $EDGES,
n AS (SELECT project, regexp_replace(name, '[^a-zA-Z0-9]', '_', 'g') AS node_id, name AS label, api_type, 0 AS r FROM services
  UNION ALL SELECT project, regexp_replace("from", '[^a-zA-Z0-9]', '_', 'g'), "from", '', 1 FROM best
  UNION ALL SELECT project, regexp_replace("to", '[^a-zA-Z0-9]', '_', 'g'), "to", '', 1 FROM best)
SELECT project, node_id, label, api_type FROM n QUALIFY row_number() OVER (PARTITION BY project, node_id ORDER BY r, label, api_type) = 1""")
def q_graph_nodes(spark, sf):
    services, found = _edges(spark, sf)
    return edges.graph_nodes(services, edges.dedup_edges(found))


@query("graph_text", """WITH $REPOS, $EDGES
SELECT DISTINCT project, 0 AS part, '' AS sort_key, 'graph TD' AS line FROM services
UNION ALL SELECT project, 1, name, '  ' || translate(name, '-. ', '___') || CASE api_type WHEN 'http' THEN '[' || name || ' - HTTP]'
  WHEN 'grpc' THEN '{' || name || ' - gRPC}' ELSE '(' || name || ' - GraphQL)' END FROM services
UNION ALL SELECT project, 2, "from" || ' ' || "to" || ' ' || evidence_type, '  ' || translate("from", '-. ', '___') || ' -->|' ||
  CASE WHEN evidence_type <> 'network' THEN evidence_type WHEN contains(lower(evidence), 'grpc') THEN 'grpc' ELSE 'http' END || '| ' || translate("to", '-. ', '___') FROM best""")
def q_graph_text(spark, sf):
    services, found = _edges(spark, sf)
    return edges.graph_text(services, edges.dedup_edges(found))


# --- web pages: links and URL facts ------------------------------------------------------

@query("url_facts", r"""
WITH base AS (SELECT page_id, url, regexp_replace(url, '\.git$', '') AS bare FROM pages),
p AS (SELECT *, string_split(regexp_replace(bare, '^https://github\.com/', ''), '/') AS parts, string_split(bare, '/') AS segs FROM base)
SELECT page_id, url, starts_with(url, 'https://github.com/') AND len(url) - len(replace(url, '/', '')) >= 4 AS is_valid,
  CASE WHEN len(parts) >= 2 THEN parts[1] ELSE '' END AS owner, CASE WHEN len(parts) >= 2 THEN parts[2] ELSE '' END AS name,
  CASE WHEN starts_with(bare, 'git@github.com:') THEN 'https://github.com/' || bare[16:] || '.git'
       WHEN starts_with(bare, 'https://github.com/') THEN bare || '.git' ELSE bare END AS clone_url,
  CASE WHEN len(string_split(url, '@github.com/')) = 2 THEN 'https://***@github.com/' || split_part(url, '@github.com/', 2) ELSE url END AS masked_url,
  CASE WHEN starts_with(bare, 'https://github.com/') AND len(parts) >= 2 THEN parts[1] || '-' || parts[2]
       WHEN starts_with(bare, 'http') AND len(segs) >= 5 THEN replace(segs[3], '.', '-') || '-' || segs[4] || '-' || segs[5]
       WHEN starts_with(bare, 'http') AND len(segs) >= 3 THEN replace(segs[3], '.', '-')
       ELSE left(translate(bare, '/:.?&= ', '------_'), 50) END AS safe_key
FROM p""")
def q_url_facts(spark, sf):
    return sv.repo_url_facts(views.table(spark, sf, "pages").select("page_id", "url"), "url")


# Repository addresses in the forms that people paste, made from the host and number of a page.
_URL_FORMS = """CASE CAST(page_id % 6 AS INT)
  WHEN 0 THEN 'https://github.com/' || split_part(url, '/', 3) || '/repo-' || CAST(page_id AS STRING) || '.git'
  WHEN 1 THEN 'git@github.com:' || split_part(url, '/', 3) || '/repo-' || CAST(page_id AS STRING) || '.git'
  WHEN 2 THEN 'https://user:key@github.com/' || split_part(url, '/', 3) || '/repo-' || CAST(page_id AS STRING)
  WHEN 3 THEN 'https://github.com/' || split_part(url, '/', 3)
  WHEN 4 THEN 'https://github.com/' || split_part(url, '/', 3) || '/repo-' || CAST(page_id AS STRING) || '/tree/main'
  ELSE split_part(url, '/', 3) || '/a?b=c&d ' || CAST(page_id AS STRING) END"""


@query("url_forms", ORACLES["url_facts"].replace("FROM pages)", f"FROM (SELECT page_id, {_URL_FORMS} AS url FROM pages) pages)", 1))
def q_url_forms(spark, sf):
    pages = views.table(spark, sf, "pages").selectExpr("page_id", f"{_URL_FORMS} AS url")
    return sv.repo_url_facts(pages, "url")


@query("web_links", r"""
WITH w AS (SELECT page_id, lower(split_part(split_part(regexp_replace(url, '^[a-zA-Z]+://', ''), '/', 1), ':', 1)) AS host, html FROM pages),
l AS (SELECT page_id, host, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM w),
t AS (SELECT host, CASE WHEN regexp_matches(href, '^https?://') THEN lower(split_part(split_part(regexp_replace(href, '^https?://', ''), '/', 1), ':', 1)) ELSE host END AS target FROM l)
SELECT host AS "from", target AS "to", count(*) AS n_links FROM t GROUP BY ALL""")
def q_web_links(spark, sf):
    pages = views.web(spark, sf)
    links = pages.select(F.col("project").alias("from"), F.explode(F.regexp_extract_all("content", F.lit(r'href="([^"]+)"'), F.lit(1))).alias("href"))
    bare = F.regexp_replace("href", "^https?://", "")
    host = F.lower(F.substring_index(F.substring_index(bare, "/", 1), ":", 1))
    target = F.when(F.col("href").rlike("^https?://"), host).otherwise(F.col("from"))
    return links.groupBy("from", target.alias("to")).agg(F.count("*").alias("n_links"))
