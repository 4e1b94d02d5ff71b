"""Queries that fold DDL migrations into the live schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.functions import ddl as dx, fixed
from codestrata.operators import ddl, ddl_order, filters
from codestrata.plans.registry import define, literal, query
from codestrata.sources import views

_TYPE = " ".join(f"WHEN starts_with(upper(stmt), '{p}') THEN '{t}'" for p, t in fixed.STATEMENT_PREFIXES)
_Q = "'\"[]'"
_NAMES = "list_transform(string_split({0}, ','), lambda c: lower(trim(trim(c), " + _Q + ")))"
_ENUM = "'(?i)^create type ([^ ]+) as enum *[(]([^)]*)[)]'"
_MADE_VIEW, _GONE_VIEW = "'(?i)^create view ([^ ]+) as '", "'(?i)^drop view (?:if exists )?([^ ;]+)'"
_IDX = "'(?i)^create (unique )?index ([^ ]+) on ([^ (]+) *[(]([^)]*)[)]'"
_FK = r"'(?i)FOREIGN KEY\s*\(([^)]+)\)\s*REFERENCES\s+([^\s(]+)\s*\(([^)]+)\)'"
_DEF = "'(?i)default +(''[^'']*''|[^ ,]+)'"
_REF = r"'REFERENCES\s+([^\s(]+)\s*\(([^)]+)\)'"
_CHG = r"'(?i)(?:ALTER|MODIFY)\s+COLUMN\s+([^\s]+)\s+(.+)'"

# A type ends after its parameters, time zone and array bounds; blanks around parentheses and commas do not count.
_DATA_TYPE = (r"regexp_extract(d, '(?i)^\S+\s+((?:double\s+precision|(?:character|bit)\s+varying|[^\s(\[]+)(?:\s*\([^()]*\))?"
              r"(?:\s+with(?:out)?\s+time\s+zone)?(?:\s*\[\d*\])*)', 1)")
_DATA_TYPE = rf"lower(regexp_replace(regexp_replace({_DATA_TYPE}, '\s*([(\[,])\s*', '\1', 'g'), '\s+([)\]])', '\1', 'g'))"

# The oracle replays the log with windows: epochs count the drops of a table.
define("DDL", f"""
mig AS MATERIALIZED (SELECT project, path, content FROM facts WHERE ends_with(lpath, '.sql') AND contains(lower(parent), 'migration')),
raw AS (SELECT project, path, CAST(i - 1 AS INTEGER) AS stmt_no, string_split(content, ';')[i] AS raw
  FROM mig, LATERAL (SELECT unnest(range(1, len(string_split(content, ';')) + 1)) AS i) u),
cleaned AS (SELECT project, path, stmt_no, array_to_string(list_filter(list_transform(list_filter(
    list_transform(string_split(raw, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(13))),
    lambda l: l <> '' AND NOT starts_with(l, '--') AND NOT starts_with(l, '/*')),
    lambda l: CASE WHEN strpos(l, '--') > 0 THEN trim(split_part(l, '--', 1)) ELSE l END), lambda l: l <> ''), ' ') AS stmt FROM raw),
stm AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY project ORDER BY path, stmt_no) AS seq FROM (
  SELECT *, CASE {_TYPE} END AS type FROM cleaned WHERE stmt <> '') x),
named AS MATERIALIZED (SELECT *, CASE type
    WHEN 'CREATE_TABLE' THEN lower(regexp_extract(stmt, '(?i)CREATE TABLE\\s+(?:IF NOT EXISTS\\s+)?"?([^"\\s(]+)', 1))
    WHEN 'DROP_TABLE' THEN lower(regexp_extract(stmt, '(?i)DROP TABLE\\s+(?:IF EXISTS\\s+)?"?([^"\\s;]+)', 1))
    WHEN 'ALTER_TABLE' THEN lower(regexp_extract(stmt, '(?i)ALTER TABLE\\s+"?([^"\\s]+)', 1))
    WHEN 'CREATE_INDEX' THEN lower(regexp_extract(stmt, '(?i)INDEX\\s+[^\\s]+\\s+ON\\s+"?([^"\\s(]+)', 1)) ELSE '' END AS tbl FROM stm),
ddl_events AS (SELECT * FROM named WHERE type IS NOT NULL),
defs AS MATERIALIZED (
  SELECT project, seq, tbl, CAST(i - 1 AS INTEGER) AS def_no, trim(ds[i]) AS d FROM (
    SELECT project, seq, tbl, list_filter(regexp_extract_all(regexp_extract(stmt, '(?i)CREATE TABLE[^(]*\\(\\s*(.*)\\s*\\)', 1), '(?:[^,()]+|\\((?:[^()]+|\\([^()]*\\))*\\))+', 0), lambda d: trim(d) <> '') AS ds
    FROM ddl_events WHERE type = 'CREATE_TABLE') x, LATERAL (SELECT unnest(range(1, len(ds) + 1)) AS i) u),
badcreate AS (
  SELECT project, seq FROM ddl_events WHERE type = 'CREATE_TABLE' AND NOT regexp_matches(stmt, '(?i)CREATE TABLE[^(]*\\(\\s*(.*)\\s*\\)')
  UNION SELECT project, seq FROM defs WHERE NOT regexp_matches(upper(d), '^(PRIMARY KEY|FOREIGN KEY|CONSTRAINT|UNIQUE)') AND NOT regexp_matches(d, '^\\S+\\s+\\S')),
tev AS MATERIALIZED (
  SELECT e.*, sum(CASE WHEN type = 'DROP_TABLE' THEN 1 ELSE 0 END) OVER (PARTITION BY project, tbl ORDER BY seq) AS epoch
  FROM ddl_events e WHERE type IN ('CREATE_TABLE', 'ALTER_TABLE', 'DROP_TABLE') AND tbl <> ''
    AND NOT EXISTS (SELECT 1 FROM badcreate b WHERE b.project = e.project AND b.seq = e.seq)),
lastep AS (SELECT project, tbl, max(epoch) AS epoch FROM tev GROUP BY ALL),
cur AS (SELECT t.*, row_number() OVER (PARTITION BY t.project, t.tbl ORDER BY seq) AS pos FROM tev t
  JOIN lastep l ON l.project = t.project AND l.tbl = t.tbl AND l.epoch = t.epoch WHERE type <> 'DROP_TABLE'),
live AS MATERIALIZED (SELECT project, tbl, seq AS first_seq, path AS since_path, type AS first_type FROM cur WHERE pos = 1),
eff AS MATERIALIZED (SELECT * FROM cur WHERE type = 'ALTER_TABLE' OR pos = 1),
coldefs AS (
  SELECT e.project, e.tbl, e.seq, d.def_no, d.d FROM eff e JOIN defs d ON d.project = e.project AND d.seq = e.seq
  WHERE e.type = 'CREATE_TABLE' AND NOT regexp_matches(upper(d.d), '^(PRIMARY KEY|FOREIGN KEY|CONSTRAINT|UNIQUE)')
  UNION ALL
  SELECT project, tbl, seq, 0, regexp_extract(stmt, '(?i)\\bADD\\s+(?:COLUMN\\s+)?(.+)', 1) FROM eff
  WHERE type = 'ALTER_TABLE' AND contains(upper(stmt), 'ADD ') AND NOT contains(upper(stmt), 'ADD CONSTRAINT')),
cols0 AS MATERIALIZED (SELECT project, tbl, seq, def_no, d, lower(trim(string_split_regex(d, '\\s+')[1], {_Q})) AS col, {_DATA_TYPE} AS type,
    NOT (contains(upper(d), 'NOT NULL') OR contains(upper(d), 'PRIMARY KEY')) AS nullable, nullif(regexp_extract(d, {_DEF}, 1), '') AS dflt
  FROM coldefs WHERE regexp_matches(d, '^\\S+\\s+\\S')),
keydefs AS (
  SELECT e.project, e.tbl, e.seq, d.def_no, d.d, CASE WHEN starts_with(upper(d.d), 'PRIMARY KEY') THEN 'PK' WHEN starts_with(upper(d.d), 'UNIQUE') THEN 'UNIQUE' ELSE 'FK' END AS op
  FROM eff e JOIN defs d ON d.project = e.project AND d.seq = e.seq
  WHERE e.type = 'CREATE_TABLE' AND regexp_matches(upper(d.d), '^(PRIMARY KEY|FOREIGN KEY|CONSTRAINT|UNIQUE)')
  UNION ALL
  SELECT project, tbl, seq, 0, stmt, CASE WHEN contains(upper(stmt), 'PRIMARY KEY') THEN 'PK' WHEN contains(upper(stmt), 'FOREIGN KEY') THEN 'FK' ELSE 'UNIQUE' END
  FROM eff WHERE type = 'ALTER_TABLE' AND contains(upper(stmt), 'ADD CONSTRAINT')),
keyf AS MATERIALIZED (
  SELECT project, tbl, seq, def_no, op, {_NAMES.format("regexp_extract(d, CASE op WHEN 'PK' THEN '(?i)PRIMARY KEY\\s*\\(([^)]+)\\)' ELSE '(?i)UNIQUE\\s*\\(([^)]+)\\)' END, 1)")} AS cols
  FROM keydefs WHERE op IN ('PK', 'UNIQUE') AND regexp_matches(d, '(?i)(PRIMARY KEY|UNIQUE)\\s*\\(([^)]+)\\)')
  UNION ALL SELECT project, tbl, seq, def_no, 'PK', [col] FROM cols0 WHERE contains(upper(d), 'PRIMARY KEY')
  UNION ALL SELECT project, tbl, seq, def_no, 'UNIQUE', [col] FROM cols0 WHERE contains(upper(d), 'UNIQUE')),
fkeys AS MATERIALIZED (
  SELECT project, tbl, seq, def_no, {_NAMES.format(f"regexp_extract(d, {_FK}, 1)")} AS cols, lower(trim(regexp_extract(d, {_FK}, 2), {_Q})) AS ref_tbl,
    {_NAMES.format(f"regexp_extract(d, {_FK}, 3)")} AS ref_cols FROM keydefs WHERE op = 'FK' AND regexp_matches(d, {_FK})
  UNION ALL
  SELECT project, tbl, seq, def_no, [col], lower(trim(regexp_extract(upper(d), {_REF}, 1), {_Q})), [lower(trim(regexp_extract(upper(d), {_REF}, 2), {_Q}))]
  FROM cols0 WHERE regexp_matches(upper(d), {_REF})),
dropc AS MATERIALIZED (SELECT project, tbl, seq, lower(trim(regexp_extract(stmt, '(?i)DROP\\s+COLUMN\\s+([^\\s,]+)', 1), {_Q})) AS col FROM eff
  WHERE type = 'ALTER_TABLE' AND NOT contains(upper(stmt), 'ADD ') AND contains(upper(stmt), 'DROP COLUMN')),
setc AS (SELECT project, tbl, seq, lower(trim(regexp_extract(stmt, {_CHG}, 1), {_Q})) AS col,
    nullif(lower(regexp_extract(regexp_extract(stmt, {_CHG}, 2), '(?i)^(?:SET\\s+DATA\\s+)?TYPE\\s+([^\\s]+)', 1)), '') AS type
  FROM eff WHERE type = 'ALTER_TABLE' AND NOT contains(upper(stmt), 'ADD ') AND NOT contains(upper(stmt), 'DROP COLUMN')
    AND (contains(upper(stmt), 'ALTER COLUMN') OR contains(upper(stmt), 'MODIFY COLUMN'))),
lastadd AS (SELECT * FROM cols0 QUALIFY row_number() OVER (PARTITION BY project, tbl, col ORDER BY seq DESC, def_no DESC) = 1),
lastdrop AS (SELECT project, tbl, col, max(seq) AS dseq FROM dropc GROUP BY ALL),
columns AS MATERIALIZED (
  SELECT a.project, a.tbl, a.col, coalesce((SELECT arg_max(s.type, s.seq) FROM setc s WHERE s.project = a.project AND s.tbl = a.tbl AND s.col = a.col AND s.seq > a.seq AND s.type IS NOT NULL), a.type) AS type,
    a.nullable, a.dflt AS "default",
    EXISTS (SELECT 1 FROM keyf k WHERE k.op = 'PK' AND k.project = a.project AND k.tbl = a.tbl AND list_contains(k.cols, a.col) AND k.seq > coalesce(d.dseq, 0)) AS is_pk
  FROM lastadd a LEFT JOIN lastdrop d ON d.project = a.project AND d.tbl = a.tbl AND d.col = a.col WHERE d.dseq IS NULL OR a.seq > d.dseq),
keycols AS (
  SELECT k.project, k.tbl, k.op AS kind, CASE WHEN op = 'UNIQUE' THEN k.seq * 1000 + k.def_no ELSE 0 END AS g, c.col
  FROM keyf k, LATERAL (SELECT unnest(k.cols) AS col) c
  WHERE NOT EXISTS (SELECT 1 FROM dropc d WHERE d.project = k.project AND d.tbl = k.tbl AND d.col = c.col AND d.seq > k.seq)),
keysets AS MATERIALIZED (SELECT project, tbl, kind, list_sort(list(DISTINCT col)) AS cols FROM keycols GROUP BY project, tbl, kind, g),
fkcols AS (SELECT f.project, f.tbl, c.col, arg_max(f.ref_tbl, f.seq * 1000 + f.def_no) AS ref_tbl, arg_max(f.ref_cols[1], f.seq * 1000 + f.def_no) AS ref_col
  FROM fkeys f, LATERAL (SELECT unnest(f.cols) AS col) c GROUP BY ALL),
annotated AS MATERIALIZED (
  SELECT c.*, EXISTS (SELECT 1 FROM keysets k WHERE k.kind = 'UNIQUE' AND len(k.cols) = 1 AND k.project = c.project AND k.tbl = c.tbl AND k.cols[1] = c.col) AS is_unique,
    f.col IS NOT NULL AS is_fk, f.ref_tbl, f.ref_col
  FROM columns c LEFT JOIN fkcols f ON f.project = c.project AND f.tbl = c.tbl AND f.col = c.col),
enums AS (SELECT project, lower(trim(regexp_extract(stmt, {_ENUM}, 1), {_Q})) AS name, arg_max(
    list_transform(string_split(regexp_extract(stmt, {_ENUM}, 2), ','), lambda v: trim(trim(v), '''"[]')), seq) AS vals
  FROM ddl_events WHERE type = 'CREATE_TYPE' AND regexp_matches(stmt, {_ENUM}) GROUP BY 1, 2),
viewev AS (SELECT project, seq, type, stmt, lower(trim(CASE type WHEN 'CREATE_VIEW' THEN regexp_extract(stmt, {_MADE_VIEW}, 1) ELSE regexp_extract(stmt, {_GONE_VIEW}, 1) END, {_Q})) AS name
  FROM ddl_events WHERE type IN ('CREATE_VIEW', 'DROP_VIEW')),
liveviews AS (SELECT project, name, stmt AS sql FROM viewev WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY project, name ORDER BY seq DESC) = 1 AND type = 'CREATE_VIEW'),
idx AS (SELECT e.project, lower(trim(regexp_extract(stmt, {_IDX}, 3), {_Q})) AS tbl, lower(trim(regexp_extract(stmt, {_IDX}, 2), {_Q})) AS name,
    regexp_extract(stmt, {_IDX}, 1) <> '' AS is_unique, {_NAMES.format(f"regexp_extract(stmt, {_IDX}, 4)")} AS cols, seq
  FROM ddl_events e WHERE type = 'CREATE_INDEX' AND regexp_matches(stmt, {_IDX})),
liveidx AS (SELECT i.* FROM idx i JOIN live l ON l.project = i.project AND l.tbl = i.tbl AND i.seq > l.first_seq
  QUALIFY row_number() OVER (PARTITION BY i.project, i.tbl, i.name ORDER BY i.seq DESC) = 1)""")


def _schema(spark, sf) -> ddl.Schema:
    return ddl.Schema(views.repos(spark, sf), persist=True)


@query("migration_files", """WITH $REPOS
SELECT project, path, CASE WHEN regexp_extract(base, '^(\\d+)', 1) <> '' THEN regexp_extract(base, '^(\\d+)', 1) ELSE base END AS version
FROM facts WHERE ends_with(lpath, '.sql') AND contains(lower(parent), 'migration')""")
def q_migrations(spark, sf):
    return filters.migration_files(views.repos(spark, sf)).select("project", "path", dx.migration_version("path").alias("version"))


@query("ddl_events", "WITH $REPOS, $DDL SELECT project, path, stmt_no, type, tbl, stmt FROM ddl_events")
def q_events(spark, sf):
    return ddl.ddl_events(views.repos(spark, sf))


@query("ddl_errors", """WITH $REPOS, $DDL
SELECT n.project, count(*) AS n_statements, count(*) FILTER (type IS NULL) AS n_unsupported, count(b.seq) AS n_failed
FROM named n LEFT JOIN badcreate b ON b.project = n.project AND b.seq = n.seq GROUP BY n.project""")
def q_errors(spark, sf):
    return ddl.ddl_errors(views.repos(spark, sf))


@query("ddl_live_tables", """WITH $REPOS, $DDL
SELECT project, tbl, since_path, CASE first_type WHEN 'CREATE_TABLE' THEN 'create' ELSE 'alter' END AS origin FROM live""")
def q_tables(spark, sf):
    return _schema(spark, sf).tables


@query("ddl_columns", 'WITH $REPOS, $DDL SELECT project, tbl, col, type, nullable, "default", is_pk FROM columns')
def q_columns(spark, sf):
    return _schema(spark, sf).columns


@query("ddl_keys", "WITH $REPOS, $DDL SELECT project, tbl, kind, array_to_string(cols, ',') AS cols FROM keysets")
def q_keys(spark, sf):
    return _schema(spark, sf).keys.select("project", "tbl", "kind", F.array_join("cols", ",").alias("cols"))


@query("ddl_fks", """WITH $REPOS, $DDL
SELECT project, tbl, 'fk_' || tbl || '_' || array_to_string(cols, '_') AS name, array_to_string(cols, ',') AS cols, ref_tbl, array_to_string(ref_cols, ',') AS ref_cols FROM fkeys""")
def q_fks(spark, sf):
    return _schema(spark, sf).fks.select("project", "tbl", "name", F.array_join("cols", ",").alias("cols"), "ref_tbl",
                                         F.array_join("ref_cols", ",").alias("ref_cols"))


@query("ddl_enums_views", """WITH $REPOS, $DDL
SELECT project, 'enum' AS kind, name, array_to_string(vals, ',') AS body FROM enums UNION ALL SELECT project, 'view', name, sql FROM liveviews""")
def q_enums_views(spark, sf):
    s = _schema(spark, sf)
    return (s.enums.select("project", F.lit("enum").alias("kind"), "name", F.array_join("vals", ",").alias("body"))
            .unionByName(s.views.select("project", F.lit("view").alias("kind"), "name", F.col("sql").alias("body"))))


@query("ddl_indexes", "WITH $REPOS, $DDL SELECT project, tbl, name, is_unique, array_to_string(cols, ',') AS cols FROM liveidx")
def q_indexes(spark, sf):
    return _schema(spark, sf).indexes.withColumn("cols", F.array_join("cols", ","))


define("ERDCOLS", """erdcols AS (SELECT project, tbl, col, type, array_to_string(list_filter([CASE WHEN is_pk THEN 'PK' END, CASE WHEN is_unique THEN 'UK' END,
   CASE WHEN is_fk THEN 'FK' END], lambda x: x IS NOT NULL), ',') AS annotation FROM annotated),
erdlinks AS (SELECT DISTINCT project, ref_tbl AS parent_tbl, tbl AS child_tbl, cols[1] || ' -> ' || ref_tbl || '.' || ref_cols[1] AS label FROM fkeys WHERE len(cols) = 1 AND len(ref_cols) = 1)""")


@query("erd_columns", "WITH $REPOS, $DDL, $ERDCOLS SELECT * FROM erdcols")
def q_erd_columns(spark, sf):
    return ddl.erd_columns(_schema(spark, sf))


@query("erd_edges", "WITH $REPOS, $DDL, $ERDCOLS SELECT * FROM erdlinks")
def q_erd_edges(spark, sf):
    return ddl.erd_edges(_schema(spark, sf))


@query("erd_text", """WITH $REPOS, $DDL, $ERDCOLS
SELECT DISTINCT project, 0 AS part, '' AS tbl, 0 AS rank, '' AS sort_key, 'erDiagram' AS line FROM live
UNION ALL SELECT project, 1, tbl, 0, '', '  ' || tbl || ' {' FROM live
UNION ALL SELECT project, 1, tbl, 1, col, '    ' || type || ' ' || col || CASE WHEN annotation <> '' THEN ' ' || annotation ELSE '' END FROM erdcols
UNION ALL SELECT project, 1, tbl, 2, '', '  }' FROM live
UNION ALL SELECT project, 2, child_tbl, 0, label, '  ' || parent_tbl || ' ||--o{ ' || child_tbl || ' : "' || label || '"' FROM erdlinks""")
def q_erd_text(spark, sf):
    return ddl.erd_text(_schema(spark, sf))


@query("column_constraints", """WITH $REPOS, $DDL
SELECT project, tbl, col, type, array_to_string(list_filter([CASE WHEN NOT nullable THEN 'not null' END, CASE WHEN "default" IS NOT NULL THEN 'default' END,
   CASE WHEN is_pk THEN 'PK' END, CASE WHEN is_unique THEN 'unique' END, CASE WHEN is_fk THEN 'FK' END], lambda x: x IS NOT NULL), ',') AS constraints,
   coalesce("default", '') AS default_value, CASE WHEN is_fk THEN ref_tbl || '.' || ref_col ELSE '' END AS reference FROM annotated""")
def q_constraints(spark, sf):
    return ddl.column_constraints(_schema(spark, sf))


define("SCHEMACOUNTS", """schemacounts AS (
SELECT p.project, (SELECT count(*) FROM live x WHERE x.project = p.project) AS n_tables, (SELECT count(*) FROM annotated x WHERE x.project = p.project) AS n_columns,
  (SELECT count(*) FROM annotated x WHERE x.project = p.project AND is_fk) AS n_references, (SELECT count(*) FROM enums x WHERE x.project = p.project) AS n_enums,
  (SELECT count(*) FROM liveviews x WHERE x.project = p.project) AS n_views, (SELECT count(*) FROM liveidx x WHERE x.project = p.project) AS n_indexes
FROM (SELECT DISTINCT project FROM files) p)""")


@query("schema_counts", "WITH $REPOS, $DDL, $SCHEMACOUNTS SELECT * FROM schemacounts")
def q_counts(spark, sf):
    files = views.repos(spark, sf)
    return ddl.schema_counts(ddl.Schema(files, persist=True), files)


define("IMPLICIT", """
stems AS (SELECT project, tbl, col, regexp_extract(col, '^(.+)_id$', 1) AS stem FROM columns WHERE regexp_matches(col, '^(.+)_id$')),
guesses AS (SELECT *, 0 AS r, stem AS target FROM stems UNION ALL SELECT *, 1, stem || 's' FROM stems UNION ALL SELECT *, 2, stem || 'es' FROM stems
  UNION ALL SELECT *, 3, stem[:-2] || 'ies' FROM stems WHERE ends_with(stem, 'y') UNION ALL SELECT *, 4, tbl FROM stems WHERE stem = 'parent'),
implied AS MATERIALIZED (
  SELECT g.project, g.tbl, g.col, arg_min(g.target, g.r) AS target FROM guesses g JOIN live l ON l.project = g.project AND l.tbl = g.target GROUP BY g.project, g.tbl, g.col),
implicit AS (SELECT project, tbl, col, target, CASE WHEN target = tbl THEN 'self' ELSE 'reference' END AS kind FROM implied i
  WHERE NOT EXISTS (SELECT 1 FROM fkeys f WHERE f.project = i.project AND f.tbl = i.tbl AND list_contains(f.cols, i.col) AND f.ref_tbl = i.target)),
allrefs AS (SELECT DISTINCT project, tbl, cols[1] AS col, ref_tbl AS target, 'foreign key' AS kind FROM fkeys WHERE len(cols) = 1 UNION ALL SELECT * FROM implicit)""")


@query("implicit_refs", "WITH $REPOS, $DDL, $IMPLICIT SELECT * FROM implicit")
def q_implicit(spark, sf):
    return ddl.implicit_refs(_schema(spark, sf))


@query("junction_tables", """WITH $REPOS, $DDL, $IMPLICIT
SELECT project, tbl, count(DISTINCT target) AS n_targets FROM allrefs WHERE target <> tbl GROUP BY ALL HAVING count(DISTINCT target) >= 2""")
def q_junction(spark, sf):
    return ddl.junction_tables(_schema(spark, sf))


# Longest path over the foreign keys of tables that no cycle or unknown table blocks.
define("ORDER", """
dep AS MATERIALIZED (SELECT DISTINCT project, tbl, ref_tbl FROM fkeys WHERE ref_tbl <> tbl),
reach AS (SELECT project, tbl, ref_tbl FROM dep UNION SELECT r.project, r.tbl, d.ref_tbl FROM reach r JOIN dep d ON d.project = r.project AND d.tbl = r.ref_tbl),
blocked AS MATERIALIZED (
  SELECT DISTINCT project, tbl FROM (
    SELECT r.project, r.tbl FROM reach r WHERE r.ref_tbl = r.tbl
    UNION SELECT r.project, r.tbl FROM reach r JOIN reach c ON c.project = r.project AND c.tbl = r.ref_tbl AND c.ref_tbl = c.tbl
    UNION SELECT r.project, r.tbl FROM reach r WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.project = r.project AND l.tbl = r.ref_tbl)) x),
okdep AS MATERIALIZED (SELECT d.* FROM dep d WHERE NOT EXISTS (SELECT 1 FROM blocked b WHERE b.project = d.project AND b.tbl = d.tbl)),
steps AS (
  SELECT l.project, l.tbl, 1 AS r FROM live l WHERE NOT EXISTS (SELECT 1 FROM dep d WHERE d.project = l.project AND d.tbl = l.tbl)
  UNION SELECT o.project, o.tbl, s.r + CASE WHEN o.ref_tbl > o.tbl THEN 1 ELSE 0 END FROM steps s JOIN okdep o ON o.project = s.project AND o.ref_tbl = s.tbl),
ordered_tables AS MATERIALIZED (
  SELECT l.project, l.tbl, (SELECT max(r) FROM steps s WHERE s.project = l.project AND s.tbl = l.tbl) AS round FROM live l)""")


@query("ddl_order", "WITH RECURSIVE $REPOS, $DDL, $ORDER SELECT * FROM ordered_tables")
def q_order(spark, sf):
    s = _schema(spark, sf)
    return ddl_order.table_order(s.tables, s.fks)


@query("ddl_script", """WITH RECURSIVE $REPOS, $DDL, $ORDER,
bodyl AS (
  SELECT project, tbl, 0 AS r, '    ' || col || ' ' || type || CASE WHEN nullable THEN '' ELSE ' NOT NULL' END || coalesce(' DEFAULT ' || "default", '') AS t FROM columns
  UNION ALL SELECT project, tbl, CASE kind WHEN 'PK' THEN 1 ELSE 2 END, CASE kind WHEN 'PK' THEN '    PRIMARY KEY (' ELSE '    UNIQUE (' END || array_to_string(cols, ', ') || ')' FROM keysets
  UNION ALL SELECT project, tbl, 3, '    CONSTRAINT fk_' || tbl || '_' || array_to_string(cols, '_') || ' FOREIGN KEY (' || array_to_string(cols, ', ') || ') REFERENCES ' || ref_tbl || ' (' || array_to_string(ref_cols, ', ') || ')' FROM fkeys),
bodies AS (SELECT project, tbl, string_agg(t, ',' || chr(10) ORDER BY r, t) AS b FROM bodyl GROUP BY ALL)
SELECT project, 1 AS section, CAST(NULL AS INTEGER) AS round, name, 'CREATE TYPE ' || name || ' AS ENUM (' || chr(10) ||
   array_to_string(list_transform(vals, lambda v: '    ''' || v || ''''), ',' || chr(10)) || chr(10) || ');' AS statement FROM enums
UNION ALL SELECT o.project, 2, o.round, o.tbl, 'CREATE TABLE ' || o.tbl || ' (' || chr(10) || coalesce(b.b, '') || chr(10) || ');'
  FROM ordered_tables o LEFT JOIN bodies b ON b.project = o.project AND b.tbl = o.tbl
UNION ALL SELECT project, 3, NULL, name, 'CREATE ' || CASE WHEN is_unique THEN 'UNIQUE ' ELSE '' END || 'INDEX ' || name || ' ON ' || tbl || ' (' || array_to_string(cols, ', ') || ');' FROM liveidx
UNION ALL SELECT project, 4, NULL, name, sql || ';' FROM liveviews""")
def q_script(spark, sf):
    return ddl_order.ddl_script(_schema(spark, sf))
