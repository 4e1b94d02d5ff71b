"""Queries over files: statistics, filters, redaction, chunks and the result cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.functions import fixed, text
from codestrata.operators import filters, ignore, stats
from codestrata.plans.registry import define, has_any, literal, query, sql_list
from codestrata.session import cut_lineage
from codestrata.sources import views


@query("file_stats", """WITH $CORPUS
SELECT project, count(*) AS total_files, CAST(sum(size) AS BIGINT) AS total_bytes,
       round(sum(size) / 1048576.0, 6) AS total_size_mb
FROM facts GROUP BY project""")
def q_file_stats(spark, sf):
    return stats.file_stats(views.corpus(spark, sf))


@query("ext_histogram", """WITH $REPOS
SELECT project, ext, count(*) AS n_files FROM facts GROUP BY project, ext""")
def q_ext_histogram(spark, sf):
    return stats.ext_histogram(views.repos(spark, sf))


@query("folder_count", """WITH $REPOS,
dirs AS (SELECT DISTINCT project, array_to_string(list_slice(string_split(path, '/'), 1, i), '/') AS dir
         FROM files, LATERAL (SELECT unnest(range(1, len(string_split(path, '/')))) AS i) u)
SELECT project, count(*) AS n_folders FROM dirs GROUP BY project""")
def q_folder_count(spark, sf):
    return stats.folder_count(views.repos(spark, sf))


@query("file_facts", """WITH $REPOS
SELECT project, path, size, ext, base, parent, CAST(len(path) - len(replace(path, '/', '')) AS INTEGER) AS depth FROM facts""")
def q_file_facts(spark, sf):
    return filters.file_facts(views.repos(spark, sf)).drop("content")


# --- ignore rules --------------------------------------------------------------

_GLOB = "replace(replace(replace(regexp_replace(b, '([.^$*+?{}\\[\\]\\\\|()])', '\\\\\\1', 'g'), '\\*\\*', '.*'), '\\*', '[^/]*'), '\\?', '.')"
define("IGNORE_CTES", f"""
lines AS (
  SELECT project, CAST(i AS INTEGER) AS rule_no, trim(string_split(content, chr(10))[i], ' ' || chr(9) || chr(13)) AS line
  FROM files, LATERAL (SELECT unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i) u
  WHERE path = '.gitignore'),
own1 AS (SELECT project, rule_no, line LIKE '!%' AS negate, CASE WHEN line LIKE '!%' THEN line[2:] ELSE line END AS l
         FROM lines WHERE line <> '' AND NOT starts_with(line, '#')),
own2 AS (SELECT *, l LIKE '%/' AS dir_only, CASE WHEN l LIKE '%/' THEN l[:-2] ELSE l END AS m FROM own1),
own3 AS (SELECT *, m LIKE '/%' AS absolute, CASE WHEN m LIKE '/%' THEN m[2:] ELSE m END AS b FROM own2),
own_rules AS (SELECT project, rule_no, '^' || {_GLOB} || '$' AS regex, negate, dir_only, absolute FROM own3),
default_rules AS (
  SELECT -1000 + row_number() OVER () AS rule_no, '^' || {_GLOB} || '$' AS regex, d AS dir_only
  FROM (SELECT CASE WHEN r LIKE '%/' THEN r[:-2] ELSE r END AS b, r LIKE '%/' AS d
        FROM (VALUES {", ".join("(" + literal(r) + ")" for r in fixed.DEFAULT_IGNORE)}) t(r))),
nodes AS (
  SELECT DISTINCT project, path AS node, false AS is_dir FROM files
  UNION
  SELECT DISTINCT project, array_to_string(list_slice(string_split(path, '/'), 1, i), '/'), true
  FROM files, LATERAL (SELECT unnest(range(1, len(string_split(path, '/')))) AS i) u),
hits AS (
  SELECT n.project, n.node, n.is_dir, r.rule_no, false AS negate
  FROM nodes n JOIN default_rules r ON (n.is_dir OR NOT r.dir_only)
   AND (regexp_matches(regexp_extract(n.node, '[^/]*$'), r.regex) OR regexp_matches(n.node, r.regex))
  UNION ALL
  SELECT n.project, n.node, n.is_dir, r.rule_no, r.negate
  FROM nodes n JOIN own_rules r ON n.project = r.project AND (n.is_dir OR NOT r.dir_only)
   AND ((NOT r.absolute AND regexp_matches(regexp_extract(n.node, '[^/]*$'), r.regex)) OR regexp_matches(n.node, r.regex))),
verdicts AS (SELECT project, node, is_dir, NOT arg_max(negate, rule_no) AS ignored FROM hits GROUP BY ALL),
marks AS (
  SELECT f.project, f.path, coalesce(v.ignored, false) AS file_ignored,
    EXISTS (SELECT 1 FROM verdicts d WHERE d.project = f.project AND d.is_dir AND d.ignored
            AND starts_with(f.path, d.node || '/')) AS tree_ignored
  FROM files f LEFT JOIN verdicts v ON v.project = f.project AND v.node = f.path AND NOT v.is_dir)""")


@query("ignore_rules", """WITH $REPOS, $IGNORE_CTES
SELECT project, rule_no, regex, negate, dir_only, absolute FROM own_rules""")
def q_ignore_rules(spark, sf):
    return ignore.ignore_rules(views.repos(spark, sf)).drop("literal", "kind")


@query("ignore_last_match", """WITH $REPOS, $IGNORE_CTES
SELECT project, path, file_ignored, tree_ignored FROM marks""")
def q_ignore_last_match(spark, sf):
    files = views.repos(spark, sf)
    return ignore.with_ignored(files, ignore.parse_ignore(files)).drop("content")


@query("ignore_filter", """WITH $REPOS, $IGNORE_CTES
SELECT project, path FROM marks WHERE NOT file_ignored AND NOT tree_ignored""")
def q_ignore_filter(spark, sf):
    files = views.repos(spark, sf)
    return ignore.apply_ignore(files, cut_lineage(ignore.parse_ignore(files))).select("project", "path")


define("PRUNED", "(parent <> '.' AND (" + has_any("lower(parent)", fixed.PRUNED_DIRS)
       + f" OR len(parent) - len(replace(parent, '/', '')) > {fixed.MAX_DEPTH}))")
define("NOISE", "(" + has_any("lbase", fixed.NOISE_NAMES)
       + " OR (ends_with(lpath, '.sql') AND contains(lpath, 'seed'))"
       + " OR (ends_with(lpath, '.json') AND contains(lpath, 'fixture')) OR "
       + " OR ".join(f"ends_with(lpath, '{s}')" for s in fixed.NOISE_SUFFIXES) + ")")
define("SECRET_FILE", "(" + " OR ".join(
    f"ends_with(base, {literal(g[1:])})" if g.startswith("*") else f"base = {literal(g)}"
    for g in fixed.SECRET_FILE_GLOBS) + ")")


@query("prune_dirs", "WITH $REPOS SELECT project, path FROM facts WHERE NOT $PRUNED")
def q_prune_dirs(spark, sf):
    return filters.prune_dirs(views.repos(spark, sf)).select("project", "path")


@query("noise_filter", "WITH $REPOS SELECT project, path FROM facts WHERE NOT $NOISE")
def q_noise_filter(spark, sf):
    return filters.drop_noise(views.repos(spark, sf)).select("project", "path")


@query("supported_files", f"""WITH $REPOS
SELECT project, path FROM facts
WHERE ext IN {sql_list(fixed.SUPPORTED_EXTS)} AND NOT $SECRET_FILE AND size <= {fixed.MAX_FILE_MB} * 1048576""")
def q_supported_files(spark, sf):
    files = filters.supported(filters.skip_secret_files(views.repos(spark, sf)))
    return filters.size_cap(files).select("project", "path")


define("REDACTED", """array_to_string(list_transform(string_split(content, chr(10)), lambda l:
  CASE WHEN contains(lower(l), 'api_key') OR contains(lower(l), 'password') OR contains(lower(l), 'secret') OR contains(lower(l), 'token')
       THEN CASE WHEN strpos(l, ':') > 0 THEN split_part(l, ':', 1) || ': [REDACTED]'
                 WHEN strpos(l, '=') > 0 THEN split_part(l, '=', 1) || '=[REDACTED]' ELSE l END
       ELSE l END), chr(10))""")


INTAKE_EXTS = fixed.SUPPORTED_EXTS + fixed.INTAKE_EXTS


def crawl(files, own_rules: bool = True, exts=INTAKE_EXTS, names=fixed.INTAKE_NAMES, mb=fixed.MAX_FILE_MB,
          max_depth=fixed.MAX_DEPTH, secret_globs=fixed.SECRET_FILE_GLOBS, redact: bool = True):
    """The whole intake: ignore rules, pruning, noise, size, extension and secret filters, redaction.

    None switches a limit off: ``exts``, ``mb`` (megabytes of a file) and ``max_depth``. The
    intake is meant for text facts; configuration is read from the files as they are, see ``overview.analyze``.
    The parsed rules are written first, so that their size is known to the join.
    """
    rules = cut_lineage(ignore.parse_ignore(files)) if own_rules else None
    kept = filters.supported(filters.drop_noise(filters.prune_dirs(files, max_depth=max_depth)), exts, names)
    if secret_globs:
        kept = filters.skip_secret_files(kept, secret_globs)
    kept = filters.size_cap(ignore.apply_ignore(kept, rules), mb)
    return filters.redact(kept) if redact else kept


define("INTAKE", f"""intake AS MATERIALIZED (
SELECT f.*, $REDACTED AS redacted FROM marks m JOIN facts f ON f.project = m.project AND f.path = m.path
WHERE NOT file_ignored AND NOT tree_ignored AND NOT $PRUNED AND NOT $NOISE AND NOT $SECRET_FILE
  AND (ext IN {sql_list(INTAKE_EXTS)} OR lbase IN {sql_list(fixed.INTAKE_NAMES)}) AND size <= {fixed.MAX_FILE_MB} * 1048576)""")


@query("crawl", "WITH $REPOS, $IGNORE_CTES, $INTAKE SELECT project, path, redacted AS content FROM intake")
def q_crawl(spark, sf):
    return crawl(views.repos(spark, sf)).select("project", "path", "content")


# --- redaction, selections --------------------------------------------------------

@query("redact_lines", "WITH $CORPUS SELECT project, path, $REDACTED AS content FROM files")
def q_redact(spark, sf):
    return filters.redact(views.corpus(spark, sf))


@query("redact_repos", "WITH $REPOS SELECT project, path, $REDACTED AS content FROM files")
def q_redact_repos(spark, sf):
    return filters.redact(views.repos(spark, sf))


@query("important_files", f"""WITH $REPOS
SELECT project, path, CASE WHEN len(content) > {fixed.IMPORTANT_CHARS}
  THEN left(content, {fixed.IMPORTANT_CHARS}) || '...' ELSE content END AS content
FROM facts WHERE {has_any('lpath', fixed.IMPORTANT_TOKENS)}""")
def q_important(spark, sf):
    return filters.important_files(views.repos(spark, sf), fixed.IMPORTANT_CHARS)


@query("important_files_whole", f"""WITH $REPOS
SELECT project, path, content FROM facts WHERE {has_any('lpath', fixed.IMPORTANT_TOKENS)}""")
def q_important_whole(spark, sf):
    return filters.important_files(views.repos(spark, sf))


@query("key_files_top8", f"""WITH $REPOS
SELECT project, path, CAST(row_number() OVER (PARTITION BY project ORDER BY path) AS INTEGER) AS rank
FROM facts WHERE {has_any('lpath', fixed.KEY_FILE_TOKENS)}
QUALIFY rank <= {fixed.KEY_FILE_LIMIT}""")
def q_key_files(spark, sf):
    return stats.key_files(views.repos(spark, sf))


@query("file_roles", f"""WITH $REPOS
SELECT project, path,
  ({" OR ".join(f"ends_with(path, '{e}')" for e in fixed.CODE_EXTS)}) AS is_code,
  ({" OR ".join(f"ends_with(lbase, '{e}')" for e in fixed.CONFIG_NAMES)}) AS is_config,
  (ends_with(lbase, '.yaml') OR ends_with(lbase, '.yml')) AND contains(content, 'apiVersion:')
    AND {has_any('content', fixed.K8S_KINDS)} AS is_manifest
FROM facts""")
def q_file_roles(spark, sf):
    return filters.file_roles(views.repos(spark, sf)).drop("content")


@query("detection_files", f"""WITH $REPOS
SELECT project, path, CASE WHEN lbase IN {sql_list(fixed.DETECTION_MANIFESTS)} THEN content END AS content
FROM facts WHERE NOT {has_any('path', fixed.DETECTION_IGNORE)}""")
def q_detection_files(spark, sf):
    return filters.detection_files(views.repos(spark, sf))


# --- chunks ---------------------------------------------------------------------

# Two-step greedy packing: a recursive walk over the lines of each long text.
define("CHUNK_CTES", f"""
base AS (SELECT project, path, content, CAST(floor(len(content) / 3) AS BIGINT) + 10 AS est FROM files WHERE content <> ''),
long AS (SELECT project, path, string_split(content, chr(10)) AS ls FROM base WHERE est > {fixed.CHUNK_TOKENS}),
walk(project, path, i, chunk, chars) AS (
  SELECT project, path, 1, 0, len(ls[1]) + 1 FROM long
  UNION ALL
  SELECT w.project, w.path, w.i + 1,
    CASE WHEN floor((w.chars + len(l.ls[w.i + 1]) + 1) / 3) + 10 > {fixed.CHUNK_TOKENS} THEN w.chunk + 1 ELSE w.chunk END,
    CASE WHEN floor((w.chars + len(l.ls[w.i + 1]) + 1) / 3) + 10 > {fixed.CHUNK_TOKENS} THEN len(l.ls[w.i + 1]) + 1
         ELSE w.chars + len(l.ls[w.i + 1]) + 1 END
  FROM walk w JOIN long l ON l.project = w.project AND l.path = w.path WHERE w.i < len(l.ls)),
spans AS (SELECT project, path, chunk, min(i) AS s, max(i) AS e FROM walk GROUP BY ALL),
chunked AS MATERIALIZED (
  SELECT s.project, s.path, CAST(s.chunk AS INTEGER) AS chunk_no, CAST(s.s AS INTEGER) AS start_line, CAST(s.e AS INTEGER) AS end_line,
    array_to_string(list_slice(l.ls, s.s, s.e), chr(10)) || chr(10) AS content
  FROM spans s JOIN long l ON l.project = s.project AND l.path = s.path
  UNION ALL
  SELECT project, path, 0, 1,
    CAST(len(content) - len(replace(content, chr(10), '')) + CASE WHEN ends_with(content, chr(10)) THEN 0 ELSE 1 END AS INTEGER), content
  FROM base WHERE est <= {fixed.CHUNK_TOKENS}),
chunk_rows AS MATERIALIZED (SELECT *, CAST(floor(len(content) / 3) + 10 AS INTEGER) AS tokens FROM chunked),
packs AS (SELECT project, path, CAST(count(*) AS INTEGER) AS n_chunks, CAST(sum(tokens) AS BIGINT) AS total_tokens FROM chunk_rows GROUP BY ALL)""")


@query("chunk_documents", """WITH RECURSIVE $CORPUS, $CHUNK_CTES
SELECT project, path, chunk_no, start_line, end_line, tokens, content FROM chunk_rows""")
def q_chunks(spark, sf):
    return stats.chunk_rows(views.corpus(spark, sf))


@query("chunk_stats", """WITH RECURSIVE $CORPUS, $CHUNK_CTES
SELECT f.project, f.path, coalesce(n_chunks, 0) AS n_chunks, coalesce(total_tokens, 0) AS total_tokens,
  CASE WHEN n_chunks IS NULL THEN 'No chunks' WHEN n_chunks = 1 THEN 'Single chunk: ' || total_tokens || ' tokens'
       ELSE n_chunks || ' chunks, ' || total_tokens || ' total tokens' END AS summary
FROM files f LEFT JOIN packs p ON p.project = f.project AND p.path = f.path""")
def q_chunk_stats(spark, sf):
    return stats.chunk_stats(views.corpus(spark, sf))


@query("first_chunk", """WITH RECURSIVE $CORPUS, $CHUNK_CTES
SELECT c.project, c.path, n_chunks, content || CASE WHEN n_chunks > 1 THEN chr(10) || chr(10) || '[NOTE: This file has '
  || n_chunks || ' chunks, analyzing first chunk only]' ELSE '' END AS content
FROM chunk_rows c JOIN packs p ON p.project = c.project AND p.path = c.path WHERE chunk_no = 0""")
def q_first_chunk(spark, sf):
    return stats.first_chunk(views.corpus(spark, sf))


# --- digests --------------------------------------------------------------------

@query("content_duplicates", """WITH $CORPUS
SELECT md5(content) AS content_hash, count(*) AS n_files,
  min({'p': project, 'q': path}).p AS first_project, min({'p': project, 'q': path}).q AS first_path
FROM files GROUP BY 1 HAVING count(*) > 1""")
def q_duplicates(spark, sf):
    return stats.duplicate_contents(views.corpus(spark, sf))


@query("group_digest", """WITH $CORPUS,
d AS (SELECT project, md5(path || chr(31) || content) AS h FROM files),
s AS (SELECT project, count(*) AS n_rows, sum(CAST('0x' || h[1:15] AS HUGEINT)) AS hi, sum(CAST('0x' || h[17:31] AS HUGEINT)) AS lo
      FROM d GROUP BY project)
SELECT project, n_rows, md5(n_rows || ':' || hi || ':' || lo) AS digest FROM s""")
def q_group_digest(spark, sf):
    return stats.group_digest(views.corpus(spark, sf), ["project"], ["path", "content"])


@query("cache_keys", """WITH $REPOS
SELECT project, path, base || '_file_' || left(md5(path), 8) AS cache_key, md5(content) AS content_hash,
  CAST(len(content) - len(replace(content, chr(10), '')) + CASE WHEN content = '' OR ends_with(content, chr(10)) THEN 0 ELSE 1 END AS INTEGER) AS n_lines,
  CAST(floor(len(content) / 3) AS INTEGER) + 10 AS tokens
FROM facts""")
def q_cache_keys(spark, sf):
    return views.repos(spark, sf).select(
        "project", "path", text.cache_key("path", F.lit("file")).alias("cache_key"),
        text.content_hash("content").alias("content_hash"),
        text.line_count("content").alias("n_lines"), text.token_estimate("content").alias("tokens"))
