"""Queries for summaries, stacks, questions and the result cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.functions import fixed, services as sv, text
from codestrata.operators import detection, discovery, summaries
from codestrata.plans.registry import define, has_any, literal, query, sql_list
from codestrata.session import cut_lineage
from codestrata.sources import cache, views

_LANG = " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in summaries.LANGUAGES.items())
_IMPORTS = " || ".join(f"regexp_extract_all(content, {literal(p)}, 1)" for p in summaries.IMPORTS)


def _distinct(expr: str) -> str:
    """Distinct elements, in order of appearance."""
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


_KIND_CASE = " ".join(f"WHEN {has_any('lower(purpose)', words)} THEN '{kind}'" for words, kind in fixed.SERVICE_KINDS)
define("SUMMARIES", f"""
fsum0 AS MATERIALIZED (
  SELECT project, path, CASE parent WHEN '.' THEN 'root' ELSE parent END AS folder, CASE ext {_LANG} ELSE 'Other' END AS language, base, content,
    regexp_extract(content, {literal(summaries.PURPOSE)}, 1) AS p0, CAST(floor(len(content) / 3) AS INTEGER) + 10 AS tokens,
    CAST(len(content) - len(replace(content, chr(10), '')) + CASE WHEN ends_with(content, chr(10)) THEN 0 ELSE 1 END AS INTEGER) AS lines,
    regexp_extract_all(content, {literal(summaries.TYPES)}, 1) AS ts, {_IMPORTS} AS ims
  FROM facts WHERE content <> ''),
fsum AS MATERIALIZED (
  SELECT project, path, folder, language, CASE WHEN p0 <> '' THEN p0 ELSE language || ' file ' || base END AS purpose,
    CASE WHEN tokens < {summaries.LOW_TOKENS} THEN 'low' WHEN tokens < {summaries.MEDIUM_TOKENS} THEN 'medium' ELSE 'high' END AS complexity,
    {_distinct("ts")} AS key_types, {_distinct("ims")} AS imports, tokens, lines FROM fsum0),
lc AS (SELECT project, folder, language, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(lines) AS BIGINT) AS lines, count(*) FILTER (complexity = 'high') AS n_complex FROM fsum GROUP BY ALL),
folders AS MATERIALIZED (
  SELECT project, folder, string_agg(language || ':' || n, ',' ORDER BY language) AS languages, first(language ORDER BY n DESC, language) AS primary_language,
    CAST(sum(n) AS BIGINT) AS n_files, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(n_complex) AS BIGINT) AS n_complex FROM lc GROUP BY ALL),
foldersum AS MATERIALIZED (SELECT *, primary_language || CASE WHEN {has_any('lower(folder)', fixed.SERVICE_FOLDER_TOKENS)} THEN ' service folder' ELSE ' folder' END AS purpose FROM folders),
pl AS (SELECT project, language, sum(n) AS n, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(n_complex) AS BIGINT) AS n_complex FROM lc GROUP BY ALL),
projsum AS (
  SELECT project, string_agg(language || ':' || n, ',' ORDER BY language) AS languages, first(language ORDER BY n DESC, language) AS primary_language,
    CAST(sum(n) AS BIGINT) AS n_files, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(n_complex) AS BIGINT) AS n_complex,
    (SELECT count(*) FROM folders f WHERE f.project = pl.project) AS n_folders FROM pl GROUP BY ALL)""")


def _file_summaries(spark, sf):
    return summaries.summarize_files(views.repos(spark, sf))


@query("file_summaries", """WITH $REPOS, $SUMMARIES
SELECT project, path, folder, language, purpose, complexity, array_to_string(key_types, ',') AS key_types, array_to_string(imports, ',') AS imports, tokens, lines FROM fsum""")
def q_files(spark, sf):
    return _file_summaries(spark, sf).withColumns({c: F.array_join(c, ",") for c in ("key_types", "imports")})


@query("file_summaries_corpus", """WITH $CORPUS, $SUMMARIES
SELECT project, path, purpose, complexity, array_to_string(key_types, ',') AS key_types, array_to_string(imports, ',') AS imports, tokens, lines FROM fsum""")
def q_files_corpus(spark, sf):
    """Whole texts, also those of many chunks."""
    found = summaries.summarize_files(views.corpus(spark, sf)).drop("folder", "language")
    return found.withColumns({c: F.array_join(c, ",") for c in ("key_types", "imports")})


@query("folder_summary", "WITH $REPOS, $SUMMARIES SELECT * FROM foldersum")
def q_folders(spark, sf):
    return summaries.summarize_folders(_file_summaries(spark, sf))


@query("folder_modules", f"WITH $REPOS, $SUMMARIES SELECT project, folder, path FROM fsum WHERE {has_any('lower(path)', fixed.KEY_FILE_TOKENS)}")
def q_modules(spark, sf):
    return summaries.folder_modules(_file_summaries(spark, sf))


@query("folder_dependencies", "WITH $REPOS, $SUMMARIES SELECT DISTINCT project, folder, unnest(imports) AS dependency FROM fsum")
def q_dependencies(spark, sf):
    return summaries.folder_dependencies(_file_summaries(spark, sf))


@query("project_summary", "WITH $REPOS, $SUMMARIES SELECT * FROM projsum")
def q_projects(spark, sf):
    return summaries.summarize_projects(_file_summaries(spark, sf))


@query("rollup_summary", """WITH $REPOS, $SUMMARIES
SELECT project, folder, CAST(grouping(project, folder) AS INTEGER) AS level, count(*) AS n_files, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(lines) AS BIGINT) AS lines FROM fsum GROUP BY ROLLUP (project, folder)""")
def q_rollup(spark, sf):
    return summaries.rollup_summary(_file_summaries(spark, sf))


@query("rollup_corpus", """WITH $CORPUS
SELECT project, split_part(path, '/', 2) AS folder, CAST(grouping(project, folder) AS INTEGER) AS level, count(*) AS n_files,
  CAST(sum(CAST(floor(len(content) / 3) AS INTEGER) + 10) AS BIGINT) AS tokens FROM files GROUP BY ROLLUP (project, folder)""")
def q_rollup_corpus(spark, sf):
    files = views.corpus(spark, sf).select("project", F.element_at(text.segments("path"), 2).alias("folder"), text.token_estimate("content").alias("tokens"))
    return files.rollup("project", "folder").agg(
        F.grouping_id().cast("int").alias("level"), F.count("*").alias("n_files"), F.sum("tokens").alias("tokens"))


@query("primary_language", "WITH $REPOS, $SUMMARIES SELECT project, folder, primary_language, n_files FROM folders")
def q_primary(spark, sf):
    return summaries.primary_language(_file_summaries(spark, sf))


@query("folder_services", f"""WITH $REPOS, $SUMMARIES,
x AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(folder, '[^/]*$'), '-service$', ''), '_service$', ''), '^service-', ''), '^service_', '') AS nm
  FROM foldersum WHERE {has_any('lower(folder)', fixed.SERVICE_FOLDER_TOKENS)} OR {has_any('lower(purpose)', fixed.SERVICE_FOLDER_TOKENS)})
SELECT project, array_to_string(list_transform(string_split(replace(nm, '-', ' '), ' '), lambda w: upper(left(w, 1)) || w[2:]), ' ') AS name, folder AS path,
  primary_language AS language, purpose, CASE {_KIND_CASE} ELSE 'Business Logic' END AS kind FROM x""")
def q_folder_services(spark, sf):
    return summaries.folder_services(summaries.folder_summary(_file_summaries(spark, sf)))


# --- stacks and repository details ------------------------------------------------------

def _stack_test(ends, tokens) -> str:
    test = "(" + " OR ".join(f"ends_with(lpath, '{e}')" for e in ends) + ")"
    return test if tokens == [""] else test + " AND " + has_any("content", tokens)


define("STACKS", f"""
stackrows AS MATERIALIZED ({" UNION ".join(f"SELECT DISTINCT project, '{n}' AS stack FROM facts WHERE {_stack_test(e, t)}" for n, e, t in summaries.STACKS)}),
sf AS (SELECT project, bool_or(ends_with(path, '.go')) AS has_go,
    bool_or(ends_with(path, 'package.json') OR ends_with(path, '.js') OR ends_with(path, '.ts')) AS has_node,
    bool_or((ends_with(path, 'package.json') AND contains(content, '"react"')) OR ends_with(path, '.jsx') OR ends_with(path, '.tsx')) AS has_react,
    bool_or(contains(lpath, 'go.mod')) AS has_go_mod, bool_or(contains(lpath, 'package.json')) AS has_package, bool_or(contains(lpath, 'main.go')) AS has_main_go,
    bool_or(contains(lpath, 'dockerfile') OR contains(lpath, 'docker-compose.yml')) AS has_docker, bool_or(contains(lpath, 'makefile')) AS has_make,
    bool_or(ext IN ('.js', '.jsx', '.mjs', '.ts', '.tsx')) AS has_script, bool_or(lbase IN {sql_list(summaries.WORKSPACE_FILES)}) AS has_workspace FROM facts GROUP BY project),
st0 AS (SELECT s.*, t.primary_type, t.confidence, coalesce((SELECT string_agg(stack, ',' ORDER BY stack) FROM stackrows r WHERE r.project = s.project), '') AS main_stacks
  FROM sf s JOIN typed t ON t.project = s.project),
st1 AS (SELECT *, lower(main_stacks) AS ms, primary_type IN ('Frontend', 'Fullstack') AS fe, primary_type = 'Backend' AS be FROM st0),
st2 AS (SELECT *, CASE WHEN has_go_mod THEN 'Go' WHEN has_package AND (contains(ms, 'react') OR fe) THEN 'React.js'
     WHEN has_package AND (regexp_matches(ms, 'node|express|fastify|nest') OR be) THEN 'Node.js' WHEN has_package THEN 'React.js'
     WHEN contains(ms, 'react') THEN 'React.js' WHEN regexp_matches(ms, 'node|express|fastify') THEN 'Node.js' WHEN contains(ms, 'go') THEN 'Go'
     WHEN has_go THEN 'Go' WHEN has_script AND fe THEN 'React.js' WHEN has_script AND be THEN 'Node.js' ELSE '' END AS stack,
   CASE WHEN fe THEN CASE WHEN has_react THEN 'react.js' WHEN has_node THEN 'node.js' ELSE '' END WHEN has_go THEN 'go' WHEN has_node THEN 'node.js' ELSE '' END AS service_stack FROM st1),
stacked AS MATERIALIZED (SELECT *, array_to_string(list_filter([
     CASE WHEN stack IN ('React.js', 'Node.js') AND has_package THEN 'npm install' END, CASE WHEN stack IN ('React.js', 'Node.js') AND has_package THEN 'npm run dev' END,
     CASE WHEN stack = 'React.js' AND has_package THEN 'npm run build' END, CASE WHEN stack = 'Node.js' AND has_package THEN 'npm test' END,
     CASE WHEN stack = 'Go' AND has_go_mod THEN 'go mod tidy' END, CASE WHEN stack = 'Go' AND has_go_mod THEN 'go build' END,
     CASE WHEN stack = 'Go' AND has_go_mod THEN CASE WHEN has_main_go THEN 'go run main.go' ELSE 'go run .' END END,
     CASE WHEN has_docker THEN 'docker-compose up -d' END, CASE WHEN has_make THEN 'make' END], lambda x: x IS NOT NULL), '; ') AS commands FROM st2)""")


@query("main_stacks", "WITH $REPOS, $RULES, $MANIFEST, $STARTUP, $TYPED, $STACKS SELECT project, stack FROM stackrows")
def q_main_stacks(spark, sf):
    return summaries.main_stacks(views.repos(spark, sf))


@query("stack_flags", "WITH $REPOS, $RULES, $MANIFEST, $STARTUP, $TYPED, $STACKS SELECT * FROM sf")
def q_stack_flags(spark, sf):
    return summaries.stack_flags(views.repos(spark, sf))


@query("project_stack", """WITH $REPOS, $RULES, $MANIFEST, $STARTUP, $TYPED, $STACKS
SELECT project, primary_type, main_stacks, stack, service_stack, commands, has_workspace FROM stacked""")
def q_project_stack(spark, sf):
    files = views.repos(spark, sf)
    return summaries.project_stack(files, detection.project_type(files))


@query("repository_details", f"""WITH $REPOS, $RULES, $MANIFEST, $STARTUP, $TYPED, $STACKS, $SERVICES,
ns AS (SELECT s.*, (SELECT count(*) FROM services x WHERE x.project = s.project) AS n_services,
  (SELECT count(*) FROM facts x WHERE x.project = s.project AND {has_any('lpath', fixed.IMPORTANT_TOKENS)}) AS n_evidence_paths FROM stacked s)
SELECT project, primary_type || ' project' AS repo_summary_line, CASE WHEN n_services > 1 THEN 'microservices' ELSE 'monolith' END AS architecture,
  CASE WHEN n_services > 1 OR has_workspace THEN 'monorepo' ELSE 'single-repo' END AS repo_layout, main_stacks, n_services, n_evidence_paths,
  round(confidence / 10.0, 6) AS confidence FROM ns""")
def q_details(spark, sf):
    files = views.repos(spark, sf)
    types = cut_lineage(detection.project_type(files))
    return summaries.repository_details(files, discovery.discover_services(files), types)


@query("multi_service", """WITH $REPOS, $RULES, $MANIFEST, $STARTUP, $TYPED, $STACKS, $SERVICES, $SUMMARIES,
ns AS (SELECT s.project, has_workspace, (SELECT count(*) FROM services x WHERE x.project = s.project) AS n FROM stacked s)
SELECT project, n > 1 OR has_workspace AS is_multi_service FROM ns""")
def q_multi_service(spark, sf):
    files = views.repos(spark, sf)
    types = cut_lineage(detection.project_type(files))
    details = summaries.repository_details(files, discovery.discover_services(files), types)
    return summaries.is_multi_service(details, summaries.folder_summary(summaries.summarize_files(files)))


@query("nested_summaries", """WITH $REPOS, $SUMMARIES
SELECT s.project, s.folder, s.path, s.language, f.purpose AS folder_purpose, f.primary_language AS folder_language, f.n_files AS folder_files
FROM fsum s JOIN foldersum f ON f.project = s.project AND f.folder = s.folder""")
def q_nested(spark, sf):
    rows = _file_summaries(spark, sf)
    return summaries.nest_summaries(summaries.folder_summary(rows), rows.select("project", "folder", "path", "language"))


@query("evidence_paths", f"WITH $REPOS SELECT project, path FROM facts WHERE {has_any('lpath', fixed.IMPORTANT_TOKENS)}")
def q_evidence_paths(spark, sf):
    return summaries.evidence_paths(views.repos(spark, sf))


# --- questions ---------------------------------------------------------------------------

_QA = ", ".join(f"({literal(k)}, {no}, {literal(q)}, {literal(a)})" for no, (kinds, q, a) in enumerate(fixed.FALLBACK_QUESTIONS)
                for k in (kinds or fixed.PROJECT_TYPES + [fixed.UNKNOWN_TYPE]))


@query("fallback_questions", f"""WITH $REPOS, $RULES, $MANIFEST, $STARTUP, $TYPED, $SUMMARIES,
qa(primary_type, question_no, question, answer) AS (VALUES {_QA})
SELECT t.project, q.question_no, q.question, q.answer FROM typed t JOIN qa q ON q.primary_type = t.primary_type
UNION ALL SELECT project, {len(fixed.FALLBACK_QUESTIONS)}, {literal(fixed.PURPOSE_QUESTION)}, primary_language || ' project' FROM projsum""")
def q_questions(spark, sf):
    files = views.repos(spark, sf)
    purposes = summaries.project_summary(summaries.summarize_files(files)).select(
        "project", F.concat("primary_language", F.lit(" project")).alias("purpose"))
    return summaries.fallback_questions(detection.project_type(files), purposes)


@query("qa_pairs", f"""WITH p AS (
  SELECT conv_id, turn, role, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS question, trim(lead(text) OVER w, ' ' || chr(9) || chr(10) || chr(13)) AS answer, lead(role) OVER w AS r2
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, question, answer, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS rank
FROM p WHERE role = 'user' AND r2 = 'assistant' AND question <> '' AND answer <> '' QUALIFY rank <= {fixed.QUESTION_LIMIT}""")
def q_qa(spark, sf):
    turns = views.table(spark, sf, "conversations")
    # the answer is the next turn: an equi join on (conversation, turn) instead of a window
    answers = (turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")))
    pairs = (turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
             .join(answers, ["conv_id", "turn"]))
    return summaries.valid_qa(pairs, ["conv_id"], [F.col("turn")])


# --- result cache -------------------------------------------------------------------------

# Labelled documents play the old cache: toxic ones have changed since, low-quality ones are too old.
_NOW = "2024-03-02 00:00:00"


def _old_cache(spark, sf):
    doc, labels = views.table(spark, sf, "documents"), views.table(spark, sf, "labels")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return doc.join(labels, "doc_id").select(
        F.lit("file").alias("kind"), F.concat_ws("/", "source", path).alias("key"),
        F.when(F.col("toxic") == 1, F.md5(F.lit("old").cast("binary"))).otherwise(text.content_hash("text")).alias("content_hash"),
        F.when(F.col("quality") == 0, F.lit("2024-02-29 23:00:00")).otherwise(F.lit("2024-03-01 12:00:00")).cast("timestamp_ntz").alias("ts"),
        F.lit("{}").alias("result"))


define("OLDCACHE", """
h AS (SELECT project, path, md5(content) AS hash FROM files),
old AS (SELECT source || '/' || source || '/' || lang || '/' || d.doc_id || '.txt' AS key, CASE WHEN toxic = 1 THEN md5('old') ELSE md5(text) END AS content_hash,
   CASE WHEN quality = 0 THEN TIMESTAMP '2024-02-29 23:00:00' ELSE TIMESTAMP '2024-03-01 12:00:00' END AS ts FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
hit AS (SELECT h.project, h.path FROM h JOIN old o ON o.key = h.project || '/' || h.path AND o.content_hash = h.hash AND o.ts >= TIMESTAMP '2024-03-02 00:00:00' - INTERVAL 24 HOUR)""")


def _keyed(files):
    return files.withColumn("key", F.concat_ws("/", "project", "path"))


@query("cache_todo", "WITH $CORPUS, $OLDCACHE SELECT project, path FROM h WHERE NOT EXISTS (SELECT 1 FROM hit x WHERE x.project = h.project AND x.path = h.path)")
def q_todo(spark, sf):
    files = views.corpus(spark, sf)
    now = F.lit(_NOW).cast("timestamp_ntz")
    return cache.cache_todo(_keyed(files), _old_cache(spark, sf), now).select("project", "path")


@query("cache_hits", "WITH $CORPUS, $OLDCACHE SELECT project, path, '{}' AS result FROM hit")
def q_hits(spark, sf):
    files = views.corpus(spark, sf)
    now = F.lit(_NOW).cast("timestamp_ntz")
    return cache.cache_hits(_keyed(files), _old_cache(spark, sf), now).select("project", "path", "result")


@query("host_services", r"""
WITH u AS (SELECT page_id, url, split_part(split_part(regexp_replace(regexp_replace(url, '^http://', ''), '^https://', ''), '/', 1), ':', 1) AS h FROM pages)
SELECT page_id, CASE WHEN h = 'localhost' OR regexp_matches(h, '^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$') THEN '' WHEN ends_with(h, '-service') THEN h[:-9] ELSE h END AS service,
  translate(h, '-. ', '___') AS node_id FROM u""")
def q_hosts(spark, sf):
    pages = views.table(spark, sf, "pages")
    bare = F.regexp_replace(F.regexp_replace("url", "^http://", ""), "^https://", "")
    host = F.substring_index(F.substring_index(bare, "/", 1), ":", 1)
    return pages.select("page_id", sv.host_of("url").alias("service"), text.identifier(host).alias("node_id"))
