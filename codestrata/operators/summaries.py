"""File -> folder -> project summaries.

The summarizers are pluggable; the defaults are deterministic extracts built
from native expressions.  Lists that can grow with a folder or a project (key
modules, dependencies, evidence paths) stay in row form; only maps over the
fixed language table are folded into a column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from codestrata.functions import fixed, services, text, verdicts
from codestrata.operators import filters, tables

# Extension to language; anything else is "Other".
LANGUAGES = {
    ".go": "Go", ".js": "JavaScript", ".jsx": "JavaScript", ".mjs": "JavaScript",
    ".ts": "TypeScript", ".tsx": "TypeScript", ".py": "Python", ".java": "Java",
    ".c": "C", ".h": "C", ".cpp": "C++", ".hpp": "C++", ".rs": "Rust", ".rb": "Ruby",
    ".php": "PHP", ".cs": "C#", ".kt": "Kotlin", ".swift": "Swift", ".scala": "Scala",
    ".sql": "SQL", ".sh": "Shell", ".bash": "Shell", ".html": "HTML", ".css": "CSS",
    ".scss": "CSS", ".json": "JSON", ".yaml": "YAML", ".yml": "YAML", ".toml": "TOML",
    ".md": "Markdown", ".txt": "Text", ".tf": "Terraform", ".ipynb": "Notebook",
}
OTHER = "Other"
LOW_TOKENS, MEDIUM_TOKENS = 40, 400
PURPOSE = r"(?m)^[ \t]*(?://|#|--|<!--)[ \t]*([^\n]+)"
TYPES = r"(?m)^[ \t]*(?:export[ \t]+)?(?:type|class|struct|interface|func|def|function|CREATE TABLE)[ \t]+([A-Za-z_]\w*)"
IMPORTS = [r'import[ \t]+(?:[a-zA-Z_{}]\w*[ \t]+)?"([^"\n]+)"', r'from[ \t]+["]?([\w./@-]+)', r'require\(["]([^"\n]+)']

# Main stacks: manifest tokens per stack.
STACKS = [
    ("Go", ["go.mod"], [""]),
    ("Go gRPC", [".go"], ["google.golang.org/grpc"]),
    ("Go Gin", [".go"], ["gin-gonic/gin"]),
    ("Go Echo", [".go"], ["labstack/echo"]),
    ("React", ["package.json"], ['"react":']),
    ("Next.js", ["package.json"], ['"next":']),
    ("Express", ["package.json"], ['"express":']),
    ("Fastify", ["package.json"], ['"fastify":']),
    ("NestJS", ["package.json"], ['"@nestjs/core":']),
    ("Prisma", ["package.json"], ['"prisma":']),
    ("Knex", ["package.json"], ['"knex":']),
    ("Flask", [".py"], ["from flask"]),
    ("Django", [".py"], ["from django"]),
    ("FastAPI", [".py"], ["from fastapi"]),
    ("Spring Boot", ["pom.xml", "build.gradle"], ["spring-boot"]),
    ("Docker Compose", ["docker-compose.yml", "docker-compose.yaml"], [""]),
    ("Kubernetes", [".yaml", ".yml"], ["kind: Deployment"]),
    ("Terraform", [".tf"], [""]),
]
WORKSPACE_FILES = ["turbo.json", "lerna.json", "nx.json", "pnpm-workspace.yaml", "go.work"]

FILE_SUMMARY = ("project string, path string, folder string, language string, purpose string, "
                "complexity string, key_types array<string>, imports array<string>, tokens int, lines int")


def language_of(path: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, text.extension(path)), F.lit(OTHER))


def folder_of(path: Column | str) -> Column:
    parent = text.dirname(path)
    return F.when(parent == ".", "root").otherwise(parent)


def summarize_files(files: DataFrame, fn: Callable | None = None, top_n: int | None = None) -> DataFrame:
    """One summary per non-empty file, over its whole text.

    ``top_n`` cuts the lists of types and imports; all are kept by default.
    ``fn`` replaces the default: a ``mapInPandas`` function over
    ``(project, path, content)`` that yields ``FILE_SUMMARY`` columns; a model with
    a limit on its input takes ``stats.chunk_rows`` or ``stats.first_chunk`` instead.
    """
    texts = files.select("project", "path", "content").filter(F.col("content") != "")
    if fn is not None:
        return texts.mapInPandas(fn, FILE_SUMMARY)
    body, base = F.col("content"), text.basename("path")
    tokens = text.token_estimate(body)
    found = F.regexp_extract(body, PURPOSE, 1)
    language = language_of("path")
    imports = F.concat(*[F.regexp_extract_all(body, F.lit(p), F.lit(1)) for p in IMPORTS])

    def listed(c: Column) -> Column:
        every = F.array_distinct(c)
        return every if top_n is None else F.slice(every, 1, top_n)

    return texts.select(
        "project", "path", folder_of("path").alias("folder"), language.alias("language"),
        F.when(found != "", found).otherwise(F.concat(language, F.lit(" file "), base)).alias("purpose"),
        F.when(tokens < LOW_TOKENS, "low").when(tokens < MEDIUM_TOKENS, "medium").otherwise("high").alias("complexity"),
        listed(F.regexp_extract_all(body, F.lit(TYPES), F.lit(1))).alias("key_types"),
        listed(imports).alias("imports"),
        tokens.alias("tokens"), text.line_count(body).alias("lines"))


# --- folder and project level -----------------------------------------------------

def _languages(df: DataFrame, keys: list[str]) -> DataFrame:
    """Fold per-language counts into one text; the list is bounded by the language table."""
    listed = F.array_sort(F.collect_list(F.struct("language", "n_files")))
    return df.groupBy(*keys).agg(
        F.array_join(F.transform(listed, lambda e: F.concat(e["language"], F.lit(":"), e["n_files"].cast("string"))), ",").alias("languages"),
        F.min_by("language", F.struct(-F.col("n_files"), F.col("language"))).alias("primary_language"),
        F.sum("n_files").alias("n_files"), F.sum("tokens").alias("tokens"), F.sum("lines").alias("lines"),
        F.sum("n_complex").alias("n_complex"))


def language_counts(summaries: DataFrame, keys: list[str]) -> DataFrame:
    return summaries.groupBy(*keys, "language").agg(
        F.count("*").alias("n_files"), F.sum("tokens").alias("tokens"), F.sum("lines").alias("lines"),
        F.count_if(F.col("complexity") == "high").alias("n_complex"))


def folder_summary(summaries: DataFrame) -> DataFrame:
    keys = ["project", "folder"]
    out = _languages(language_counts(summaries, keys), keys)
    kind = F.when(looks_like_service("folder", F.lit("")), "service folder").otherwise("folder")
    return out.withColumn("purpose", F.concat("primary_language", F.lit(" "), kind))


def summarize_folders(summaries: DataFrame, fn: Callable | None = None, schema: str | None = None) -> DataFrame:
    """``fn`` is a ``mapInPandas`` function over folder rows; the default keeps the extract."""
    folders = folder_summary(summaries)
    return folders if fn is None else folders.mapInPandas(fn, schema)


def folder_modules(summaries: DataFrame) -> DataFrame:
    """Key modules of each folder, one row each."""
    return summaries.filter(filters.is_key_file("path")).select("project", "folder", "path")


def folder_dependencies(summaries: DataFrame) -> DataFrame:
    return summaries.select("project", "folder", F.explode("imports").alias("dependency")).distinct()


def project_summary(summaries: DataFrame) -> DataFrame:
    """Second reduce step: folder rows to one row per project."""
    per_folder = language_counts(summaries, ["project", "folder"])
    langs = per_folder.groupBy("project", "language").agg(
        *[F.sum(c).alias(c) for c in ("n_files", "tokens", "lines", "n_complex")])
    n_folders = per_folder.select("project", "folder").distinct().groupBy("project").agg(F.count("*").alias("n_folders"))
    return _languages(langs, ["project"]).join(n_folders, "project")


def summarize_projects(summaries: DataFrame, fn: Callable | None = None, schema: str | None = None) -> DataFrame:
    projects = project_summary(summaries)
    return projects if fn is None else projects.mapInPandas(fn, schema)


def rollup_summary(summaries: DataFrame) -> DataFrame:
    """File, folder and project levels in one grouping-sets aggregation."""
    return (summaries.rollup("project", "folder")
            .agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n_files"),
                 F.sum("tokens").alias("tokens"), F.sum("lines").alias("lines")))


def primary_language(summaries: DataFrame) -> DataFrame:
    return folder_summary(summaries).select("project", "folder", "primary_language", "n_files")


def looks_like_service(path: Column | str, purpose: Column | str) -> Column:
    return (text.contains_any(F.lower(text.col(path)), fixed.SERVICE_FOLDER_TOKENS)
            | text.contains_any(F.lower(text.col(purpose)), fixed.SERVICE_FOLDER_TOKENS))


def folder_services(folders: DataFrame) -> DataFrame:
    """Folders that read like a service, with display name and kind."""
    return folders.filter(looks_like_service("folder", "purpose")).select(
        "project", services.display_name("folder").alias("name"), F.col("folder").alias("path"),
        F.col("primary_language").alias("language"), "purpose", services.service_kind("purpose").alias("kind"))


# --- stacks, repository details, questions --------------------------------------------

def main_stacks(files: DataFrame) -> DataFrame:
    """Distinct (project, stack) rows; tests run inside the scan."""
    low, body = F.lower("path"), F.col("content")
    tests = []
    for name, ends, tokens in STACKS:
        hit = text.ends_with_any(low, ends)
        if tokens != [""]:
            hit = hit & text.contains_any(body, tokens)
        tests.append(F.when(hit, F.lit(name)))
    return files.select("project", F.explode(F.array_compact(F.array(*tests))).alias("stack")).distinct()


def stack_flags(files: DataFrame) -> DataFrame:
    path, low = F.col("path"), F.lower("path")
    package = path.endswith("package.json")
    return files.groupBy("project").agg(
        F.bool_or(path.endswith(".go")).alias("has_go"),
        F.bool_or(package | path.endswith(".js") | path.endswith(".ts")).alias("has_node"),
        F.bool_or((package & F.col("content").contains('"react"')) | path.endswith(".jsx") | path.endswith(".tsx")).alias("has_react"),
        F.bool_or(low.contains("go.mod")).alias("has_go_mod"),
        F.bool_or(low.contains("package.json")).alias("has_package"),
        F.bool_or(low.contains("main.go")).alias("has_main_go"),
        F.bool_or(low.contains("dockerfile") | low.contains("docker-compose.yml")).alias("has_docker"),
        F.bool_or(low.contains("makefile")).alias("has_make"),
        F.bool_or(language_of("path").isin("JavaScript", "TypeScript")).alias("has_script"),
        F.bool_or(text.basename(low).isin(WORKSPACE_FILES)).alias("has_workspace"))


def service_stack(primary: Column | str, has_go: Column | str = "has_go",
                  has_node: Column | str = "has_node", has_react: Column | str = "has_react") -> Column:
    """Stack used for service discovery, empty when none fits."""
    p = text.col(primary)
    go, node, react = text.col(has_go), text.col(has_node), text.col(has_react)
    web = p.isin("Frontend", "Fullstack")
    return (F.when(web & react, "react.js").when(web & node, "node.js").when(web, "")
            .when(go, "go").when(node, "node.js").otherwise(""))


def project_stack(files: DataFrame, types: DataFrame) -> DataFrame:
    """Supported stack and setup commands of each project.

    The stack list per project is bounded by the stack table.
    """
    stacks = main_stacks(files).groupBy("project").agg(F.array_join(F.array_sort(F.collect_list("stack")), ",").alias("main_stacks"))
    joined = (stack_flags(files).join(types.select("project", "primary_type"), "project")
              .join(stacks, "project", "left").na.fill({"main_stacks": ""}))
    stack = verdicts.stack_of("has_go_mod", "has_package", "primary_type", F.lower("main_stacks"), "has_go", "has_script")
    return (joined.withColumn("stack", stack)
            .withColumn("commands", F.array_join(verdicts.setup_commands(
                "stack", "has_package", "has_go_mod", "has_main_go", "has_docker", "has_make"), "; "))
            .withColumn("service_stack", service_stack("primary_type"))
            .select("project", "primary_type", "main_stacks", "stack", "service_stack", "commands", "has_workspace"))


def evidence_paths(files: DataFrame) -> DataFrame:
    return files.filter(text.contains_any(F.lower("path"), fixed.IMPORTANT_TOKENS)).select("project", "path")


def repository_details(files: DataFrame, services_df: DataFrame, types: DataFrame,
                       fn: Callable | None = None, schema: str | None = None) -> DataFrame:
    """Architecture and layout per project, from counts of services and workspace files."""
    n_services = services_df.groupBy("project").agg(F.count("*").alias("n_services"))
    n_evidence = evidence_paths(files).groupBy("project").agg(F.count("*").alias("n_evidence_paths"))
    base = (project_stack(files, types).join(types.select("project", "confidence"), "project")
            .join(n_services, "project", "left").join(n_evidence, "project", "left")
            .na.fill({"n_services": 0, "n_evidence_paths": 0}))
    many = F.col("n_services") > 1
    out = base.select(
        "project",
        F.concat("primary_type", F.lit(" project")).alias("repo_summary_line"),
        F.when(many, "microservices").otherwise("monolith").alias("architecture"),
        F.when(many | F.col("has_workspace"), "monorepo").otherwise("single-repo").alias("repo_layout"),
        "main_stacks", "n_services", "n_evidence_paths",
        F.round(F.col("confidence") / 10.0, 6).alias("confidence"))
    return out if fn is None else out.mapInPandas(fn, schema)


def is_multi_service(details: DataFrame, folders: DataFrame, many_folders: int = 3) -> DataFrame:
    """Microservices or monorepo?  Projects without details fall back to their number of folders."""
    n = folders.groupBy("project").agg(F.count("*").alias("n_folders"))
    known = (F.col("architecture") == "microservices") | (F.col("repo_layout") == "monorepo")
    joined = n.join(details.select("project", "architecture", "repo_layout"), "project", "full_outer")
    return joined.select("project", F.coalesce(known, F.col("n_folders") > many_folders, F.lit(False)).alias("is_multi_service"))


def nest_summaries(folders: DataFrame, summaries: DataFrame) -> DataFrame:
    """Files next to the summary of their folder, kept flat: folders may be of any size."""
    return summaries.join(folders.select("project", "folder", F.col("purpose").alias("folder_purpose"),
                                         F.col("primary_language").alias("folder_language"), F.col("n_files").alias("folder_files")),
                          ["project", "folder"])


def fallback_questions(types: DataFrame, purposes: DataFrame | None = None) -> DataFrame:
    """Question rows by project type, in table order; the purpose question comes last."""
    rows = []
    for no, (kinds, question, answer) in enumerate(fixed.FALLBACK_QUESTIONS):
        for kind in kinds or fixed.PROJECT_TYPES + [fixed.UNKNOWN_TYPE]:
            rows.append((kind, no, question, answer))
    table = tables.constant(types.sparkSession, rows, "primary_type string, question_no int, question string, answer string")
    out = types.select("project", "primary_type").join(table, "primary_type").select("project", "question_no", "question", "answer")
    if purposes is None:
        return out
    return out.unionByName(purposes.filter(F.col("purpose") != "").select(
        "project", F.lit(len(fixed.FALLBACK_QUESTIONS)).alias("question_no"),
        F.lit(fixed.PURPOSE_QUESTION).alias("question"), F.col("purpose").alias("answer")))


def project_questions(types: DataFrame, purposes: DataFrame | None = None, fn: Callable | None = None) -> DataFrame:
    out = fallback_questions(types, purposes)
    return out if fn is None else out.mapInPandas(fn, out.schema)


def valid_qa(df: DataFrame, keys: list[str], order: list[Column], n: int = fixed.QUESTION_LIMIT) -> DataFrame:
    """Trimmed pairs with both sides present; the first n per key."""
    from codestrata.operators.stats import top_n
    trimmed = df.withColumns({"question": text.strip("question"), "answer": text.strip("answer")})
    return top_n(trimmed.filter((F.col("question") != "") & (F.col("answer") != "")), keys, order, n)
