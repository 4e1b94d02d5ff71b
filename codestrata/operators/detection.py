"""Project type detection.

Files are reduced to token facts (extension, parent folder, name keyword) inside
the scan.  Partial counts leave each task with at most one row per project and
rule token, whatever the size of the project, and the rule table joins those few
rows.  Manifest and startup tests read content of the few files they concern and
leave the scan as flags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codestrata.functions import fixed, text
from codestrata.functions.verdicts import confidence_band, interpretation
from codestrata.operators import tables


def _literals(tokens: list[str]) -> Column:
    return F.array(*[F.lit(t) for t in tokens])


def token_facts(files: DataFrame, rules=None) -> DataFrame:
    """``(project, kind, token, n, first_name)`` for every rule token that occurs."""
    base = F.lower(text.basename("path"))
    ext = text.extension("path")
    parent = F.lower(text.dirname("path"))
    words = tables.tokens_of(rules, "keyword")

    def fact(kind: str, token: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), token.alias("token"))

    fact_type = "array<struct<kind:string,token:string>>"
    empty = F.array().cast(fact_type)
    found = F.concat(
        F.when(ext.isin(tables.tokens_of(rules, "ext")), F.array(fact("ext", ext))).otherwise(empty),
        F.when(parent.isin(tables.tokens_of(rules, "dir")), F.array(fact("dir", parent))).otherwise(empty),
        F.when(text.contains_any(base, words),
               F.transform(F.filter(_literals(words), lambda w: F.contains(base, w)),
                           lambda w: fact("keyword", w))).otherwise(empty),
    ).cast(fact_type)
    return (files.select("project", base.alias("name"), F.explode(found).alias("f"))
            .groupBy("project", "f.kind", "f.token")
            .agg(F.count("*").alias("n"), F.min("name").alias("first_name")))


def match_rules(files: DataFrame, rules=None) -> DataFrame:
    """Token facts joined with the rules they belong to."""
    return token_facts(files, rules).join(
        tables.detection_rules(files.sparkSession, rules), ["kind", "token"])


def rule_matches(files: DataFrame, rules=None) -> DataFrame:
    """Score of every matched rule: once, plus a bonus per repeated extension."""
    bonus = F.when((F.col("kind") == "ext") & (F.col("n") > 1),
                   F.col("score") * F.col("n") * fixed.RULE_REPEAT_BONUS).otherwise(0.0)
    return (match_rules(files, rules).groupBy("project", "type", "rule")
            .agg((F.max("score") + F.sum(bonus)).alias("score")))


# --- flags read from content -----------------------------------------------------------

def manifest_struct() -> Column:
    """Dependency flags of a package manifest, null for any other file."""
    body = F.lower("content")
    is_manifest = F.lower("path").endswith("package.json") & (F.col("content") != "")
    return F.when(is_manifest, F.struct(
        text.contains_any(body, fixed.MANIFEST_FRONTEND_DEPS).alias("frontend_deps"),
        text.contains_any(body, fixed.MANIFEST_BACKEND_DEPS).alias("backend_deps"),
        text.contains_any(body, [s.lower() for s in fixed.MANIFEST_FRONTEND_SCRIPTS]).alias("frontend_scripts"),
        F.array_join(F.filter(_literals(fixed.MANIFEST_FRONTEND_DEPS), lambda t: F.contains(body, t)), " ").alias("frontend_list"),
        F.array_join(F.filter(_literals(fixed.MANIFEST_BACKEND_DEPS), lambda t: F.contains(body, t)), " ").alias("backend_list"),
    ))


def _startup_columns() -> dict[str, Column]:
    low_path, base, body = F.lower("path"), F.lower(text.basename("path")), F.lower("content")
    package = low_path.endswith("package.json") & F.contains(body, F.lit(fixed.STARTUP_PACKAGE_GATE))
    readme, make = base.contains("readme"), base.isin(fixed.STARTUP_MAKE_FILES)
    go = low_path.endswith("main.go") | low_path.contains("server.go") | low_path.contains("app.go")
    python = base.isin(fixed.STARTUP_PYTHON_FILES)

    def when(kind: Column, test: Column) -> Column:
        return F.when(kind, test).otherwise(F.lit(False))

    return {
        "frontend_package": when(package, text.contains_any(body, fixed.STARTUP_PACKAGE_FRONTEND)),
        "frontend_readme": when(readme, text.contains_any(body, fixed.STARTUP_README_FRONTEND)),
        "frontend_make": when(make, text.contains_any(body, fixed.STARTUP_MAKE_FRONTEND)),
        "backend_package": when(package, text.contains_any(body, fixed.STARTUP_PACKAGE_BACKEND)
                                | (text.contains_any(body, fixed.STARTUP_PACKAGE_BACKEND_DEPS)
                                   & text.contains_any(body, fixed.STARTUP_PACKAGE_BACKEND_DEP_SCRIPTS))),
        "backend_readme": when(readme, text.contains_any(body, fixed.STARTUP_README_BACKEND)),
        "backend_make": when(make, text.contains_any(body, fixed.STARTUP_MAKE_BACKEND)),
        "backend_go": when(go, text.contains_any(body, fixed.STARTUP_GO)),
        "backend_python": when(python, text.contains_any(body, fixed.STARTUP_PYTHON)),
    }


def startup_struct() -> Column:
    return F.struct(*[c.alias(n) for n, c in _startup_columns().items()])


def project_flags(files: DataFrame) -> DataFrame:
    """One row per project: startup flags and the manifest flags ``m``.

    All content tests of type detection share this single pass.  ``m`` belongs
    to the package manifest with the lowest path and is null without one.
    """
    columns = _startup_columns()
    if not {"startup", "manifest"} <= set(files.columns):
        files = files.select("project", "path", startup_struct().alias("startup"), manifest_struct().alias("manifest"))
    flags = files.select(
        "project", "startup.*", "manifest", F.when(F.col("manifest").isNotNull(), F.col("path")).alias("manifest_path"))
    # Few files raise a flag: only those rows are grouped, projects without any are added back.
    raised = flags.filter(F.greatest(*[F.col(n) for n in columns]) | F.col("manifest_path").isNotNull())
    grouped = raised.groupBy("project").agg(
        *[F.bool_or(n).alias(n) for n in columns],
        F.min_by("manifest", "manifest_path").alias("m"))
    every = files.select("project").distinct().join(grouped, "project", "left").na.fill(False, list(columns))
    any_of = {side: [n for n in columns if n.startswith(side)] for side in ("frontend", "backend")}
    return every.withColumns({
        f"has_{side}": F.greatest(*[F.col(n) for n in names]) for side, names in any_of.items()})


def startup_flags(files: DataFrame) -> DataFrame:
    """Does some file of the project start a frontend / a backend?"""
    return project_flags(files).drop("m")


def manifest_flags(files: DataFrame) -> DataFrame:
    return project_flags(files).filter("m IS NOT NULL").select("project", "m.*")


# --- scores, ranking, evidence --------------------------------------------------------

def scored(files: DataFrame, rules=None) -> DataFrame:
    """Flags of every project with its rule scores and adjusted scores as two short arrays."""
    per_type = rule_matches(files, rules).groupBy("project").agg(
        *[F.sum(F.when(F.col("type") == t, F.col("score"))).alias(f"s{i}") for i, t in enumerate(fixed.SCORED_TYPES)])
    wide = project_flags(files).join(per_type, "project", "left").withColumns({
        f"s{i}": F.round(F.coalesce(F.col(f"s{i}"), F.lit(0.0)), 6) for i in range(len(fixed.SCORED_TYPES))})
    front = F.coalesce(F.col("m.frontend_deps") | F.col("m.frontend_scripts"), F.lit(False))
    back = F.coalesce(F.col("m.backend_deps"), F.lit(False))
    both = F.coalesce(F.col("m.frontend_deps"), F.lit(False)) & back

    def adjusted(kind: str, score: Column) -> Column:
        if kind == "Frontend":
            return F.when(front, score + fixed.MANIFEST_FRONTEND_BOOST).otherwise(score)
        if kind == "Backend":
            return (F.when(front & ~back, score * fixed.MANIFEST_BACKEND_DAMPING)
                    .when(back & ~front, score + fixed.MANIFEST_BACKEND_BOOST).otherwise(score))
        return score

    def entry(kind: str, score: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.round(score, 6).alias("score"))

    raw = [(t, F.col(f"s{i}")) for i, t in enumerate(fixed.SCORED_TYPES)]
    full = F.when(both, F.array(entry("Fullstack", F.lit(fixed.MANIFEST_FULLSTACK_BOOST)))).otherwise(
        F.array().cast("array<struct<type:string,score:double>>"))
    return wide.select(
        "project", "has_frontend", "has_backend",
        F.array(*[entry(t, s) for t, s in raw]).alias("rule_scores"),
        F.concat(F.array(*[entry(t, adjusted(t, s)) for t, s in raw]), full).alias("scores"))


def rule_scores(files: DataFrame, rules=None) -> DataFrame:
    """One row per project and scored type, zero included."""
    return scored(files, rules).select("project", F.inline("rule_scores"))


def type_scores(files: DataFrame, rules=None) -> DataFrame:
    """Scores after the manifest adjustment; a Fullstack row appears where it applies."""
    return scored(files, rules).select("project", F.inline("scores"))


def rank_types(df: DataFrame) -> DataFrame:
    """Primary and secondary type from the ``scores`` array (at most eight entries).

    Ties fall to the type declared first; being so short, the array is ranked in place.
    """
    number = F.create_map(*[F.lit(x) for i, t in enumerate(fixed.PROJECT_TYPES) for x in (t, i)])
    positive = F.filter("scores", lambda e: e["score"] > 0)
    ranked = df.withColumn("r", F.array_sort(F.transform(
        positive, lambda e: F.struct((-e["score"]).alias("neg"), F.element_at(number, e["type"]).alias("no"), e["type"].alias("type")))))

    def score_of(kind: str) -> Column:
        return F.aggregate(F.filter("scores", lambda e: e["type"] == kind), F.lit(0.0), lambda s, e: s + e["score"])

    first, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    s1, s2 = F.coalesce(-first["neg"], F.lit(0.0)), F.coalesce(-second["neg"], F.lit(0.0))
    known = s1 >= 1.0
    return ranked.select(
        *df.columns,
        score_of("Frontend").alias("frontend_score"), score_of("Backend").alias("backend_score"),
        F.when(known, first["type"]).otherwise(fixed.UNKNOWN_TYPE).alias("primary_type"),
        F.when(known & (s2 >= 2.0) & (s1 - s2 >= 1.0), second["type"]).otherwise("").alias("secondary_type"),
        F.when(known, F.least(s1, F.lit(10.0))).otherwise(0.0).alias("confidence"),
        (s1 > 0).alias("has_evidence"))


def apply_fullstack(ranked: DataFrame) -> DataFrame:
    """Startup commands on both sides make a project Fullstack."""
    both = F.col("has_frontend") & F.col("has_backend")
    mean = F.least((F.col("frontend_score") + F.col("backend_score")) / 2.0, F.lit(10.0))
    return ranked.withColumns({
        "primary_type": F.when(both, "Fullstack").otherwise(F.col("primary_type")),
        "confidence": F.round(F.when(both, mean).otherwise(F.col("confidence")), 6)})


def project_type(files: DataFrame, rules=None) -> DataFrame:
    typed = apply_fullstack(rank_types(scored(files, rules)))
    return typed.select(
        "project", "primary_type", "secondary_type", "confidence",
        confidence_band("confidence").alias("band"),
        interpretation("primary_type", "confidence", "has_evidence").alias("interpretation"))


def type_evidence(files: DataFrame, rules=None) -> DataFrame:
    """``(project, evidence_key, evidence)``; a rule lists its tokens in rule order.

    The list per rule is bounded by the number of tokens of the rule.
    """
    item = (F.when(F.col("kind") == "ext", F.concat("label", F.lit(" files ("), F.col("n").cast("string"), F.lit(")")))
            .when(F.col("kind") == "dir", F.concat("label", F.lit(" directory")))
            .otherwise(F.concat(F.lit("file: "), F.col("first_name"))))
    by_rule = (match_rules(files, rules)
               .groupBy("project", "type", "rule")
               .agg(F.array_sort(F.collect_list(F.struct("pos", item.alias("item")))).alias("items"))
               .select("project", F.col("type").alias("evidence_key"),
                       F.concat("rule", F.lit(": "), F.array_join(F.transform("items", lambda i: i["item"]), ", ")).alias("evidence")))
    flags = project_flags(files)
    m = flags.filter("m IS NOT NULL").select("project", "m.*")
    front, back = F.col("frontend_deps"), F.col("backend_deps")

    def row(when: Column, key: str, value: Column | str) -> Column:
        value = F.lit(value) if isinstance(value, str) else value
        return F.when(when, F.struct(F.lit(key).alias("evidence_key"), value.alias("evidence")))

    extra = m.select("project", F.explode(F.array_compact(F.array(
        row(front, "Frontend Intelligence", F.concat(F.lit("Strong frontend dependencies detected: ["), F.col("frontend_list"), F.lit("]"))),
        row(F.col("frontend_scripts"), "Frontend Intelligence", "Frontend build/dev scripts detected in package.json"),
        row(back & ~front & ~F.col("frontend_scripts"), "Backend Intelligence",
            F.concat(F.lit("Backend dependencies detected: ["), F.col("backend_list"), F.lit("]"))),
        row(front & back, "Fullstack Intelligence",
            "Both frontend and backend dependencies detected - likely fullstack/monorepo"),
    ))).alias("e")).select("project", "e.*")
    command = (flags.filter("has_frontend AND has_backend")
               .select("project", F.lit("Fullstack").alias("evidence_key"),
                       F.lit("Command-based detection: Found both frontend and backend startup commands").alias("evidence")))
    return by_rule.unionByName(extra).unionByName(command)
