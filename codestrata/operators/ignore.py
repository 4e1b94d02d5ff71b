"""Ignore rules: later rules win, and an ignored folder hides its whole subtree.

A project's own rules come from one file, so they travel as one array per
project.  Each path folds over that array, so no (path, rule) pairs are formed,
and the files do not move while the rules fit a checked broadcast size.  The default rules contain no slash and no negation, so
they collapse into one alternation over the base name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from codestrata.functions import fixed, text
from codestrata.session import size_in_bytes

SALTS = 32
RULE = "struct<rule_no:int,regex:string,literal:string,kind:string,negate:boolean,dir_only:boolean,absolute:boolean>"


def _rule(line: Column, number: Column) -> Column:
    negate = line.startswith("!")
    body = F.when(negate, F.substring(line, 2, 2_147_483_647)).otherwise(line)
    dir_only = body.endswith("/")
    body = F.when(dir_only, F.left(body, F.length(body) - 1)).otherwise(body)
    absolute = body.startswith("/")
    body = F.when(absolute, F.substring(body, 2, 2_147_483_647)).otherwise(body)
    regex = F.regexp_replace(body, r"([.^$*+?{}\[\]\\|()])", r"\\$1")
    for mark, meaning in [(r"\*\*", ".*"), (r"\*", "[^/]*"), (r"\?", ".")]:
        regex = F.replace(regex, F.lit(mark), F.lit(meaning))
    kind = (F.when(~body.rlike(r"[*?]"), "literal")
            .when(body.rlike(r"^\*[^*?/]*$"), "suffix").otherwise("pattern"))
    return F.struct(
        number.cast("int").alias("rule_no"),
        F.concat(F.lit("^"), regex, F.lit("$")).alias("regex"),
        F.when(kind == "suffix", F.substring(body, 2, 2_147_483_647)).otherwise(body).alias("literal"),
        kind.alias("kind"), negate.alias("negate"), dir_only.alias("dir_only"), absolute.alias("absolute"),
    )


def parse_ignore(files: DataFrame, name: str = ".gitignore") -> DataFrame:
    """``(project, rules)``: the parsed root ignore file of each project."""
    lines = F.transform(F.split("content", "\n"), lambda line: text.strip(line))
    rules = F.filter(
        F.transform(lines, lambda line, i: F.when((line != "") & ~line.startswith("#"), _rule(line, i + 1))),
        lambda r: r.isNotNull())
    return files.filter(F.col("path") == name).select("project", rules.cast(f"array<{RULE}>").alias("rules"))


def ignore_rules(files: DataFrame, name: str = ".gitignore") -> DataFrame:
    """One row per project rule."""
    return parse_ignore(files, name).select("project", F.inline("rules"))


def _default_patterns(rules: Sequence[str]) -> tuple[str, str]:
    """(pattern for files, pattern for folders) over base names."""
    if any(r.startswith("!") or "/" in r.rstrip("/") for r in rules):
        raise ValueError("default rules must be plain names without negation or inner slash")
    files = [text.glob_regex(r) for r in rules if not r.endswith("/")]
    folders = files + [text.glob_regex(r[:-1]) for r in rules if r.endswith("/")]
    return "|".join(files), "|".join(folders)


def _matches(rule: Column, value: Column) -> Column:
    return (F.when(rule["kind"] == "literal", value == rule["literal"])
            .when(rule["kind"] == "suffix", value.endswith(rule["literal"]) & (F.instr(value, "/") == 0))
            .otherwise(F.rlike(value, rule["regex"])))


def _decide(path: Column, is_dir: bool, rules: Column, start: Column) -> Column:
    """Fold the rules over one path; the last rule that matches decides."""
    base = text.basename(path)

    def step(state: Column, rule: Column) -> Column:
        hit = _matches(rule, path) | (~rule["absolute"] & _matches(rule, base))
        if not is_dir:
            hit = hit & ~rule["dir_only"]
        return F.when(hit, ~rule["negate"]).otherwise(state)

    return F.aggregate(rules, start, step)


def _marks(path: Column, rules: Column | None, defaults: Sequence[str]) -> tuple[Column, Column]:
    """(own path ignored, some folder above ignored)."""
    file_re, dir_re = _default_patterns(defaults)
    own = text.basename(path).rlike(file_re)
    above = (F.instr(path, "/") > 0) & F.exists(F.split(text.dirname(path), "/"), lambda s: s.rlike(dir_re))
    if rules is None:
        return own, above
    has = F.size(F.coalesce(rules, F.array().cast(f"array<{RULE}>"))) > 0
    tree = F.exists(text.ancestors(path), lambda d: _decide(d, True, rules, text.basename(d).rlike(dir_re)))
    return (F.when(has, _decide(path, False, rules, own)).otherwise(own),
            F.when(has, tree).otherwise(above))


def with_ignored(files: DataFrame, rules: DataFrame | None = None,
                 defaults: Sequence[str] = tuple(fixed.DEFAULT_IGNORE)) -> DataFrame:
    """Add ``file_ignored`` (own path) and ``tree_ignored`` (some folder above)."""
    path = F.col("path")
    if rules is not None:
        files = files.join(rules, "project", "left")
    own, above = _marks(path, None if rules is None else F.col("rules"), defaults)
    return files.withColumns({"file_ignored": own, "tree_ignored": above}).drop("rules")


def apply_ignore(files: DataFrame, rules: DataFrame | None = None,
                 defaults: Sequence[str] = tuple(fixed.DEFAULT_IGNORE),
                 broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Drop ignored files.

    Rules up to ``broadcast_bytes`` travel to the files, which then never move.
    Beyond that the decision is made on (project, path) alone, with salted rules
    so that one huge project spreads over many tasks, and the ignored paths are
    removed by an anti join on (project, path), whose keys are unique.
    """
    if rules is None:
        own, above = _marks(F.col("path"), None, defaults)
        return files.filter(~own & ~above)
    if size_in_bytes(rules) <= broadcast_bytes:
        marked = with_ignored(files, F.broadcast(rules), defaults)
        return marked.filter(~F.col("file_ignored") & ~F.col("tree_ignored")).drop("file_ignored", "tree_ignored")
    own, above = _marks(F.col("path"), F.col("rules"), defaults)
    salted = rules.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    keys = files.select("project", "path").withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int"))
    ignored = keys.join(salted, ["project", "salt"], "left").filter(own | above).select("project", "path")
    return files.join(ignored, ["project", "path"], "left_anti")
