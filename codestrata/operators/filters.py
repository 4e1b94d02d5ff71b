"""File facts and rule-based file filters (all row-local, no shuffle)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from codestrata.functions import fixed, text


def file_facts(files: DataFrame) -> DataFrame:
    """Add size, ext, base, parent and depth to ``files(project, path, content)``."""
    size = F.col("size") if "size" in files.columns else F.octet_length("content").cast("bigint")
    return files.withColumns({
        "size": size,
        "ext": text.extension("path"),
        "base": text.basename("path"),
        "parent": text.dirname("path"),
        "depth": text.slashes("path"),
    })


# --- predicates ----------------------------------------------------------------

def in_pruned_dir(path: Column | str, tokens: Sequence[str] = fixed.PRUNED_DIRS,
                  max_depth: int | None = fixed.MAX_DEPTH) -> Column:
    """True when a folder above the file is pruned; no depth is too much if ``max_depth`` is None.

    Folder tests look for a token anywhere in the folder path, and every
    ancestor is a prefix of the direct parent; testing the parent is enough.
    """
    parent = text.dirname(path)
    nested = F.instr(text.col(path), "/") > 0
    named = text.contains_any(F.lower(parent), tokens)
    return nested & (named if max_depth is None else named | (text.slashes(parent) > max_depth))


def is_noise(path: Column | str) -> Column:
    low = F.lower(text.col(path))
    hit = text.contains_any(text.basename(low), fixed.NOISE_NAMES)
    for suffix, word in fixed.NOISE_PATH_PAIRS:
        hit = hit | (low.endswith(suffix) & low.contains(word))
    return hit | text.ends_with_any(low, fixed.NOISE_SUFFIXES)


def is_supported(path: Column | str, exts: Sequence[str] | None = fixed.SUPPORTED_EXTS, names: Sequence[str] = ()) -> Column:
    """By extension or, in any case, by file name; every file if ``exts`` is None."""
    if exts is None:
        return F.lit(True)
    return text.extension(path).isin(list(exts)) | F.lower(text.basename(path)).isin(list(names))


def is_secret_file(path: Column | str, globs: Sequence[str] = fixed.SECRET_FILE_GLOBS) -> Column:
    return text.basename(path).rlike("|".join(text.glob_regex(g) for g in globs))


def within_size(size: Column | str, mb: float = fixed.MAX_FILE_MB) -> Column:
    return text.col(size) <= F.lit(int(mb * 1024 * 1024))


# --- filters -------------------------------------------------------------------

def prune_dirs(files: DataFrame, tokens: Sequence[str] = fixed.PRUNED_DIRS,
               max_depth: int | None = fixed.MAX_DEPTH) -> DataFrame:
    return files.filter(~in_pruned_dir("path", tokens, max_depth))


def drop_noise(files: DataFrame) -> DataFrame:
    return files.filter(~is_noise("path"))


def supported(files: DataFrame, exts: Sequence[str] | None = fixed.SUPPORTED_EXTS, names: Sequence[str] = ()) -> DataFrame:
    return files.filter(is_supported("path", exts, names))


def size_cap(files: DataFrame, mb: float | None = fixed.MAX_FILE_MB) -> DataFrame:
    if mb is None:
        return files
    size = F.col("size") if "size" in files.columns else F.octet_length("content")
    return files.filter(within_size(size, mb))


def skip_secret_files(files: DataFrame, globs: Sequence[str] = fixed.SECRET_FILE_GLOBS) -> DataFrame:
    return files.filter(~is_secret_file("path", globs))


def redact(files: DataFrame) -> DataFrame:
    return files.withColumn("content", text.redacted("content"))


def redact_lines(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, text.redacted(column))


# --- selections ------------------------------------------------------------------

def important_files(files: DataFrame, chars: int | None = None) -> DataFrame:
    """Files that describe a project; ``chars`` cuts their texts, whole ones are kept by default."""
    kept = files.filter(text.contains_any(F.lower("path"), fixed.IMPORTANT_TOKENS))
    return kept if chars is None else kept.withColumn("content", text.truncated("content", chars))


def is_key_file(path: Column | str) -> Column:
    return text.contains_any(F.lower(text.col(path)), fixed.KEY_FILE_TOKENS)


def file_roles(files: DataFrame) -> DataFrame:
    base = F.lower(text.basename("path"))
    manifest = F.col("content").contains("apiVersion:") & text.contains_any("content", fixed.K8S_KINDS)
    return files.withColumns({
        "is_code": text.ends_with_any("path", fixed.CODE_EXTS),
        "is_config": text.ends_with_any(base, fixed.CONFIG_NAMES),
        "is_manifest": base.rlike(r"\.ya?ml$") & manifest,
    })


def is_config_source() -> Column:
    base = text.basename("path")
    pruned = text.dirname("path").rlike(rf"(?:^|/)(?:{text.alternation(fixed.CONFIG_SOURCE_PRUNED)})(?:/|$)")
    wanted = (base.startswith(".env") | base.rlike(r"\.ya?ml$") | base.isin(fixed.CONFIG_SOURCE_NAMES))
    return wanted & ~pruned


def config_files(files: DataFrame) -> DataFrame:
    """Configuration sources, outside dependency and build folders."""
    return files.filter(is_config_source())


def is_migration() -> Column:
    low = F.lower("path")
    return low.endswith(".sql") & text.dirname(low).contains("migration")


def migration_files(files: DataFrame) -> DataFrame:
    return files.filter(is_migration())


def detection_files(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Type-detection input: all files outside build folders, content of manifests only.

    ``max_bytes`` leaves out the content of larger manifests; none is left out by default.
    """
    keep = F.lower(text.basename("path")).isin(fixed.DETECTION_MANIFESTS)
    if max_bytes is not None:
        keep = keep & (F.octet_length("content") < max_bytes)
    return (files.filter(~text.contains_any("path", fixed.DETECTION_IGNORE))
            .withColumn("content", F.when(keep, F.col("content"))))
