"""One pass over file contents for everything a project analysis needs.

``scan`` computes all content facts of a file inside the read and keeps the text
only of the few kinds of file that later steps parse line by line (Makefiles,
compose files, migrations, configuration, READMEs).  The result is narrow; every
operator of the overview accepts it in place of ``files`` and picks up the
precomputed columns, so contents are read once however many facts are derived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codestrata.functions import fixed, text
from codestrata.operators import detection, discovery, edges, filters


def _parsed_later() -> Column:
    base = F.lower(text.basename("path"))
    return (base.isin(fixed.MAKE_FILES + fixed.COMPOSE_FILES + ["readme.md"])
            | filters.is_migration() | filters.is_config_source())


def scan(files: DataFrame) -> DataFrame:
    return files.select(
        "project", "path",
        F.octet_length("content").cast("bigint").alias("size"),
        F.when(_parsed_later(), F.col("content")).alias("content"),
        detection.startup_struct().alias("startup"),
        detection.manifest_struct().alias("manifest"),
        discovery.api_struct().alias("api"),
        edges.refs_column().alias("refs"))
