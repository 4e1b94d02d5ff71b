"""Dependency order of tables and the consolidated script."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codestrata.operators.ddl import TABLE, Schema
from codestrata.session import cut_lineage


def table_order(tables: DataFrame, fks: DataFrame) -> DataFrame:
    """``(project, tbl, round)``; sort by round (nulls last) and name.

    A table is ready once all tables it references are placed; inside a round
    tables are placed by name, and one placed earlier in the round already
    counts.  So the round is the largest ``round(ref) + [ref > tbl]``, a longest
    path over the foreign-key graph, found for all projects at once: each step
    places every table whose references are all placed.  Tables behind a cycle or
    an unknown table are never ready and keep a null round.

    The number of steps is the longest reference chain, not the number of tables.
    Each step cuts its lineage with a written table.
    """
    edges = cut_lineage(fks.select(*TABLE, "ref_tbl").filter(F.col("ref_tbl") != F.col("tbl")).distinct())
    all_tables = cut_lineage(tables.select(*TABLE).distinct())
    placed = cut_lineage(all_tables.join(edges, TABLE, "left_anti").withColumn("round", F.lit(1)))
    fresh, pending = placed, edges.withColumn("need", F.lit(1))
    while not fresh.isEmpty():
        refs = fresh.select("project", F.col("tbl").alias("ref_tbl"), "round")
        # resolve the references to tables placed in the last step
        pending = cut_lineage(
            pending.join(refs, ["project", "ref_tbl"], "left")
            .withColumn("need", F.when(F.col("round").isNotNull(),
                                       -(F.col("round") + (F.col("ref_tbl") > F.col("tbl")).cast("int"))).otherwise(F.col("need")))
            .drop("round"))
        # need = 1: still open; need < 0: minus the round this reference asks for
        state = pending.groupBy(*TABLE).agg(F.max("need").alias("open"), (-F.min("need")).alias("round"))
        ready = state.filter("open < 0").select(*TABLE, "round")
        fresh = cut_lineage(ready.join(placed, TABLE, "left_anti"))
        placed = cut_lineage(placed.unionByName(fresh))
        pending = pending.join(fresh, TABLE, "left_anti")
    return all_tables.join(placed, TABLE, "left").select(*TABLE, "round")


def ddl_script(schema: Schema) -> DataFrame:
    """Statements that recreate the live schema, in row form.

    Sort by (project, section, round nulls last, name): enums, tables in
    dependency order, indexes, views.  Each table statement lists its columns by
    name; that list is bounded by the width of one table.
    """
    comma = lambda c: F.array_join(c, ", ")
    cols = schema.columns.select(
        *TABLE, F.lit(0).alias("rank"), F.concat(
            F.lit("    "), "col", F.lit(" "), "type", F.when(~F.col("nullable"), " NOT NULL").otherwise(""),
            F.when(F.col("default").isNotNull(), F.concat(F.lit(" DEFAULT "), "default")).otherwise("")).alias("text"))
    keys = schema.keys.select(*TABLE, F.when(F.col("kind") == "PK", 1).otherwise(2).alias("rank"), F.concat(
        F.when(F.col("kind") == "PK", "    PRIMARY KEY (").otherwise("    UNIQUE ("), comma("cols"), F.lit(")")).alias("text"))
    fks = schema.fks.select(*TABLE, F.lit(3).alias("rank"), F.concat(
        F.lit("    CONSTRAINT "), "name", F.lit(" FOREIGN KEY ("), comma("cols"), F.lit(") REFERENCES "), "ref_tbl",
        F.lit(" ("), comma("ref_cols"), F.lit(")")).alias("text"))
    lines = cols.unionByName(keys).unionByName(fks)
    bodies = lines.groupBy(*TABLE).agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("lines"))
    rounds = table_order(schema.tables, schema.fks)
    tables = rounds.join(bodies, TABLE, "left").select(
        "project", F.lit(2).alias("section"), "round", F.col("tbl").alias("name"), F.concat(
            F.lit("CREATE TABLE "), "tbl", F.lit(" (\n"),
            F.coalesce(F.array_join(F.transform("lines", lambda e: e["text"]), ",\n"), F.lit("")), F.lit("\n);")).alias("statement"))
    none = F.lit(None).cast("int").alias("round")
    enums = schema.enums.select("project", F.lit(1).alias("section"), none, "name", F.concat(
        F.lit("CREATE TYPE "), "name", F.lit(" AS ENUM (\n"),
        F.array_join(F.transform("vals", lambda v: F.concat(F.lit("    '"), v, F.lit("'"))), ",\n"), F.lit("\n);")).alias("statement"))
    indexes = schema.indexes.select("project", F.lit(3).alias("section"), none, "name", F.concat(
        F.lit("CREATE "), F.when(F.col("is_unique"), "UNIQUE ").otherwise(""), F.lit("INDEX "), "name", F.lit(" ON "), "tbl",
        F.lit(" ("), comma("cols"), F.lit(");")).alias("statement"))
    views = schema.views.select("project", F.lit(4).alias("section"), none, "name", F.concat("sql", F.lit(";")).alias("statement"))
    return enums.unionByName(tables).unionByName(indexes).unionByName(views)
