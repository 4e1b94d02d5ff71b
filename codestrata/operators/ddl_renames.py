"""Renamed tables and columns, followed to the name that they have at the end of the log.

A rename at one place of the log ends what its old name stood for and begins what its new
name stands for; whatever had the new name before is replaced. Between two such places a name
stands for one thing. So a name and a place give a rename, that one the next, and so on to the
last name. The chains of all projects are shortened together by pointer jumping: the number
of steps is the logarithm of the longest chain, and only renames take part in it.

A reference follows the names alone, whatever was replaced or dropped in between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codestrata.session import cut_lineage

RENAMES = ("RENTBL", "RENCOL")


def any_renames(events: DataFrame) -> bool:
    return not events.filter(F.exists("facts", lambda f: f["op"].isin(*RENAMES))).isEmpty()


def _facts(events: DataFrame, op: str) -> DataFrame:
    return events.select("project", "tbl", "seq", F.explode(F.filter("facts", lambda f: f["op"] == op)).alias("f"))


def table_renames(events: DataFrame) -> DataFrame:
    """(project, old, new, at)"""
    found = _facts(events, "RENTBL").select("project", F.col("tbl").alias("old"), F.col("f.ref_tbl").alias("new"), F.col("seq").alias("at"))
    return found.groupBy("project", "at").agg(F.first("old").alias("old"), F.max("new").alias("new"))


def column_renames(events: DataFrame) -> DataFrame:
    """(project, tbl, old, new, at)"""
    return _facts(events, "RENCOL").select("project", "tbl", F.get("f.cols", F.lit(0)).alias("old"), F.get("f.ref_cols", F.lit(0)).alias("new"),
                                           F.struct("seq.path", "seq.stmt_no", "f.def_no").alias("at"))


def spans(renames: DataFrame, owner: list[str], by_name: bool = False) -> DataFrame:
    """(owner, name, after, until, final): behind ``after`` and up to ``until`` the name stands for what ``final`` is called at the end.

    ``final`` is null if it was replaced. ``by_name`` gives the spans for references.
    """
    renames = cut_lineage(renames.filter(F.col("old") != F.col("new")).select(*owner, "old", "new", "at"))
    cuts = renames.select(*owner, F.col("old").alias("name"), "at", F.lit(True).alias("leaves")).unionByName(
        renames.select(*owner, F.col("new").alias("name"), "at", F.lit(False).alias("leaves")))
    order = Window.partitionBy(*owner, "name").orderBy("at")
    behind = Window.partitionBy(*owner, "name").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    if by_name:
        cuts = cuts.withColumn("next", F.min(F.when(F.col("leaves"), F.col("at"))).over(behind)).withColumn("ends", F.col("next").isNull())
    else:
        cuts = cuts.withColumn("_cut", F.lead(F.struct("at", "leaves")).over(order))
        cuts = cuts.withColumn("next", F.when(F.col("_cut.leaves"), F.col("_cut.at"))).withColumn("ends", F.col("_cut").isNull())
    chains = _last_names(cuts.filter(~F.col("leaves")).select(*owner, "at", "next", F.when(F.col("ends"), F.col("name")).alias("final")), owner)
    if by_name:
        cuts = cuts.filter("leaves")
    closed = cuts.select(*owner, "name", F.lag("at").over(order).alias("after"), F.col("at").alias("until"), "leaves")
    open_ = cuts.groupBy(*owner, "name").agg(F.max("at").alias("after")).withColumn("final", F.col("name"))
    ended = closed.join(chains.select(*owner, F.col("at").alias("until"), F.col("final").alias("_final")), [*owner, "until"], "left")
    ended = ended.select(*owner, "name", "after", "until", F.when(F.col("leaves"), F.col("_final")).alias("final"))
    return cut_lineage(ended.unionByName(open_, allowMissingColumns=True))


def _last_names(chains: DataFrame, owner: list[str]) -> DataFrame:
    """Each rename jumps to where its next one points, until all know their last name."""
    chains = cut_lineage(chains)
    while not chains.filter("next is not null").isEmpty():
        hop = chains.select(*owner, F.col("at").alias("next"), F.col("next").alias("_next"), F.col("final").alias("_final"))
        chains = cut_lineage(chains.join(hop, [*owner, "next"], "left").select(
            *owner, "at", F.col("_next").alias("next"), F.when(F.col("next").isNull(), F.col("final")).otherwise(F.col("_final")).alias("final")))
    return chains


def followed(rows: DataFrame, found: DataFrame, name: str, at: Column, keep: bool = False) -> DataFrame:
    """Rows with the last name of the table in the column ``name``; those of replaced tables go, unless ``keep``."""
    table = found.select(F.col("project").alias("_project"), F.col("name").alias("_name"), "after", "until", "final", F.lit(True).alias("_renamed"))
    held = ((F.col("_project") == rows["project"]) & (F.col("_name") == rows[name])
            & (F.col("after").isNull() | (at > F.col("after"))) & (F.col("until").isNull() | (at <= F.col("until"))))
    met = rows.join(table, held, "left")
    if not keep:
        met = met.filter("_renamed is null or final is not null")
    return met.select(*[F.coalesce("final", rows[c]).alias(c) if c == name else rows[c] for c in rows.columns])


def with_columns(rows: DataFrame, found: DataFrame, listed: str, at: Column, tbl: str = "tbl", keep: bool = False) -> DataFrame:
    """Rows with the last names of the columns in the list ``listed``; replaced ones go, unless ``keep``.

    The renames of the columns of one table are one row.
    """
    table = found.groupBy("project", "tbl").agg(F.collect_list(F.struct("name", "after", "until", "final")).alias("_spans")).select(
        F.col("project").alias("_project"), F.col("tbl").alias("_tbl"), "_spans")
    met = rows.join(table, (F.col("_project") == rows["project"]) & (F.col("_tbl") == rows[tbl]), "left").withColumn("_at", at)

    def last(c: Column) -> Column:
        mine = F.get(F.filter("_spans", lambda s: (s["name"] == c) & (s["after"].isNull() | (F.col("_at") > s["after"]))
                              & (s["until"].isNull() | (F.col("_at") <= s["until"]))), F.lit(0))
        return F.coalesce(mine["final"], c) if keep else F.when(mine.isNull(), c).otherwise(mine["final"])

    names = F.when(F.col("_spans").isNull(), F.col(listed)).otherwise(F.array_compact(F.transform(listed, last)))
    return met.withColumn(listed, names).select(*rows.columns)
