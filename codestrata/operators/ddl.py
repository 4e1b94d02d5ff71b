"""Fold an ordered DDL log into the live schema of many projects at once.

The log is never replayed row by row.  Its effect has a closed form over three
per-table facts: the last DROP, the first event after it, and for each column the
last event that concerns it.  Each of these is a min / max aggregate with partial
states, so a table with very many events costs no more than any other.  ``seq``
(path, statement number) is the order of the log inside a project.

RENAME takes effect at its place in the log: statements before it that name the table or column count
for the new name, and so do foreign keys that refer to it. Other actions of the same statement come
first if they concern the table's name. A table or column that has the new name already is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codestrata.functions import ddl, text
from codestrata.operators import ddl_renames
from codestrata.operators.filters import migration_files

TABLE = ["project", "tbl"]


def statements(migrations: DataFrame) -> DataFrame:
    """Every cleaned, non-empty statement with its kind (null if unsupported)."""
    raw = migrations.select("project", "path", F.posexplode(ddl.raw_statements("content")).alias("stmt_no", "raw"))
    cleaned = raw.select("project", "path", "stmt_no", ddl.clean_statement("raw").alias("stmt")).filter(F.col("stmt") != "")
    typed = cleaned.withColumn("type", ddl.statement_type("stmt"))
    return typed.withColumn("tbl", ddl.statement_table("stmt", "type"))


def ddl_events(files: DataFrame) -> DataFrame:
    """Supported statements of all migration files."""
    return statements(migration_files(files)).filter(F.col("type").isNotNull())


def ddl_errors(files: DataFrame) -> DataFrame:
    """Statements that are counted and skipped, by project."""
    s = statements(migration_files(files))
    kind = F.col("type")
    failed = (F.when(kind == "CREATE_TABLE", ~ddl.create_is_valid("stmt"))
              .when(kind == "ALTER_TABLE", ~ddl.alter_is_valid("stmt"))
              .when(kind == "CREATE_INDEX", ddl.index_parts("stmt").isNull())
              .when(kind == "CREATE_TYPE", ddl.enum_values("stmt").isNull()).otherwise(F.lit(False))
              | (kind.isin("CREATE_TABLE", "DROP_TABLE", "ALTER_TABLE", "CREATE_VIEW", "DROP_VIEW") & (ddl.object_name("stmt") == "")))
    return s.groupBy("project").agg(
        F.count("*").alias("n_statements"),
        F.count_if(F.col("type").isNull()).alias("n_unsupported"),
        F.count_if(F.coalesce(failed, F.lit(False))).alias("n_failed"))


def _seq() -> Column:
    return F.struct("path", "stmt_no")


def table_events(events: DataFrame) -> DataFrame:
    """CREATE (valid ones), ALTER and DROP events with their facts."""
    kinds = events.filter(F.col("type").isin("CREATE_TABLE", "ALTER_TABLE", "DROP_TABLE") & (F.col("tbl") != ""))
    empty = F.array().cast(f"array<{ddl.FACT}>")
    facts = (F.when(F.col("type") == "CREATE_TABLE", ddl.create_facts("stmt"))
             .when(F.col("type") == "ALTER_TABLE", ddl.alter_facts("stmt")).otherwise(empty))
    return (kinds.filter((F.col("type") != "CREATE_TABLE") | ddl.create_is_valid("stmt"))
            .select("project", "tbl", "type", _seq().alias("seq"), facts.alias("facts")))


def table_lives(events: DataFrame) -> DataFrame:
    """Live tables: ``(project, tbl, last_drop, first_seq, first_type)``.

    A table lives when something created or altered it after its last DROP.  The
    first event of that life decides whether a CREATE took effect: a later CREATE
    met an existing table and is ignored.
    """
    narrow = events.select("project", "tbl", "type", "seq")
    last = narrow.groupBy(*TABLE).agg(
        F.max(F.when(F.col("type") == "DROP_TABLE", F.col("seq"))).alias("last_drop"),
        F.max(F.when(F.col("type") != "DROP_TABLE", F.col("seq"))).alias("last_use"))
    alive = last.filter(F.col("last_use").isNotNull() & (F.col("last_drop").isNull() | (F.col("last_use") > F.col("last_drop"))))
    later = narrow.join(alive.select(*TABLE, "last_drop"), TABLE).filter(
        (F.col("type") != "DROP_TABLE") & (F.col("last_drop").isNull() | (F.col("seq") > F.col("last_drop"))))
    return later.groupBy(*TABLE).agg(
        F.max("last_drop").alias("last_drop"), F.min(F.struct("seq", "type")).alias("f")).select(
        *TABLE, "last_drop", F.col("f.seq").alias("first_seq"), F.col("f.type").alias("first_type"))


def live_facts(events: DataFrame, lives: DataFrame) -> DataFrame:
    """Facts of the current life of each table; facts of ignored CREATEs are gone."""
    current = F.col("last_drop").isNull() | (F.col("seq") > F.col("last_drop"))
    effective = (F.col("type") != "CREATE_TABLE") | (F.col("seq") == F.col("first_seq"))
    joined = events.filter(F.size("facts") > 0).join(lives.drop("first_type"), TABLE).filter(current & effective)
    return joined.select(*TABLE, "seq", F.inline("facts")).withColumn("at", F.struct("seq.path", "seq.stmt_no", "def_no"))


def live_tables(lives: DataFrame) -> DataFrame:
    return lives.select(*TABLE, F.col("first_seq.path").alias("since_path"),
                        F.when(F.col("first_type") == "CREATE_TABLE", "create").otherwise("alter").alias("origin"))


def live_columns(facts: DataFrame) -> DataFrame:
    """Columns whose last structural event is not a DROP.

    Each attribute keeps its latest assignment: a definition sets all of them, a
    change only some.  Changes before the last definition lose, changes to a
    missing column have no effect.  ``is_pk`` needs a key fact after the last DROP
    of the column.
    """
    f = facts.filter(F.col("op").isin("ADD", "DROPCOL", "SETCOL", "PK")).select(
        *TABLE, "op", "at", "type", "nullable", "sets_default", "default", F.explode("cols").alias("col"))
    is_def = F.col("op").isin("ADD", "SETCOL")
    when = lambda test: F.when(test, F.col("at"))
    state = f.groupBy(*TABLE, "col").agg(
        F.max(when(F.col("op") == "ADD")).alias("added"),
        F.max(when(F.col("op") == "DROPCOL")).alias("dropped"),
        F.max(when(F.col("op") == "PK")).alias("keyed"),
        F.max_by("type", when(is_def & F.col("type").isNotNull())).alias("type"),
        F.max_by("nullable", when(is_def & F.col("nullable").isNotNull())).alias("nullable"),
        F.max_by(F.struct("default"), when(is_def & F.col("sets_default"))).alias("d"))
    alive = F.col("added").isNotNull() & (F.col("dropped").isNull() | (F.col("added") > F.col("dropped")))
    is_pk = F.col("keyed").isNotNull() & (F.col("dropped").isNull() | (F.col("keyed") > F.col("dropped")))
    return state.filter(alive).select(*TABLE, "col", "type", "nullable", F.col("d.default").alias("default"), is_pk.alias("is_pk"))


def _drops(facts: DataFrame) -> DataFrame:
    return (facts.filter(F.col("op") == "DROPCOL").select(*TABLE, F.explode("cols").alias("col"), "at")
            .groupBy(*TABLE, "col").agg(F.max("at").alias("dropped")))


def key_sets(facts: DataFrame) -> DataFrame:
    """Primary keys (one set per table) and unique sets, without columns dropped later.

    The lists hold the columns of one key definition, sorted.
    """
    keys = facts.filter(F.col("op").isin("PK", "UNIQUE")).select(*TABLE, "op", "at", F.explode("cols").alias("col"))
    kept = (keys.join(_drops(facts), [*TABLE, "col"], "left")
            .filter(F.col("dropped").isNull() | (F.col("at") > F.col("dropped"))))
    group = F.when(F.col("op") == "UNIQUE", F.col("at"))
    return (kept.groupBy(*TABLE, F.col("op").alias("kind"), group.alias("group")).agg(F.array_sort(F.collect_set("col")).alias("cols"))
            .select(*TABLE, "kind", "cols", "group"))


def foreign_keys(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("op") == "FK").select(
        *TABLE, F.concat_ws("_", F.lit("fk"), "tbl", F.array_join("cols", "_")).alias("name"),
        "cols", "ref_tbl", "ref_cols", "at")


def enum_rows(events: DataFrame) -> DataFrame:
    """Every definition of an enum type that parses."""
    rows = events.filter(F.col("type") == "CREATE_TYPE").select(
        "project", ddl.object_name("stmt").alias("name"), _seq().alias("seq"), ddl.enum_values("stmt").alias("vals"))
    return rows.filter(F.col("vals").isNotNull())


def enums(rows: DataFrame) -> DataFrame:
    """Latest definition of every enum type."""
    return rows.groupBy("project", "name").agg(F.max_by("vals", "seq").alias("vals"))


def view_rows(events: DataFrame) -> DataFrame:
    """Every CREATE and DROP of a view."""
    return (events.filter(F.col("type").isin("CREATE_VIEW", "DROP_VIEW"))
            .select("project", ddl.object_name("stmt").alias("name"), "type", _seq().alias("seq"), "stmt").filter(F.col("name") != ""))


def views(rows: DataFrame) -> DataFrame:
    """Views whose last event is a CREATE."""
    last = rows.groupBy("project", "name").agg(F.max_by(F.struct("type", "stmt"), "seq").alias("e"))
    return last.filter(F.col("e.type") == "CREATE_VIEW").select("project", "name", F.col("e.stmt").alias("sql"))


def index_rows(events: DataFrame) -> DataFrame:
    """Every CREATE INDEX that parses."""
    rows = events.filter(F.col("type") == "CREATE_INDEX").select("project", ddl.index_parts("stmt").alias("i"), _seq().alias("seq"))
    return rows.filter(F.col("i").isNotNull()).select("project", "i.tbl", "i.name", "i.is_unique", "i.cols", "seq")


def indexes(rows: DataFrame, lives: DataFrame) -> DataFrame:
    """Indexes created while their table was alive."""
    current = rows.join(lives, TABLE).filter(F.col("seq") > F.col("first_seq"))
    return (current.groupBy(*TABLE, "name").agg(F.max_by(F.struct("is_unique", "cols"), "seq").alias("i"))
            .select(*TABLE, "name", "i.is_unique", "i.cols"))


class Schema:
    """The live schema of all projects as DataFrames over one parsed event log.

    ``persist`` writes the parsed log and the table lives to the shared folder, so
    the eight tables below do not parse the files again.
    """

    def __init__(self, files: DataFrame, persist: bool = False):
        from codestrata.session import cut_lineage
        keep = cut_lineage if persist else (lambda df: df)
        log = keep(ddl_events(files))
        self._fold(keep(table_events(log)), enum_rows(log), view_rows(log), index_rows(log), keep)

    @classmethod
    def of(cls, events: DataFrame, enums: DataFrame, views: DataFrame, indexes: DataFrame, persist: bool = False) -> Schema:
        """The schema behind parsed rows, as ``table_events``, ``enum_rows``, ``view_rows`` and ``index_rows`` give them.

        ``persist`` writes the table lives and their facts to the shared folder.
        """
        from codestrata.session import cut_lineage
        schema = cls.__new__(cls)
        schema._fold(events, enums, views, indexes, cut_lineage if persist else (lambda df: df))
        if persist:
            schema.facts = cut_lineage(schema.facts)
        return schema

    def _fold(self, events: DataFrame, enums: DataFrame, views: DataFrame, indexes: DataFrame, keep) -> None:
        renamed = ddl_renames.any_renames(events)
        if renamed:
            renames = ddl_renames.table_renames(events)
            tables, references = ddl_renames.spans(renames, ["project"]), ddl_renames.spans(renames, ["project"], by_name=True)
            events, indexes = (keep(ddl_renames.followed(df, tables, "tbl", df["seq"])) for df in (events, indexes))
        self.events, self._enums, self._views, self._indexes = events, enums, views, indexes
        self.lives = keep(table_lives(events))
        self.facts = live_facts(events, self.lives)
        if renamed:
            columns = ddl_renames.spans(ddl_renames.column_renames(
                events.join(self.lives.select(*TABLE, "last_drop"), TABLE).filter("last_drop is null or seq > last_drop")), TABLE)
            referred = ddl_renames.spans(ddl_renames.column_renames(events), TABLE, by_name=True)
            at = F.col("at")
            facts = ddl_renames.with_columns(self.facts, columns, "cols", at)
            facts = ddl_renames.followed(facts, references, "ref_tbl", facts["seq"], keep=True)
            self.facts = keep(ddl_renames.with_columns(facts, referred, "ref_cols", at, tbl="ref_tbl", keep=True))
            self._indexes = ddl_renames.with_columns(
                indexes, columns, "cols", F.struct("seq.path", "seq.stmt_no", F.lit(0).alias("def_no")), keep=True)

    @property
    def tables(self) -> DataFrame:
        return live_tables(self.lives)

    @property
    def columns(self) -> DataFrame:
        return live_columns(self.facts)

    @property
    def keys(self) -> DataFrame:
        return key_sets(self.facts)

    @property
    def fks(self) -> DataFrame:
        return foreign_keys(self.facts)

    @property
    def enums(self) -> DataFrame:
        return enums(self._enums)

    @property
    def views(self) -> DataFrame:
        return views(self._views)

    @property
    def indexes(self) -> DataFrame:
        return indexes(self._indexes, self.lives)

    def annotated(self) -> DataFrame:
        """Columns with key flags and the latest single reference."""
        unique = (self.keys.filter((F.col("kind") == "UNIQUE") & (F.size("cols") == 1))
                  .select(*TABLE, F.get("cols", F.lit(0)).alias("col")).distinct().withColumn("is_unique", F.lit(True)))
        fk = (self.fks.select(*TABLE, F.explode("cols").alias("col"), "ref_tbl", F.get("ref_cols", F.lit(0)).alias("ref_col"), "at")
              .groupBy(*TABLE, "col").agg(F.max_by(F.struct("ref_tbl", "ref_col"), F.struct("at", "ref_tbl", "ref_col")).alias("ref")))
        return (self.columns.join(unique, [*TABLE, "col"], "left").join(fk, [*TABLE, "col"], "left")
                .withColumn("is_unique", F.coalesce("is_unique", F.lit(False)))
                .withColumn("is_fk", F.col("ref").isNotNull())
                .select(*TABLE, "col", "type", "nullable", "default", "is_pk", "is_unique", "is_fk",
                        F.col("ref.ref_tbl").alias("ref_tbl"), F.col("ref.ref_col").alias("ref_col")))


def erd_columns(schema: Schema) -> DataFrame:
    marks = F.array_join(F.array_compact(F.array(
        F.when(F.col("is_pk"), "PK"), F.when(F.col("is_unique"), "UK"), F.when(F.col("is_fk"), "FK"))), ",")
    return schema.annotated().select(*TABLE, "col", "type", marks.alias("annotation"))


def erd_edges(schema: Schema) -> DataFrame:
    single = schema.fks.filter((F.size("cols") == 1) & (F.size("ref_cols") == 1))
    c, r = F.get("cols", F.lit(0)), F.get("ref_cols", F.lit(0))
    return single.select("project", F.col("ref_tbl").alias("parent_tbl"), F.col("tbl").alias("child_tbl"),
                         F.concat(c, F.lit(" -> "), F.col("ref_tbl"), F.lit("."), r).alias("label")).distinct()


def erd_text(schema: Schema) -> DataFrame:
    """Diagram lines in row form: sort by (project, part, tbl, rank, sort_key)."""
    blank = F.lit("")
    head = schema.tables.select("project").distinct().select(
        "project", F.lit(0).alias("part"), blank.alias("tbl"), F.lit(0).alias("rank"), blank.alias("sort_key"), F.lit("erDiagram").alias("line"))
    opens = schema.tables.select("project", F.lit(1).alias("part"), "tbl", F.lit(0).alias("rank"), blank.alias("sort_key"),
                                 F.concat(F.lit("  "), "tbl", F.lit(" {")).alias("line"))
    cols = erd_columns(schema).select(
        "project", F.lit(1).alias("part"), "tbl", F.lit(1).alias("rank"), F.col("col").alias("sort_key"),
        F.concat(F.lit("    "), "type", F.lit(" "), "col",
                 F.when(F.col("annotation") != "", F.concat(F.lit(" "), "annotation")).otherwise("")).alias("line"))
    closes = schema.tables.select("project", F.lit(1).alias("part"), "tbl", F.lit(2).alias("rank"), blank.alias("sort_key"), F.lit("  }").alias("line"))
    links = erd_edges(schema).select(
        "project", F.lit(2).alias("part"), F.col("child_tbl").alias("tbl"), F.lit(0).alias("rank"), F.col("label").alias("sort_key"),
        F.concat(F.lit("  "), "parent_tbl", F.lit(" ||--o{ "), "child_tbl", F.lit(' : "'), "label", F.lit('"')).alias("line"))
    out = head
    for part in (opens, cols, closes, links):
        out = out.unionByName(part)
    return out


def column_constraints(schema: Schema) -> DataFrame:
    listed = F.array_join(F.array_compact(F.array(
        F.when(~F.col("nullable"), "not null"), F.when(F.col("default").isNotNull(), "default"),
        F.when(F.col("is_pk"), "PK"), F.when(F.col("is_unique"), "unique"), F.when(F.col("is_fk"), "FK"))), ",")
    ref = F.when(F.col("is_fk"), F.concat("ref_tbl", F.lit("."), "ref_col")).otherwise("")
    return schema.annotated().select(*TABLE, "col", "type", listed.alias("constraints"),
                                     F.coalesce("default", F.lit("")).alias("default_value"), ref.alias("reference"))


def schema_counts(schema: Schema, projects: DataFrame) -> DataFrame:
    n = lambda df, name, test=None: df.groupBy("project").agg(
        (F.count("*") if test is None else F.count_if(test)).alias(name))
    columns = schema.annotated().groupBy("project").agg(
        F.count("*").alias("n_columns"), F.count_if("is_fk").alias("n_references"))
    out = projects.select("project").distinct()
    for part in (n(schema.tables, "n_tables"), columns, n(schema.enums, "n_enums"), n(schema.views, "n_views"), n(schema.indexes, "n_indexes")):
        out = out.join(part, "project", "left")
    return out.na.fill(0)


def implicit_refs(schema: Schema, suffix: str = "_id") -> DataFrame:
    """Columns named after a live table without a foreign key to it.

    ``x_id`` points to ``x``, ``xs``, ``xes`` or (``xy`` -> ``xies``); ``parent_id``
    points to its own table.  Equi join on the few possible names.
    """
    stem = F.regexp_extract("col", f"^(.+){suffix}$", 1)
    plural_y = F.when(stem.endswith("y"), F.concat(F.left(stem, F.length(stem) - 1), F.lit("ies")))
    names = F.array_compact(F.array(stem, F.concat(stem, F.lit("s")), F.concat(stem, F.lit("es")), plural_y,
                                    F.when(stem == "parent", F.col("tbl"))))
    wanted = schema.columns.filter(stem != "").select(*TABLE, "col", F.posexplode(names).alias("rank", "target"))
    targets = schema.tables.select("project", F.col("tbl").alias("target"))
    found = (wanted.join(targets, ["project", "target"])
             .groupBy(*TABLE, "col").agg(F.min_by("target", "rank").alias("target")))
    known = schema.fks.select(*TABLE, F.explode("cols").alias("col"), F.col("ref_tbl").alias("target")).distinct()
    kind = F.when(F.col("target") == F.col("tbl"), "self").otherwise("reference")
    return found.join(known, [*TABLE, "col", "target"], "left_anti").select(*TABLE, "col", "target", kind.alias("kind"))


def all_refs(schema: Schema, suffix: str = "_id") -> DataFrame:
    """Declared and implicit references together."""
    declared = schema.fks.filter(F.size("cols") == 1).select(
        *TABLE, F.get("cols", F.lit(0)).alias("col"), F.col("ref_tbl").alias("target"), F.lit("foreign key").alias("kind")).distinct()
    return declared.unionByName(implicit_refs(schema, suffix))


def junction_tables(schema: Schema, suffix: str = "_id") -> DataFrame:
    """Tables that reference at least two other tables."""
    return (all_refs(schema, suffix).filter(F.col("target") != F.col("tbl"))
            .groupBy(*TABLE).agg(F.countDistinct("target").alias("n_targets")).filter("n_targets >= 2"))
