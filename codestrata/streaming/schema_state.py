"""The live schema of a growing migration log, kept as state that each batch merges into.

The state holds, for every table, the rows that its live schema still depends on: the first
statement of its current life, and of later ones the facts that no newer fact replaces (the last
definition and change of each attribute of a column, keys whose columns are still there, foreign
keys, the last definition of each index); for enums and views the last statement. One more row keeps the
newest place (path, statement) of each name. So the state is as large as the live schema,
however long the log, and folding it gives what folding the whole log gives. Of tables that a
RENAME concerns, by their old or new name or by a column, all statements are kept.

It lies in ``BUCKETS`` buckets by (project, name). A batch reads the buckets of the names it
touches, merges its own statements and writes these buckets anew under its batch number; a
table of at most ``BUCKETS`` rows says which batch holds the current version of a bucket. A batch
that is replayed reads the versions before it and overwrites what it wrote.

Merging is exact if a table's statements arrive in the order of the log. Names whose statements
arrive late, and names of a migration file that arrives again with another text (in its old or
its new version), are folded from the log: parsed statements in the same buckets, of which only
theirs are read. A file that arrives again unchanged has no effect. If one batch holds a
path twice, the greatest text counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from codestrata.functions import ddl as dx
from codestrata.operators import ddl, ddl_renames
from codestrata.operators.filters import migration_files
from codestrata.session import cut_lineage, exists, release

BUCKETS = 64

#: One parsed statement, or (kind ``seen``) the newest place of a name, or (``renamed``) that a table got this name. Index rows are named after their table.
STATE = ("project string, space string, name string, kind string, item string, type string, seq struct<path:string,stmt_no:int>, "
         f"facts array<{dx.FACT}>, vals array<string>, flag boolean, sql string")
NAME = ["project", "space", "name"]
_FILES = "project string, path string, digest string, names array<struct<space:string,name:string>>, n_statements long, bucket int, batch int"


def _bucket(project: str, name: str):
    return F.pmod(F.xxhash64(project, name), F.lit(BUCKETS)).cast("int")


def parsed(log: DataFrame) -> DataFrame:
    """Statements of a log (project, path, stmt_no, stmt, type, tbl) as rows of ``STATE``."""
    def row(df: DataFrame, space: str, kind: str, **columns: str) -> DataFrame:
        types = dict(c.split(" ", 1) for c in ("item string", "type string", f"facts array<{dx.FACT}>", "vals array<string>", "flag boolean", "sql string"))
        rest = [(F.col(columns[c]) if c in columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()]
        return df.select("project", F.lit(space).alias("space"), F.col(columns["name"]).alias("name"), F.lit(kind).alias("kind"), *rest[:2], "seq", *rest[2:])

    events = ddl.table_events(log)
    # facts are read a second time for this, so only of statements that may rename
    renames = ddl.table_events(log.filter((F.col("type") == "ALTER_TABLE") & F.lower("stmt").contains("rename")))
    renamed = ddl_renames.table_renames(renames).withColumn("seq", F.col("at"))
    parts = [row(events, "table", "table", name="tbl", type="type", facts="facts"),
             row(renamed, "table", "renamed", name="new", item="old"),
             row(ddl.index_rows(log), "table", "index", name="tbl", item="name", flag="is_unique", vals="cols"),
             row(ddl.enum_rows(log), "enum", "enum", name="name", vals="vals"),
             row(ddl.view_rows(log), "view", "view", name="name", type="type", sql="stmt")]
    return reduce(DataFrame.unionByName, parts)


def schema_of(rows: DataFrame, persist: bool = False) -> ddl.Schema:
    """The live schema behind rows of ``STATE``."""
    kind = lambda k: rows.filter(F.col("kind") == k)
    tbl = F.col("name").alias("tbl")
    return ddl.Schema.of(
        kind("table").select("project", tbl, "type", "seq", "facts"), kind("enum").select("project", "name", "seq", "vals"),
        kind("view").select("project", "name", "type", "seq", F.col("sql").alias("stmt")),
        kind("index").select("project", tbl, F.col("item").alias("name"), F.col("flag").alias("is_unique"), F.col("vals").alias("cols"), "seq"), persist)


def pruned(rows: DataFrame, scratch: list[DataFrame] | None = None) -> DataFrame:
    """The rows that the live schema depends on, and the newest place of every name; all rows of names that a rename concerns.

    Tables written on the way are added to ``scratch``.
    """
    def once(df: DataFrame) -> DataFrame:
        kept = cut_lineage(df)
        if scratch is not None:
            scratch.append(kept)
        return kept

    columns = rows.columns
    seen = rows.groupBy(*NAME).agg(F.max("seq").alias("seq"))
    seen = seen.select("project", "space", "name", F.lit("seen").alias("kind"), "seq")
    renames = rows.filter((F.col("kind") == "renamed") | F.exists("facts", lambda f: f["op"].isin(*ddl_renames.RENAMES)))
    whole = rows.limit(0)
    if not renames.isEmpty():
        names = once(renames.select(*NAME).distinct())
        whole = rows.filter("kind <> 'seen'").join(names, NAME, "left_semi")
        rows = rows.join(names, NAME, "left_anti")
    last = (rows.filter(F.col("kind").isin("enum", "view")).groupBy(*NAME, "kind")
            .agg(F.max_by(F.struct(*[c for c in columns if c not in (*NAME, "kind")]), "seq").alias("r")).select(*NAME, "kind", "r.*"))
    tables = rows.filter(F.col("kind") == "table")
    lives = ddl.table_lives(tables.select("project", F.col("name").alias("tbl"), "type", "seq")).withColumnRenamed("tbl", "name")
    ours = rows.join(once(lives.select("project", "name", "last_drop", "first_seq")), ["project", "name"])
    indexes = (ours.filter((F.col("kind") == "index") & (F.col("seq") > F.col("first_seq"))).groupBy(*NAME, "kind", "item")
               .agg(F.max_by(F.struct(*[c for c in columns if c not in (*NAME, "kind", "item")]), "seq").alias("r")).select(*NAME, "kind", "item", "r.*"))
    effective = (F.col("seq") == F.col("first_seq")) | (F.col("type") == "ALTER_TABLE")
    current = ours.filter((F.col("kind") == "table") & effective & (F.col("last_drop").isNull() | (F.col("seq") > F.col("last_drop"))))
    current = once(current.select("project", "name", "seq", "type", "first_seq", "facts"))
    kept = _needed(current.select("project", "name", "seq", F.posexplode("facts").alias("fact_no", "fact")))
    heads = current.select("project", "name", "seq", "type", (F.col("seq") == F.col("first_seq")).alias("first"))
    kept = heads.join(kept, ["project", "name", "seq"], "left").filter("first or facts is not null").select(
        "project", F.lit("table").alias("space"), "name", F.lit("table").alias("kind"), "type", "seq",
        F.coalesce("facts", F.array().cast(f"array<{dx.FACT}>")).alias("facts"))
    parts = (last, indexes, kept, seen, whole)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select(*columns)


def _needed(facts: DataFrame) -> DataFrame:
    """(project, name, seq, facts): the facts of current lives that decide something, in the order of their statement."""
    col = ["project", "name", "col"]
    f = facts.withColumn("at", F.struct("seq.path", "seq.stmt_no", "fact.def_no"))
    each = f.select("project", "name", "seq", "fact_no", "fact", "at", F.explode("fact.cols").alias("col"))
    op, definition = F.col("fact.op"), F.col("fact.op").isin("ADD", "SETCOL")
    newest = lambda test: F.max(F.when(test, F.col("at")))
    marks = each.groupBy(*col).agg(
        newest(op == "DROPCOL").alias("dropped"), newest(op == "ADD").alias("added"), newest(op == "PK").alias("keyed"),
        newest(definition & F.col("fact.type").isNotNull()).alias("typed"), newest(definition & F.col("fact.nullable").isNotNull()).alias("nulled"),
        newest(definition & F.col("fact.sets_default")).alias("defaulted"))
    met = each.join(marks, col)
    at, is_ = F.col("at"), lambda mark: F.coalesce(F.col("at") == F.col(mark), F.lit(False))
    attribute = (is_("added") | (is_("typed") & F.col("fact.type").isNotNull()) | (is_("nulled") & F.col("fact.nullable").isNotNull())
                 | (is_("defaulted") & F.col("fact.sets_default")))
    stays = F.col("dropped").isNull() | (at > F.col("dropped"))
    keeps = F.when(definition, stays & attribute).when(op == "PK", stays & is_("keyed")).when(op == "UNIQUE", stays).otherwise(op == "FK")
    cols = met.filter(keeps).groupBy("project", "name", "seq", "fact_no").agg(F.collect_set("col").alias("left"), F.first("fact").alias("fact"))
    fact = F.col("fact").withField("cols", F.filter("fact.cols", lambda c: F.array_contains("left", c)))
    return cols.groupBy("project", "name", "seq").agg(F.array_sort(F.collect_list(F.struct("fact_no", fact.alias("fact")))).alias("f")).select(
        "project", "name", "seq", F.transform("f", lambda x: x["fact"]).cast(f"array<{dx.FACT}>").alias("facts"))


class Store:
    """Folders of the state under one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def heads(self, upto: int) -> dict[int, int]:
        """Batch of the current version of each bucket, as of a batch: at most ``BUCKETS`` rows."""
        for number in range(upto, -1, -1):
            place = f"{self.path}/heads/batch={number}"
            if exists(self.spark, place):
                return {r.bucket: r.batch for r in self.spark.read.schema("bucket int, batch int").parquet(place).collect()}
        return {}

    def state(self, heads: dict[int, int], buckets=None) -> DataFrame:
        """Rows of ``STATE`` of some buckets, or all: only the folders of these are read."""
        places = [f"{self.path}/state/batch={n}/bucket={b}" for b, n in sorted(heads.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(STATE).parquet(*places) if places else self.spark.createDataFrame([], STATE)

    def table(self, name: str, schema: str, upto: int) -> DataFrame:
        place = f"{self.path}/{name}"
        if not exists(self.spark, place):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(place).filter(F.col("batch") <= upto)

    def put(self, df: DataFrame, name: str, number: int, by: str | None = None) -> None:
        # the rows of a folder come together first, or each task would write a file in every folder
        writer = (df.hint("rebalance", by) if by else df).write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.path}/{name}/batch={number}")


def fold_batch(migrations: DataFrame, path: str, number: int) -> None:
    """Merge a batch of files into the state; leaves warnings and a row of progress for each new file."""
    spark = migrations.sparkSession
    store = Store(spark, path)
    arrived = migration_files(migrations).groupBy("project", "path").agg(F.max("content").alias("content"))
    arrived = arrived.withColumn("digest", F.sha2("content", 256)).withColumn("bucket", _bucket("project", "path"))
    arrived = cut_lineage(arrived)
    file_buckets = [r.bucket for r in arrived.select("bucket").distinct().collect()]  # at most BUCKETS
    if not file_buckets:
        release(arrived)
        return
    known = store.table("files", _FILES, number - 1).filter(F.col("bucket").isin(file_buckets))
    known = known.groupBy("project", "path").agg(F.max_by(F.struct("digest", "names"), "batch").alias("old"))
    fresh = arrived.join(known, ["project", "path"], "left").filter("old is null or old.digest <> digest")
    todo = cut_lineage(fresh.select("project", "path", "content", "digest", "bucket", "old"))
    marked = cut_lineage(with_reason(ddl.statements(todo.select("project", "path", "content"))))
    good, bad = split_errors(marked)
    store.put(bad, "warnings", number)
    new = cut_lineage(parsed(good).withColumn("bucket", _bucket("project", "name")))
    store.put(new, "log", number, "bucket")
    # what each file names, to know later which names an older version touched
    named = new.groupBy("project", F.col("seq.path").alias("path")).agg(F.collect_set(F.struct("space", "name")).alias("names"))
    sizes = marked.groupBy("project", "path").agg(F.count(F.lit(1)).alias("n_statements"))
    files = todo.drop("content").join(named, ["project", "path"], "left").join(sizes, ["project", "path"], "left")
    files = cut_lineage(files.withColumn("names", F.coalesce("names", F.array().cast("array<struct<space:string,name:string>>")))
                        .withColumn("n_statements", F.coalesce("n_statements", F.lit(0))))
    store.put(files.select("project", "path", "digest", "names", "n_statements", "bucket"), "files", number, "bucket")
    changed = files.filter("old is not null").select("project", F.explode(F.array_union("names", "old.names")).alias("n")).select("project", "n.space", "n.name")
    touched = new.groupBy(*NAME).agg(F.min("seq").alias("since")).unionByName(changed.distinct(), allowMissingColumns=True)
    touched = cut_lineage(touched.groupBy(*NAME).agg(F.min("since").alias("since"), F.max(F.col("since").isNull()).alias("changed"))
                          .withColumn("bucket", _bucket("project", "name")))
    buckets = {r.bucket for r in touched.select("bucket").distinct().collect()}  # at most BUCKETS
    heads = store.heads(number - 1)
    before = store.state(heads, buckets)
    # late names and those of changed files are folded from the log, the others from the state
    seen = before.filter("kind = 'seen'").select(*NAME, F.col("seq").alias("seen"))
    plan = cut_lineage(touched.join(seen, NAME, "left").withColumn("refold", F.col("changed") | F.coalesce(F.col("since") < F.col("seen"), F.lit(False))))
    log_names = plan.filter("refold").select(*NAME, "bucket")
    refolded = _from_log(store, log_names, number) if not log_names.isEmpty() else new.drop("bucket").limit(0)
    merging = plan.filter("not refold").select(*NAME)
    merged = before.join(merging, NAME, "left_semi").unionByName(new.drop("bucket").join(merging, NAME, "left_semi"))
    others = before.join(plan.select(*NAME), NAME, "left_anti")
    scratch = [cut_lineage(merged.unionByName(refolded))]
    after = others.unionByName(pruned(scratch[0], scratch))
    store.put(after.withColumn("bucket", _bucket("project", "name")), "state", number, "bucket")
    _progress(store, files, number)
    written = {b for b in buckets if exists(spark, f"{path}/state/batch={number}/bucket={b}")}
    heads = {b: n for b, n in heads.items() if b not in buckets} | dict.fromkeys(written, number)
    store.put(spark.createDataFrame(sorted(heads.items()), "bucket int, batch int").coalesce(1), "heads", number)
    release(arrived, todo, marked, new, files, touched, plan, *scratch)


def _from_log(store: Store, names: DataFrame, number: int) -> DataFrame:
    """Parsed statements of some names, of the newest version of every file."""
    buckets = [r.bucket for r in names.select("bucket").distinct().collect()]  # at most BUCKETS
    log = store.table("log", STATE + ", bucket int, batch int", number).filter(F.col("bucket").isin(buckets))
    log = log.join(names.select(*NAME), NAME, "left_semi")
    paths = log.select("project", F.col("seq.path").alias("path")).distinct()
    files = store.table("files", _FILES, number).join(paths, ["project", "path"], "left_semi")
    newest = files.groupBy("project", "path").agg(F.max("batch").alias("newest"))
    at = [log["project"] == newest["project"], F.col("seq.path") == newest["path"], log["batch"] == newest["newest"]]
    return log.join(newest, at, "left_semi").drop("bucket", "batch")


def _progress(store: Store, files: DataFrame, number: int) -> None:
    """A row for each file that was folded: its place among the files known so far, and how many are known."""
    spark = store.spark
    place = f"{store.path}/counts/batch="
    prior = next((n for n in range(number - 1, -1, -1) if exists(spark, f"{place}{n}")), None)
    counts = spark.read.schema("project string, known long").parquet(f"{place}{prior}") if prior is not None else spark.createDataFrame([], "project string, known long")
    fresh = files.filter("old is null")
    more = fresh.groupBy("project").agg(F.count(F.lit(1)).alias("more"))
    joined = counts.join(more, "project", "full").select(
        "project", F.coalesce("known", F.lit(0)).alias("before"), (F.coalesce("known", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("known"))
    store.put(joined.select("project", "known"), "counts", number)
    earlier = files.select("project", "path", "n_statements", F.col("old").isNull().cast("long").alias("is_new"))
    # the files of one project in one batch, in the order of their paths
    order = Window.partitionBy("project").orderBy("path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = earlier.withColumn("ahead", F.sum("is_new").over(order)).join(joined, "project")
    store.put(rows.select("project", "path", "n_statements", (F.col("before") + F.col("ahead")).alias("current"), F.col("known").alias("total")), "progress", number)


def with_reason(statements: DataFrame) -> DataFrame:
    """Statements with the reason why they have no effect, or not all of it; null for others."""
    kind = F.col("type")
    return statements.withColumn("reason", (
        F.when(kind.isNull(), "unsupported statement")
        .when((kind == "CREATE_TABLE") & ~dx.create_is_valid("stmt"), "column definitions do not parse")
        .when(kind.isin("CREATE_TABLE", "ALTER_TABLE", "DROP_TABLE") & (F.col("tbl") == ""), "no table name")
        .when((kind == "ALTER_TABLE") & ~dx.alter_is_valid("stmt"), "action not understood")
        .when((kind == "CREATE_INDEX") & dx.index_parts("stmt").isNull(), "index does not parse")
        .when((kind == "CREATE_TYPE") & dx.enum_values("stmt").isNull(), "not an enum")))


def split_errors(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(supported statements, warning rows)."""
    works = F.col("reason").isNull() | (F.col("reason") == "action not understood")  # such a statement still makes its table live
    return (marked.filter(works & F.col("type").isNotNull()).drop("reason"),
            marked.filter("reason is not null").select("project", "path", "stmt_no", "reason", "stmt"))


def current(spark: SparkSession, path: str, upto: int = 1 << 30, persist: bool = False) -> ddl.Schema:
    """The live schema as of the last batch, or an earlier one; ``persist`` writes what several of its tables need."""
    store = Store(spark, path)
    return schema_of(store.state(store.heads(min(upto, last_batch(spark, path)))), persist)


def last_batch(spark: SparkSession, path: str) -> int:
    """Number of the newest batch that was folded, -1 before the first."""
    if not exists(spark, f"{path}/heads"):
        return -1
    return spark.read.schema("bucket int, batch int").parquet(f"{path}/heads").agg(F.max("batch")).first()[0] or 0


def schema_stream(files_stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Merge migrations as they arrive; ``current`` gives the schema, the folders ``progress`` and ``warnings`` the rest."""
    writer = files_stream.writeStream.foreachBatch(lambda b, n: fold_batch(b, path, n)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
