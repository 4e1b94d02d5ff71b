"""Schema state of a growing migration log against the fold of the whole log."""

import random

from codestrata.operators import ddl
from codestrata.sources import files
from codestrata.streaming import schema_state as state

FILES = "project string, path string, content string"


def parts(schema):
    """All tables of a schema as one set of rows."""
    tables = {"tables": schema.tables, "columns": schema.columns, "keys": schema.keys.drop("group"), "fks": schema.fks.drop("at"),
              "enums": schema.enums, "views": schema.views, "indexes": schema.indexes}
    return {name: sorted(map(repr, df.select(*sorted(df.columns)).collect())) for name, df in tables.items()}


def statement(rng):
    t, c, d = (rng.choice(x) for x in (["a", "b", "c"], ["x", "y", "z"], ["x", "y", "z"]))
    return rng.choice([
        f"CREATE TABLE {t} ({c} int PRIMARY KEY, w text NOT NULL DEFAULT 'q')", f"CREATE TABLE {t} ({c} int, {d}2 int UNIQUE, FOREIGN KEY ({c}) REFERENCES b (x))",
        f"DROP TABLE {t}", f"ALTER TABLE {t} ADD COLUMN {c} numeric DEFAULT {rng.randrange(5)}", f"ALTER TABLE {t} DROP COLUMN {c}",
        f"ALTER TABLE {t} ALTER COLUMN {c} TYPE t{rng.randrange(9)}", f"ALTER TABLE {t} ALTER COLUMN {c} SET NOT NULL",
        f"ALTER TABLE {t} ALTER COLUMN {c} SET DEFAULT {rng.randrange(9)}", f"ALTER TABLE {t} ADD CONSTRAINT k UNIQUE ({c}, w)",
        f"ALTER TABLE {t} ADD PRIMARY KEY ({c}, {d})", f"ALTER TABLE {t} ADD CONSTRAINT f FOREIGN KEY ({c}) REFERENCES c ({d})",
        f"CREATE INDEX i{c} ON {t} ({c}, {d})", f"CREATE TYPE e{c} AS ENUM ('{rng.randrange(9)}')", f"CREATE VIEW v{c} AS SELECT {rng.randrange(9)}",
        f"DROP VIEW v{c}", "SELECT 1", f"CREATE TABLE {t}"])


def test_every_batch_equals_the_fold_of_all_files(spark, tmp_path):
    rng = random.Random(4)
    text = lambda: ";\n".join(statement(rng) for _ in range(rng.randrange(1, 9)))
    known = {}
    batches = [
        {("p", "migrations/01.sql"): text(), ("q", "migrations/01.sql"): text(), ("p", "readme.txt"): "x"},
        {("p", "migrations/03.sql"): text(), ("p", "migrations/05.sql"): text(), ("q", "migrations/02.sql"): text()},
        {("p", "migrations/07.sql"): text(), ("p", "migrations/05.sql"): None},  # one arrives again unchanged
        {("p", "migrations/02.sql"): text(), ("q", "migrations/00.sql"): "DROP TABLE a; CREATE TABLE a (late int)"},  # late files
        {("p", "migrations/03.sql"): text(), ("q", "migrations/01.sql"): ""},  # changed files
        {("p", "migrations/08.sql"): text(), ("q", "migrations/03.sql"): text(), ("r", "migrations/1.sql"): "SELECT 1"},
        {("p", "migrations/03.sql"): None},  # nothing new
    ]
    store = str(tmp_path / "store")
    for number, batch in enumerate(batches):
        known |= {k: v if v is not None else known[k] for k, v in batch.items()}
        df = spark.createDataFrame([(*k, known[k]) for k in batch], FILES)
        state.fold_batch(df, store, number)
        if number == 4:
            state.fold_batch(df, store, number)  # a replay
        if number in (0, 2):
            continue
        everything = spark.createDataFrame([(*k, v) for k, v in known.items()], FILES)
        assert parts(state.current(spark, store)) == (want := parts(ddl.Schema(everything, persist=True))), number
        if number == 1:
            earlier = want
    assert parts(state.current(spark, store, upto=1)) == earlier
    progress = [tuple(r) for r in spark.read.parquet(f"{store}/progress").select("batch", "project", "path", "current", "total").collect()]
    assert sorted(r for r in progress if r[1] == "p" and r[0] < 4) == [
        (0, "p", "migrations/01.sql", 1, 1), (1, "p", "migrations/03.sql", 2, 3), (1, "p", "migrations/05.sql", 3, 3),
        (2, "p", "migrations/07.sql", 4, 4), (3, "p", "migrations/02.sql", 5, 5)]
    assert max(r[0] for r in progress) == 5


def test_stream_leaves_warnings_and_the_schema(spark, tmp_path, make_files):
    src, store, chk = (str(tmp_path / d) for d in ("in", "store", "chk"))
    for file in [("migrations/1.sql", "CREATE TABLE a (x int, y int); CREATE TABLE b (z int); SELECT 1; CREATE TABLE broken; CREATE TYPE n AS (x int)"),
                 ("migrations/2.sql", "ALTER TABLE a DROP COLUMN y; DROP TABLE b; ALTER TABLE a FROB"), ("migrations/3.sql", "CREATE TABLE b (w int)")]:
        make_files(file).coalesce(1).write.mode("append").parquet(src)
        state.schema_stream(files.read_files_stream(spark, src), store, chk).awaitTermination()
    key = lambda df: sorted((r.tbl, r.col) for r in df.collect())
    assert key(state.current(spark, store).columns) == [("a", "x"), ("b", "w")]
    assert key(state.current(spark, store, 0).columns) == [("a", "x"), ("a", "y"), ("b", "z")]
    assert sorted(r.reason for r in spark.read.parquet(f"{store}/warnings").collect()) == [
        "action not understood", "column definitions do not parse", "not an enum", "unsupported statement"]


def test_state_is_as_large_as_the_schema_not_the_log(spark, tmp_path, make_files):
    """200 changes of one column leave what one leaves; a batch reads only the buckets of its names."""
    def rows(n, folder):
        store = str(tmp_path / folder)
        changes = ";".join(f"ALTER TABLE t ALTER COLUMN a TYPE t{i}; DROP TABLE u; CREATE TABLE u (c{i} int); CREATE VIEW v AS SELECT {i}" for i in range(n))
        state.fold_batch(make_files(("migrations/1.sql", "CREATE TABLE t (a int, b int)"), ("migrations/2.sql", changes)), store, 0)
        state.fold_batch(make_files(("migrations/3.sql", "ALTER TABLE t ALTER COLUMN a TYPE final")), store, 1)
        s = state.Store(spark, store)
        heads = s.heads(1)
        return (sorted((r.kind, r.name, len(r.facts or [])) for r in s.state(heads).select("kind", "name", "facts").collect()),
                sorted(heads.values()), s.state(heads, {b for b, n in heads.items() if n == 1}).count())

    few, many = rows(2, "few"), rows(200, "many")
    assert few == many
    assert few[1].count(1) == 1 and few[2] < len(few[0])  # the second batch read and wrote one bucket


def test_merging_reads_no_log(spark, tmp_path, make_files, monkeypatch):
    store, asked = str(tmp_path / "store"), []
    table = state.Store.table
    monkeypatch.setattr(state.Store, "table", lambda self, name, *rest: (asked.append(name), table(self, name, *rest))[1])
    for n in range(4):
        state.fold_batch(make_files((f"migrations/{n}.sql", f"CREATE TABLE t (a int); ALTER TABLE t ADD COLUMN c{n} int")), store, n)
    assert set(asked) == {"files"}
    state.fold_batch(make_files(("migrations/2.sql", "DROP TABLE t")), store, 4)
    assert "log" in asked
    assert sorted(r.col for r in state.current(spark, store).columns.collect()) == ["a", "c3"]


def test_a_bucket_is_one_file_of_a_batch(spark, tmp_path, make_files):
    """Each task used to write a file in every bucket, so the files of a batch grew with the tasks times the buckets."""
    path = str(tmp_path / "s")
    state.fold_batch(make_files(*[(f"migrations/{n:03d}_a.sql", f"create table t{i} (id int); create index x on t{i} (id); alter table t{i} rename to u{i};")
                                         for n, i in enumerate(range(100))]), path, 0)
    for part in ("log", "files", "state"):
        folders = [f for f in (tmp_path / "s" / part).rglob("bucket=*") if list(f.glob("*.parquet"))]
        assert folders and all(len(list(f.glob("*.parquet"))) == 1 for f in folders), part


def test_facts_are_read_again_only_where_a_table_may_be_renamed(spark, make_files):
    log = ddl.ddl_events(make_files(("migrations/1.sql", "create table a (id int); alter table a add b int; ALTER TABLE a Rename To z;")))
    rows = state.parsed(log)
    assert [(r["item"], r["name"]) for r in rows.filter("kind = 'renamed'").collect()] == [("a", "z")]
    filters = [line for line in rows._jdf.queryExecution().optimizedPlan().toString().splitlines() if "rename" in line.lower() and "Contains" in line]
    assert filters
