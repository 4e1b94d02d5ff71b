"""The closed-form fold against a sequential replay of the same log."""

import random

from pyspark.sql import functions as F

from codestrata.functions import ddl as dx
from codestrata.operators import ddl, ddl_order


def schema(make_files, *stmts, path="migrations/1.sql"):
    return ddl.Schema(make_files((path, ";\n".join(stmts))))


def cols(s):
    return sorted((r.tbl, r.col, r.type, r.nullable, r.is_pk) for r in s.columns.collect())


def test_add_and_drop_column(make_files):
    s = schema(make_files, "CREATE TABLE users (id UUID PRIMARY KEY, email TEXT UNIQUE NOT NULL)",
               "ALTER TABLE users ADD COLUMN created_at TIMESTAMP", "ALTER TABLE users DROP COLUMN email")
    assert cols(s) == [("users", "created_at", "timestamp", True, False), ("users", "id", "uuid", False, True)]
    assert s.keys.filter("kind = 'UNIQUE'").count() == 0


def test_second_create_is_ignored_until_drop(make_files):
    assert [c[1] for c in cols(schema(make_files, "CREATE TABLE t (a int)", "CREATE TABLE t (b int)"))] == ["a"]
    assert [c[1] for c in cols(schema(make_files, "CREATE TABLE t (a int)", "DROP TABLE t", "CREATE TABLE t (b int)"))] == ["b"]


def test_alter_creates_the_table(make_files):
    s = schema(make_files, "ALTER TABLE t ADD COLUMN x int", "CREATE TABLE t (y int)")
    assert [c[1] for c in cols(s)] == ["x"]
    assert s.tables.first().origin == "alter"


def test_add_constraint_adds_a_foreign_key(make_files):
    s = schema(make_files, "create table users (id int)", "create table o (user_id int)",
               "ALTER TABLE o ADD CONSTRAINT fk FOREIGN KEY (user_id) REFERENCES users(id)")
    row = s.fks.first()
    assert (row.tbl, row.cols, row.ref_tbl, row.ref_cols, row.name) == ("o", ["user_id"], "users", ["id"], "fk_o_user_id")
    assert sorted(c[:2] for c in cols(s)) == [("o", "user_id"), ("users", "id")]


def test_create_that_does_not_parse_is_no_event(make_files):
    s = schema(make_files, "CREATE TABLE t", "CREATE TABLE t (lonely)", "CREATE TABLE t (a int)")
    assert [c[1] for c in cols(s)] == ["a"]
    assert ddl.ddl_errors(make_files(("migrations/1.sql", "CREATE TABLE t; CREATE TABLE t (x); SELECT 1"))).first().n_failed == 2


def test_alter_column_keeps_other_attributes(make_files):
    s = schema(make_files, "CREATE TABLE t (a int NOT NULL DEFAULT 5)", "ALTER TABLE t ALTER COLUMN a TYPE bigint",
               "ALTER TABLE t ALTER COLUMN a DROP NOT NULL", "ALTER TABLE t ALTER COLUMN zz TYPE bigint")
    row = s.columns.first()
    assert (row.col, row.type, row.nullable, row.default) == ("a", "bigint", True, "5")
    assert s.columns.count() == 1


def test_nested_parentheses_split(spark):
    df = spark.createDataFrame([("CREATE TABLE t (a numeric(10, 2), CHECK (x IN (f(1, g(2, 3)), 4)), b int)",)], "s string")
    assert df.select(dx.column_defs("s").alias("d")).first().d == [
        "a numeric(10, 2)", "CHECK (x IN (f(1, g(2, 3)), 4))", "b int"]


def test_long_definition_does_not_overflow(spark):
    body = ", ".join(f"c{i} numeric(10, 2) CHECK (c{i} IN ({', '.join(map(str, range(50)))}))" for i in range(300))
    df = spark.createDataFrame([(f"CREATE TABLE t ({body})",), ("CREATE TABLE t (" + "(" * 5000 + ")",)], "s string")
    assert [len(r.d) for r in df.select(dx.column_defs("s").alias("d")).collect()] == [300, 1]


def replay(stmts):
    """Sequential reference model for the random test."""
    tables = {}
    for kind, t, c in stmts:
        if kind == "create":
            tables.setdefault(t, {"cols": {c}, "pk": set(), "uq": []})
        elif kind == "create_pk":
            if t not in tables:
                tables[t] = {"cols": {c}, "pk": {c}, "uq": []}
        elif kind == "drop":
            tables.pop(t, None)
        else:
            tab = tables.setdefault(t, {"cols": set(), "pk": set(), "uq": []})
            if kind == "add":
                tab["cols"].add(c)
            elif kind == "add_unique":
                tab["cols"].add(c)
                tab["uq"].append({c})
            elif kind == "dropcol":
                tab["cols"].discard(c)
                tab["pk"].discard(c)
                tab["uq"] = [u - {c} for u in tab["uq"] if u - {c}]
            elif kind == "uq2":
                tab["uq"].append({c, "z"})
    out = set()
    for t, tab in tables.items():
        out |= {(t, c, c in tab["pk"]) for c in tab["cols"]}
    uniques = sorted((t, tuple(sorted(u))) for t, tab in tables.items() for u in tab["uq"])
    return set(tables), out, uniques


SQL = {
    "create": "CREATE TABLE {t} ({c} int)", "create_pk": "CREATE TABLE {t} ({c} int PRIMARY KEY)", "drop": "DROP TABLE IF EXISTS {t}",
    "add": "ALTER TABLE {t} ADD COLUMN {c} int", "add_unique": "ALTER TABLE {t} ADD COLUMN {c} int UNIQUE",
    "dropcol": "ALTER TABLE {t} DROP COLUMN {c}", "uq2": "ALTER TABLE {t} ADD CONSTRAINT u UNIQUE ({c}, z)",
}


def test_random_logs_equal_replay(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for p in range(120):
        stmts = [(rng.choice(list(SQL)), rng.choice("tuv"), rng.choice("ab")) for _ in range(rng.randrange(1, 16))]
        text = [SQL[k].format(t=t, c=c) for k, t, c in stmts]
        cut = rng.randrange(len(text) + 1)
        for name, part in (("001.sql", text[:cut]), ("002.sql", text[cut:])):
            if part:
                rows.append((f"p{p}", f"migrations/{name}", ";\n".join(part)))
        want[f"p{p}"] = replay(stmts)
    s = ddl.Schema(spark.createDataFrame(rows, "project string, path string, content string"), persist=True)
    tables, columns, uniques = {}, {}, {}
    for r in s.tables.collect():
        tables.setdefault(r.project, set()).add(r.tbl)
    for r in s.columns.collect():
        columns.setdefault(r.project, set()).add((r.tbl, r.col, r.is_pk))
    for r in s.keys.filter("kind = 'UNIQUE'").collect():
        uniques.setdefault(r.project, []).append((r.tbl, tuple(r.cols)))
    for p, (t, c, u) in want.items():
        assert tables.get(p, set()) == t, p
        # a key on a column that is not there is no column
        assert {x for x in columns.get(p, set())} == c, p
        assert sorted(uniques.get(p, [])) == u, p


def order_loop(tables, fks):
    done, out = set(), []
    while True:
        added = False
        for t in sorted(tables):
            if t not in done and all(r == t or r in done for a, r in fks if a == t):
                done.add(t)
                out.append(t)
                added = True
        if not added:
            return out + sorted(tables - done)


def test_table_order_equals_round_loop(spark):
    rng = random.Random(5)
    tabs, fks, want = [], [], {}
    for p in range(40):
        names = {f"t{i}" for i in rng.sample(range(20), rng.randrange(1, 9))}
        edges = [(a, rng.choice(sorted(names) + ["ghost"] * (rng.random() < 0.2))) for a in names for _ in range(rng.randrange(0, 3))]
        tabs += [(f"p{p}", t) for t in names]
        fks += [(f"p{p}", a, b) for a, b in edges]
        want[f"p{p}"] = order_loop(names, edges)
    out = ddl_order.table_order(spark.createDataFrame(tabs, "project string, tbl string"),
                                spark.createDataFrame(fks, "project string, tbl string, ref_tbl string"))
    got = {}
    for r in out.orderBy("project", F.col("round").asc_nulls_last(), "tbl").collect():
        got.setdefault(r.project, []).append(r.tbl)
    assert got == want


def test_cycle_comes_last(make_files):
    s = schema(make_files, "CREATE TABLE x (id int, y_id int REFERENCES y(id))", "CREATE TABLE y (id int, x_id int REFERENCES x(id))",
               "CREATE TABLE orders (id int, user_id int REFERENCES users(id))", "CREATE TABLE users (id int)")
    rows = ddl_order.table_order(s.tables, s.fks).orderBy(F.col("round").asc_nulls_last(), "tbl").collect()
    assert [r.tbl for r in rows] == ["users", "orders", "x", "y"]


def test_script_folds_to_the_same_schema(spark, make_files):
    s = schema(make_files, "CREATE TABLE users (id uuid PRIMARY KEY, name text NOT NULL)",
               "CREATE TABLE o (id int, user_id uuid REFERENCES users(id), UNIQUE (id, user_id))",
               "ALTER TABLE users ADD COLUMN age int DEFAULT 3", "CREATE INDEX i ON o (id)", "CREATE TYPE mood AS ENUM ('a', 'b')")
    script = ddl_order.ddl_script(s).orderBy("section", F.col("round").asc_nulls_last(), "name").collect()
    again = ddl.Schema(make_files(("migrations/all.sql", "\n".join(r.statement for r in script))))
    assert cols(again) == cols(s)
    key = lambda t: sorted((r.tbl, r.kind, tuple(r.cols)) for r in t.keys.collect())
    assert key(again) == key(s)
    assert [r.vals for r in again.enums.collect()] == [["a", "b"]]
    assert again.indexes.count() == 1


def test_implicit_reference(make_files):
    s = schema(make_files, "CREATE TABLE users (id int)", "CREATE TABLE cats (id int, user_id int, parent_id int, dog_id int)")
    assert sorted((r.col, r.target, r.kind) for r in ddl.implicit_refs(s).collect()) == [
        ("parent_id", "cats", "self"), ("user_id", "users", "reference")]


def test_guards_and_flavours(make_files):
    s = schema(make_files, 'CREATE TEMP TABLE IF NOT EXISTS "T" (a int, b text)', "ALTER TABLE IF EXISTS ONLY t ADD COLUMN c int, ADD COLUMN d int NOT NULL",
               "CREATE INDEX CONCURRENTLY IF NOT EXISTS i ON t USING btree (lower(b), a) WHERE (a > 0)",
               "CREATE OR REPLACE VIEW v AS SELECT 1", "CREATE MATERIALIZED VIEW m AS SELECT 2", "DROP VIEW IF EXISTS m")
    assert [(r.tbl) for r in s.tables.collect()] == ["t"]
    assert [c[1:4] for c in cols(s)] == [("a", "int", True), ("b", "text", True), ("c", "int", True), ("d", "int", False)]
    assert [(r.name, r.tbl, r.cols) for r in s.indexes.collect()] == [("i", "t", ["lower(b)", "a"])]
    assert [r.name for r in s.views.collect()] == ["v"]


def test_literals_keep_case_commas_and_blanks(make_files):
    s = schema(make_files, "CREATE TABLE t (a text DEFAULT 'A b, (PRIMARY KEY', b int DEFAULT (1 + 2), CONSTRAINT k PRIMARY KEY (b))",
               "CREATE TYPE e AS ENUM ('x, y', 'it''s')")
    assert [(r.col, r.default, r.is_pk) for r in s.columns.orderBy("col").collect()] == [("a", "'A b, (PRIMARY KEY'", False), ("b", "(1 + 2)", True)]
    assert s.enums.first().vals == ["x, y", "it's"]


def test_losses_are_counted(make_files):
    text = ("CREATE INDEX ON; CREATE TYPE p AS (a int); ALTER TABLE t FROB x; ALTER TABLE t DROP CONSTRAINT c; "
            "CREATE INDEX i ON t (a); ALTER TABLE t ADD COLUMN a int")
    row = ddl.ddl_errors(make_files(("migrations/1.sql", text))).first()
    assert (row.n_statements, row.n_failed) == (6, 3)
