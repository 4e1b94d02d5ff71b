"""Renamed tables and columns against a sequential replay."""

import random

from codestrata.operators import ddl
from codestrata.streaming import schema_state


def schema(make_files, *stmts):
    return ddl.Schema(make_files(("migrations/1.sql", ";\n".join(stmts))))


def names(s):
    return sorted((r.tbl, r.col) for r in s.columns.collect())


def test_table_keeps_its_columns_keys_and_references(make_files):
    s = schema(make_files, "CREATE TABLE a (id int PRIMARY KEY, x text UNIQUE)", "CREATE TABLE c (a_id int REFERENCES a(id))",
               "CREATE INDEX i ON a (x)", "ALTER TABLE a RENAME TO b", "ALTER TABLE b ADD COLUMN y int", "CREATE TABLE a (other int)")
    assert names(s) == [("a", "other"), ("b", "id"), ("b", "x"), ("b", "y"), ("c", "a_id")]
    assert [(r.tbl, r.ref_tbl, r.name) for r in s.fks.collect()] == [("c", "b", "fk_c_a_id")]
    assert [(r.tbl, r.name) for r in s.indexes.collect()] == [("b", "i")]
    assert sorted((r.tbl, r.kind) for r in s.keys.collect()) == [("b", "PK"), ("b", "UNIQUE")]
    assert {r.tbl: r.origin for r in s.tables.collect()} == {"a": "create", "b": "create", "c": "create"}


def test_column_keeps_its_type_keys_and_references(make_files):
    s = schema(make_files, "CREATE TABLE a (id int PRIMARY KEY, x text)", "CREATE TABLE c (a_id int REFERENCES a(id))", "CREATE INDEX i ON a (id, x)",
               "ALTER TABLE a RENAME COLUMN id TO key", "ALTER TABLE c RENAME a_id TO owner", "ALTER TABLE a ALTER COLUMN key TYPE bigint",
               "ALTER TABLE a ADD COLUMN id uuid")
    assert sorted((r.tbl, r.col, r.type, r.is_pk) for r in s.columns.collect()) == [
        ("a", "id", "uuid", False), ("a", "key", "bigint", True), ("a", "x", "text", False), ("c", "owner", "int", False)]
    assert [(r.cols, r.ref_tbl, r.ref_cols) for r in s.fks.collect()] == [(["owner"], "a", ["key"])]
    assert [r.cols for r in s.indexes.collect()] == [["key", "x"]]


def test_names_can_be_swapped(make_files):
    s = schema(make_files, "CREATE TABLE a (x int)", "CREATE TABLE b (y int)", "ALTER TABLE a RENAME TO tmp", "ALTER TABLE b RENAME TO a",
               "ALTER TABLE tmp RENAME TO b", "ALTER TABLE a RENAME COLUMN y TO z, ADD COLUMN y int")
    assert names(s) == [("a", "y"), ("a", "z"), ("b", "x")]


def test_schema_of_the_old_name(make_files):
    s = schema(make_files, "CREATE TABLE app.a (x int)", 'ALTER TABLE app.a RENAME TO "B"')
    assert names(s) == [("app.b", "x")]


def test_long_chain(make_files):
    stmts = [f"ALTER TABLE t{i} RENAME TO t{i + 1}" for i in range(100)]
    assert names(schema(make_files, "CREATE TABLE t0 (x int)", *stmts)) == [("t100", "x")]


SQL = {
    "create": "CREATE TABLE {t} ({c} int PRIMARY KEY)", "drop": "DROP TABLE IF EXISTS {t}", "add": "ALTER TABLE {t} ADD COLUMN {c} int",
    "dropcol": "ALTER TABLE {t} DROP COLUMN {c}", "unique": "ALTER TABLE {t} ADD CONSTRAINT u UNIQUE ({c}, z)",
    "ref": "ALTER TABLE {t} ADD CONSTRAINT f FOREIGN KEY (z) REFERENCES {u} ({c})",
    "rename": "ALTER TABLE {t} RENAME TO {u}", "rencol": "ALTER TABLE {t} RENAME COLUMN {c} TO {d}",
}


def replay(stmts):
    tables = {}
    for kind, t, u, c, d in stmts:
        if kind == "create":
            tables.setdefault(t, {"cols": {c}, "pk": {c}, "uq": [], "fk": []})
            continue
        if kind == "drop" or kind == "rename" and t != u:
            # what refers to a table that goes keeps its name, but no longer its columns
            for other in tables.values():
                other["fk"] = [[r, None if r == (t if kind == "drop" else u) else x] for r, x in other["fk"]]
        if kind == "drop":
            tables.pop(t, None)
            continue
        tab = tables.setdefault(t, {"cols": set(), "pk": set(), "uq": [], "fk": []})
        if kind == "add":
            tab["cols"].add(c)
        elif kind == "unique":
            tab["uq"].append({c, "z"})
        elif kind == "ref":
            tab["fk"].append([u, c])
        elif kind == "rename" and t != u:
            tables[u] = tables.pop(t)
            for other in tables.values():
                other["fk"] = [[u if r == t else r, x] for r, x in other["fk"]]
        if kind == "dropcol" or kind == "rencol" and c != d:
            gone = c if kind == "dropcol" else d
            for part in ("cols", "pk"):
                tab[part].discard(gone)
            tab["uq"] = [x - {gone} for x in tab["uq"] if x - {gone}]
        if kind == "rencol" and c != d:
            swap = lambda names_: {d if x == c else x for x in names_}
            tab["cols"], tab["pk"], tab["uq"] = swap(tab["cols"]), swap(tab["pk"]), [swap(x) for x in tab["uq"]]
            for other in tables.values():
                other["fk"] = [[r, d if r == t and x == c else x] for r, x in other["fk"]]
    return (sorted(tables), sorted((t, c, c in tab["pk"]) for t, tab in tables.items() for c in tab["cols"]),
            sorted((t, tuple(sorted(x))) for t, tab in tables.items() for x in tab["uq"]),
            [(t, *f) for t, tab in sorted(tables.items()) for f in tab["fk"]])


def logs(n, seed, most=16):
    rng = random.Random(seed)
    return {f"p{p:03}": [(rng.choice([*SQL, "rename", "rencol"]), rng.choice("tuv"), rng.choice("tuv"), *rng.choices("abc", k=2))
                         for _ in range(rng.randrange(1, most))] for p in range(n)}


def state(s):
    """Results as ``replay`` gives them, by project."""
    out = {}
    for part, rows in enumerate((s.tables.select("project", "tbl").collect(), s.columns.select("project", "tbl", "col", "is_pk").collect(),
                                 s.keys.filter("kind = 'UNIQUE'").select("project", "tbl", "cols").collect(),
                                 s.fks.orderBy("tbl", "at").selectExpr("project", "tbl", "ref_tbl", "ref_cols[0] as c").collect())):
        for r in rows:
            row = tuple(tuple(x) if isinstance(x, list) else x for x in r[1:])
            out.setdefault(r[0], ([], [], [], []))[part].append(row[0] if part == 0 else row)
    return {p: (*(sorted(x) for x in parts[:3]), parts[3]) for p, parts in out.items()}


def text(stmts):
    return ";\n".join(SQL[k].format(t=t, u=u, c=c, d=d) for k, t, u, c, d in stmts)


def test_random_logs_equal_replay(spark):
    ours = logs(250, 5)
    rows = [(p, f"migrations/{k}.sql", text(part)) for p, stmts in ours.items() for k, part in enumerate((stmts[:7], stmts[7:])) if part]
    found = state(ddl.Schema(spark.createDataFrame(rows, "project string, path string, content string"), persist=True))
    for p, stmts in ours.items():
        got, want = found.get(p, ([], [], [], [])), replay(stmts)
        assert got[:3] == want[:3], (p, text(stmts))
        assert [f[:2] for f in got[3]] == [f[:2] for f in want[3]], (p, text(stmts))
        assert all(a[2] == b[2] for a, b in zip(got[3], want[3]) if b[2] is not None), (p, text(stmts), got[3], want[3])


def test_growing_log_equals_the_fold_of_all_files(spark, tmp_path):
    """A batch, then a late one that renames, then files that change."""
    ours = logs(60, 9)
    files = [[(p, f"migrations/{k}.sql", text(stmts[5 * k:5 * k + 5])) for p, stmts in ours.items() if stmts[5 * k:5 * k + 5]] for k in range(2)]
    make = lambda rows: spark.createDataFrame(rows, "project string, path string, content string")
    known = {}
    batches = [files[1], files[0], [(p, path, text(ours[p][:1])) for p, path, _ in files[0][:20]]]
    for n, batch in enumerate(batches):
        schema_state.fold_batch(make(batch), str(tmp_path), n)
        known |= {(p, path): content for p, path, content in batch}
        want = ddl.Schema(make([(*k, v) for k, v in known.items()]), persist=True)
        assert state(schema_state.current(spark, str(tmp_path))) == state(want)
