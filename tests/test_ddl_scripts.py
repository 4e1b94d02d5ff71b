"""Statements of scripts with literals, quoted names, function bodies and comments; types of several words."""

import random

import pytest

from codestrata.functions import ddl as dx
from codestrata.operators import ddl


def statements(make_files, script):
    rows = ddl.statements(make_files(("migrations/1.sql", script)).select("project", "path", "content")).collect()
    return [(r.stmt_no, r.stmt) for r in sorted(rows, key=lambda r: r.stmt_no)]


def columns(make_files, script):
    s = ddl.Schema(make_files(("migrations/1.sql", script)))
    return {r.col: (r.type, r.nullable, r.default) for r in s.columns.collect()}


def test_function_bodies_are_one_statement(make_files):
    script = "CREATE TABLE t (a int); CREATE FUNCTION f() RETURNS int AS $body$ BEGIN; DROP TABLE t; $$x;y$$ END; $body$ LANGUAGE plpgsql; ALTER TABLE t ADD b int"
    assert [n for n, _ in statements(make_files, script)] == [0, 1, 2]
    assert columns(make_files, script) == {"a": ("int", True, None), "b": ("int", True, None)}
    errors = ddl.ddl_errors(make_files(("migrations/1.sql", script))).first()
    assert (errors.n_statements, errors.n_unsupported, errors.n_failed) == (3, 1, 0)  # the function is counted as a loss


def test_separators_in_literals_and_names(make_files):
    script = """CREATE TABLE t (a int DEFAULT 3, "b;,(" text DEFAULT 'x;y', c text DEFAULT 'it''s -- (no, comment', `d d` text default '/* no',
      n text default 'x;y', ts timestamp with time zone, e text DEFAULT '
 two  lines ')"""
    assert columns(make_files, script) == {
        "a": ("int", True, "3"), "b;,(": ("text", True, "'x;y'"), "c": ("text", True, "'it''s -- (no, comment'"), "d d": ("text", True, "'/* no'"),
        "n": ("text", True, "'x;y'"), "ts": ("timestamp with time zone", True, None), "e": ("text", True, "'\n two  lines '")}


def test_comments(make_files):
    script = """/* a comment; over
 several lines; DROP TABLE t; /* nested; */ still */ CREATE TABLE t ( -- first; line
  a int, /* b int, */ c int -- ' no literal
);
-- DROP TABLE t;
/* open to the end ; DROP TABLE t"""
    assert len(statements(make_files, script)) == 1
    assert columns(make_files, script) == {"a": ("int", True, None), "c": ("int", True, None)}


@pytest.mark.parametrize(("definition", "type_"), [
    ("numeric(10, 2) NOT NULL", "numeric(10,2)"), ("NUMERIC ( 10 ,2 )", "numeric(10,2)"), ("double  precision", "double precision"),
    ("character varying (20) DEFAULT 'a'", "character varying(20)"), ("timestamp(3) without time zone", "timestamp(3) without time zone"),
    ("int[]", "int[]"), ("text [3] []", "text[3][]"), ("enum('a,b', 'c')", "enum('a,b','c')"), ("int", "int")])
def test_types(make_files, definition, type_):
    assert columns(make_files, f"CREATE TABLE t (x {definition}, y int)")["x"][0] == type_
    assert columns(make_files, f"CREATE TABLE t (x int); ALTER TABLE t ALTER COLUMN x TYPE {definition.split(' NOT')[0].split(' DEF')[0]}")["x"][0] == type_


def test_renames_are_no_losses(make_files):
    errors = ddl.ddl_errors(make_files(("migrations/1.sql", "CREATE TABLE t (a int); ALTER TABLE t RENAME TO u; ALTER TABLE u RENAME COLUMN a TO b;"
                                        "ALTER TABLE u RENAME CONSTRAINT a TO b; ALTER TABLE u RENAME INDEX a TO b"))).first()
    assert errors.n_failed == 1  # index names are not followed


def cut(script):
    """Plain loop over characters: statements without comments, cut at semicolons that are not quoted."""
    out, now, i = [], "", 0
    while i < len(script):
        rest = script[i:]
        c = rest[0]
        if c in "'\"`" and c in rest[1:]:
            end = 1
            while True:
                end = rest.find(c, end)
                if end < 0:
                    end = 1  # a quote that does not end is a character
                    break
                if c != "`" and rest[end + 1:end + 2] == c:
                    end += 2
                    continue
                end += 1
                break
            now += rest[:end]
            i += end
        elif rest.startswith("--"):
            i += len(rest.split("\n")[0])
            now += " "
        elif rest.startswith("/*"):
            depth, end = 1, 2
            while depth and end < len(rest):
                two = rest[end:end + 2]
                depth += (two == "/*") - (two == "*/")
                end += 2 if two in ("/*", "*/") else 1
            i += end if not depth else len(rest)
            now += " "
        elif rest.startswith("$$") and "$$" in rest[2:]:
            end = rest.index("$$", 2) + 2
            now += rest[:end]
            i += end
        elif c == ";":
            out.append(now)
            now, i = "", i + 1
        else:
            now += c
            i += 1
    return [*out, now]


def test_random_scripts_are_cut_as_by_a_loop(spark):
    rng = random.Random(8)
    pieces = ["'", "''", '"', ";", "--", "\n", "/*", "*/", "$$", "a", " b ", "(", ",", "`", "-", "/", "$", "x;y", "'q;'", "/* c; */", '"n;n"', "$$ b; $$"]
    scripts = ["".join(rng.choices(pieces, k=rng.randrange(25))) for _ in range(1500)]
    got = spark.createDataFrame(list(enumerate(scripts)), "i int, s string").select("i", dx.raw_statements("s").alias("r"))
    got = got.selectExpr("i", "r").withColumn("r", dx.F.transform("r", dx.unguarded)).collect()
    for i, r in got:
        assert r == cut(scripts[i]), scripts[i]


def test_long_scripts(spark):
    script = "/* " + "long comment * / " * 50_000 + "*/ CREATE TABLE t (a text DEFAULT '" + "x;''" * 100_000 + "'); " + "INSERT INTO t VALUES ('a;b'); " * 20_000
    n = spark.createDataFrame([(script,)], "s string").select(dx.F.size(dx.raw_statements("s"))).first()[0]
    assert n == 20_002
