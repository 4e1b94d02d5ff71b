from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from codestrata.functions import fixed, text
from codestrata.functions.chunks import chunks
from codestrata.operators import filters, ignore, stats


def paths(df):
    return sorted(r.path for r in df.collect())


def test_ignore_last_match_wins(make_files):
    files = make_files((".gitignore", "*.log\n!keep.log\n"), ("a/keep.log", ""), ("a/x.log", ""))
    assert paths(ignore.apply_ignore(files, ignore.parse_ignore(files))) == [".gitignore", "a/keep.log"]


def test_directory_rule_drops_subtree_only(make_files):
    files = make_files(("build/x.go", ""), ("build", ""), ("src/build.go", ""))
    marked = {r.path: (r.file_ignored, r.tree_ignored) for r in ignore.with_ignored(files).collect()}
    assert marked["build/x.go"] == (False, True)
    assert marked["build"] == (False, False)
    assert marked["src/build.go"] == (False, False)


def test_rule_after_all_others_decides(make_files):
    for last, kept in (("*.txt", []), ("!*.txt", ["a.txt"])):
        files = make_files((".gitignore", f"*.txt\n!a.txt\n{last}\n"), ("a.txt", ""))
        out = ignore.apply_ignore(files, ignore.parse_ignore(files)).filter("path <> '.gitignore'")
        assert paths(out) == kept


def test_rules_of_one_project_leave_others_alone(make_files):
    files = make_files(("p", ".gitignore", "*.txt"), ("p", "a.txt", ""), ("q", "a.txt", ""))
    out = ignore.apply_ignore(files, ignore.parse_ignore(files)).filter("path = 'a.txt'")
    assert [r.project for r in out.collect()] == ["q"]


def test_large_rule_tables_take_the_salted_route(make_files):
    rows = [(f"p{i % 3}", f"d{i % 7}/f{i}.{'txt' if i % 2 else 'log'}", "") for i in range(200)]
    rows += [("p0", ".gitignore", "*.txt\n!f1*\nd3/\n"), ("p1", ".gitignore", "/d2\n")]
    files = make_files(*rows)
    rules = ignore.parse_ignore(files)
    small = ignore.apply_ignore(files, rules, broadcast_bytes=1 << 62)
    large = ignore.apply_ignore(files, rules, broadcast_bytes=0)
    key = lambda df: sorted((r.project, r.path) for r in df.collect())
    assert 0 < small.count() < 200 and key(small) == key(large)


def test_prune_tests_any_part_of_the_folder_path(make_files):
    files = make_files(("src/router/a.go", ""), ("src/core/a.go", ""), ("a/b/c/d/e/f/g/h/i/x.go", ""),
                       ("a/b/c/d/e/f/g/h/i/j/x.go", ""), ("out.go", ""))
    assert paths(filters.prune_dirs(files)) == ["a/b/c/d/e/f/g/h/i/x.go", "out.go", "src/core/a.go"]


def redact(spark, lines):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, content string")
    return [r.content for r in df.withColumn("content", text.redacted("content")).orderBy("i").collect()]


def plain_redact(content):
    out = []
    for line in content.split("\n"):
        if any(t in line.lower() for t in fixed.REDACT_TOKENS):
            if ":" in line:
                line = line.split(":", 1)[0] + ": [REDACTED]"
            elif "=" in line:
                line = line.split("=", 1)[0] + "=[REDACTED]"
        out.append(line)
    return "\n".join(out)


def test_redaction_examples(spark):
    assert redact(spark, ["password: abc", "x_token=1", "const a = 1", 'token := f("k")', "a\nSECRET=1\nb"]) == [
        "password: [REDACTED]", "x_token=[REDACTED]", "const a = 1", "token : [REDACTED]", "a\nSECRET=[REDACTED]\nb"]


def test_redaction_matches_line_loop_and_is_idempotent(spark):
    import random
    rng = random.Random(7)
    alphabet = ["token", "password", "x", ":", "=", "\n", " ", "\r", "é", "API_KEY", " ", "\t"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(2000)]
    once = redact(spark, texts)
    assert once == [plain_redact(t) for t in texts]
    assert redact(spark, once) == once


def test_token_estimate_and_lines(spark):
    row = spark.createDataFrame([("a" * 30,)], "c string").select(
        text.token_estimate("c").alias("t"), text.line_count("c").alias("n"),
        text.line_count(F.lit("a\nb\n")).alias("m"), text.line_count(F.lit("")).alias("z")).first()
    assert (row.t, row.n, row.m, row.z) == (20, 1, 2, 0)


def greedy(content, limit):
    est = lambda s: len(s) // 3 + 10
    if content == "":
        return []
    if est(content) <= limit:
        return [content]
    out, cur = [], ""
    for line in content.split("\n"):
        if cur and est(cur + line + "\n") > limit:
            out.append(cur)
            cur = ""
        cur += line + "\n"
    return out + [cur]


def test_chunks_match_greedy_loop(spark):
    import random
    rng = random.Random(3)
    texts = ["", "one line", "x" * 500, "\n" * 40] + [
        "\n".join("w" * rng.randrange(60) for _ in range(rng.randrange(40))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", chunks("t", 60).alias("c")).orderBy("i").collect()
    for row, t in zip(rows, texts):
        got = [c.content for c in row.c]
        assert got == greedy(t, 60)
        if len(got) > 1:
            assert "".join(got) == t + "\n"
            assert [c.start_line for c in row.c][1:] == [c.end_line + 1 for c in row.c][:-1]


def test_oversize_line_is_one_chunk(spark):
    row = spark.createDataFrame([("x" * 9000,)], "t string").select(chunks("t", 100).alias("c")).first()
    assert len(row.c) == 1 and row.c[0].content == "x" * 9000 + "\n"


def test_group_digest_ignores_order_but_not_content(spark, make_files):
    a = make_files(("x", "1"), ("y", "2"))
    b = make_files(("y", "2"), ("x", "1")).repartition(3)
    c = make_files(("x", "2"), ("y", "1"))
    one = lambda df: stats.group_digest(df, ["project"], ["path", "content"]).first().digest
    assert one(a) == one(b) != one(c)


@settings(max_examples=25, deadline=None)
@given(st.from_regex(r"[a-z.*?/!]{1,8}", fullmatch=True))
def test_rule_expression_compiles(rule):
    import re
    re.compile(text.glob_regex(rule))
