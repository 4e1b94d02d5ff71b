import json

from pyspark.sql import functions as F

from codestrata.operators import summaries
from codestrata.plans.corpus import crawl
from codestrata.sources import cache, files, sinks


def write(root, name, data):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def test_scan_files(spark, tmp_path):
    write(tmp_path, "one/src/a.go", b"package a\n")
    write(tmp_path, "one/bad.txt", b"a\xff\xfeb")
    write(tmp_path, "two/b.py", "é = 1\n".encode())
    (tmp_path / "two" / "empty").mkdir()
    got = {(r.project, r.path): r for r in files.scan_files(spark, str(tmp_path)).collect()}
    assert set(got) == {("one", "src/a.go"), ("one", "bad.txt"), ("two", "b.py")}
    assert got[("two", "b.py")].content == "é = 1\n" and got[("two", "b.py")].size == 7
    assert got[("one", "bad.txt")].content.startswith("a�")
    single = files.scan_files(spark, str(tmp_path / "one"), project="x", glob="*.go", max_bytes=100)
    assert [(r.project, r.path) for r in single.collect()] == [("x", "src/a.go")]


def test_scan_feeds_the_crawl(spark, tmp_path):
    write(tmp_path, "one/.gitignore", b"*.tmp.go\n")
    write(tmp_path, "one/a.go", b"token = 1\n")
    write(tmp_path, "one/x.tmp.go", b"")
    write(tmp_path, "one/node_modules/z.js", b"")
    got = crawl(files.scan_files(spark, str(tmp_path))).collect()
    assert [(r.path, r.content) for r in got] == [("a.go", "token =[REDACTED]\n")]


def test_size_filter_reaches_the_source(spark, tmp_path):
    write(tmp_path, "one/a.go", b"x")
    plan = files.scan_files(spark, str(tmp_path), max_bytes=10)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length" in plan.replace(" ", "")


def test_cache_hit_needs_hash_and_age(spark, tmp_path, make_files):
    store = str(tmp_path / "cache")
    fs = make_files(("same", "1"), ("changed", "2"), ("old", "3"), ("new", "4")).withColumn("key", F.col("path"))
    md5 = lambda v: F.md5(F.lit(v).cast("binary"))
    rows = fs.filter("path <> 'new'").select(
        "key", F.when(F.col("path") == "changed", md5("x")).otherwise(F.md5(F.col("content").cast("binary"))).alias("content_hash"),
        F.when(F.col("path") == "old", F.lit("2024-01-01 00:00:00")).otherwise(F.lit("2024-01-02 00:30:00")).cast("timestamp").alias("ts"),
        F.lit("{}").alias("result"))
    cache.cache_write(rows, store, "file")
    cache.cache_write(rows.filter("key = 'same'").withColumn("result", F.lit("newer")).withColumn("ts", F.expr("ts + interval 1 minute")), store, "file")
    cache.cache_write(rows, store, "folder")
    stored = cache.cache_read(spark, store, "file")
    hits, todo = cache.split_by_cache(fs, stored, F.lit("2024-01-02 01:00:00").cast("timestamp"))
    assert [(r.path, r.result) for r in hits.collect()] == [("same", "newer")]
    assert sorted(r.path for r in todo.collect()) == ["changed", "new", "old"]


def test_stored_json_entries(spark, tmp_path):
    entry = {"content_hash": "h", "timestamp": "2025-09-26T17:07:52.207764+07:00",
             "result": {"language": "Go", "purpose": "p", "key_types": ["A"], "functions": None, "imports": None, "complexity": "low"}}
    (tmp_path / "auth.go_file_f088bc3f.json").write_text(json.dumps(entry, indent=1))
    (tmp_path / "other.json").write_text("{}")
    row = cache.read_cache_json(spark, str(tmp_path)).first()
    assert (row.name, row.language, row.key_types, row.complexity) == ("auth.go", "go", ["A"], "low")
    assert row.ts is not None


def test_graph_store_returns_newest_fresh_generation(spark, tmp_path):
    path = str(tmp_path / "graph")
    schema = "project string, `from` string, `to` string"
    at = lambda t: F.lit(t).cast("timestamp")
    sinks.save_graph(spark.createDataFrame([("p", "a", "b"), ("q", "x", "y")], schema), path, at("2024-01-01 00:00:00"))
    sinks.save_graph(spark.createDataFrame([("p", "a", "c")], schema), path, at("2024-01-01 10:00:00"))
    load = lambda now: [(r["from"], r["to"]) for r in sinks.load_graph(spark, path, "p", at(now)).collect()]
    assert load("2024-01-01 12:00:00") == [("a", "c")]
    assert load("2024-01-03 00:00:00") == []


def test_result_sinks(spark, tmp_path, make_files):
    df = make_files(("a", "1"))
    sinks.write_results(df, str(tmp_path / "json"))
    assert json.loads(spark.read.text(str(tmp_path / "json")).first().value) == {"project": "p", "path": "a", "content": "1"}
    sinks.write_facts({"files": df}, str(tmp_path / "facts"))
    assert spark.read.parquet(str(tmp_path / "facts" / "files")).count() == 1


def test_pluggable_summarizer(spark, make_files):
    def loud(batches):
        for pdf in batches:
            yield pdf.assign(folder="f", language="L", purpose=pdf.content.str.upper(), complexity="low", key_types=None,
                             imports=None, tokens=1, lines=1)[["project", "path", "folder", "language", "purpose", "complexity",
                                                              "key_types", "imports", "tokens", "lines"]]
    out = summaries.summarize_files(make_files(("a", "hi"), ("b", "")), loud).collect()
    assert [(r.path, r.purpose) for r in out] == [("a", "HI")]
