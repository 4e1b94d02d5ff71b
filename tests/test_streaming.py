"""Streams against their batch twins; the sentinel event closes every window."""

import pytest
from pyspark.sql import functions as F

from codestrata.functions import text
from codestrata.operators import progress as batch
from codestrata.sources import cache, files, views
from codestrata.streaming import incremental, progress as sp
from codestrata.streaming.run import drain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    late = (ev.orderBy(F.desc("ts")).limit(1).withColumn("user_id", F.lit(-1).cast("bigint"))
            .withColumn("event_id", F.lit(10**9).cast("bigint")).withColumn("ts", F.expr("ts + interval 10 days")))
    folder = str(tmp_path_factory.mktemp("events") / "ev")
    ev.unionByName(late).orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 400).parquet(folder)
    stream = lambda: sp.timed(views.shape_progress(
        spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(folder)))
    return stream, views.shape_progress(ev)


def bag(df, *cols):
    rows = df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t.startswith("timestamp") else F.col(c)
                       for c, t in df.dtypes if c in cols or not cols])
    return sorted((tuple(r[c] for c in sorted(r.__fields__)) for r in rows.collect()), key=repr)


def test_latest(events):
    stream, ev = events
    assert bag(drain(sp.latest_by_run(stream()), "complete").filter("run_id >= 0")) == bag(batch.latest_progress(ev))


def test_rate(events):
    stream, ev = events
    assert bag(drain(sp.progress_rate(stream()))) == bag(batch.progress_rate(ev))


def test_sessions(events):
    stream, ev = events
    got = drain(sp.stall_sessions(stream(), "1800 seconds")).filter("run_id >= 0")
    want = batch.sessions(ev, 1800)
    assert bag(got, "run_id", "started_at", "n_events", "stalled") == bag(want, "run_id", "started_at", "n_events", "stalled")


def test_outcomes_emit_once_and_match(events):
    stream, ev = events
    got = drain(sp.outcomes(stream())).filter("run_id >= 0")
    assert bag(got) == bag(batch.outcomes(ev))


def test_outcomes_of_many_runs_share_states(spark, tmp_path):
    """A state for each run, and a call of Python for each state, take as long as all other work."""
    kind = F.expr("case when n % 11 = 5 then 'complete' when n % 13 = 6 then 'error' else 'progress' end")
    made = spark.range(60 * 40).select(F.expr("id % 60").alias("run_id"), F.expr("id div 60").alias("n"), F.col("id").alias("seq"))
    made = made.filter("n < 5 + run_id % 30").select(
        F.expr("case when run_id < 59 then run_id end").alias("run_id"), "seq", "n", F.expr(
            "timestamp_seconds(1700000000 + run_id * 50 + n * (30 + run_id % 7 * 20))").cast("timestamp_ntz").alias("ts"),
        kind.alias("type"), F.lit("s").alias("stage"), F.expr("cast((n * 7 + run_id) % 101 as int)").alias("progress"))
    end = spark.sql("select -1L as run_id, -1L as seq, timestamp_ntz'2024-01-01' as ts, 'progress' as type, 's' as stage, 0 as progress")
    folder = str(tmp_path / "in")
    made.drop("n").unionByName(end).orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 200).parquet(folder)
    stream = spark.readStream.schema(end.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = str(tmp_path / "out")
    query = sp.outcomes(sp.timed(stream), buckets=3).writeStream.option("checkpointLocation", str(tmp_path / "chk")).trigger(
        availableNow=True).format("parquet").option("path", out).start()
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4  # one more for events without a run
    got = spark.read.parquet(out)
    assert bag(got.filter("run_id >= 0")) == bag(batch.outcomes(made.drop("n")))
    assert [(r.outcome, r.last_progress, r.timed_out) for r in got.filter("run_id is null").collect()] == [("complete", 18, True)]


def fixed_progress(spark, *rows):
    return spark.createDataFrame(rows, "run_id bigint, seq bigint, ts string, type string, stage string, progress int").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz"))


def test_stall_needs_more_than_thirty_seconds(spark):
    df = fixed_progress(spark, *[(1, i, f"2024-01-01 00:00:{s:02d}", "progress", "s", 1) for i, s in enumerate((0, 10, 50))])
    rows = batch.stalls(df).collect()
    assert [(r.stalled_at.second, r.resumed_at.second) for r in rows] == [(10, 50)]
    assert batch.stalls(fixed_progress(spark, (1, 0, "2024-01-01 00:00:00", "p", "s", 1), (1, 1, "2024-01-01 00:00:30", "p", "s", 1))).count() == 0


def test_end_without_completion(spark):
    df = fixed_progress(spark, (1, 0, "2024-01-01 00:00:00", "progress", "s", 92), (2, 1, "2024-01-01 00:00:00", "progress", "s", 80),
                        (3, 2, "2024-01-01 00:00:00", "progress", "s", 80), (3, 3, "2024-01-01 00:40:00", "progress", "s", 81),
                        (4, 4, "2024-01-01 00:00:00", "progress", "s", 10), (4, 5, "2024-01-01 00:40:00", "complete", "s", 100))
    assert {r.run_id: r.outcome for r in batch.outcomes(df).collect()} == {
        1: "accepted at end", 2: "incomplete", 3: "accepted at timeout", 4: "timeout"}


def test_quota_refused_requests_use_no_day_quota(spark):
    rows = [(i, f"2024-01-01 00:{m:02d}:{s:02d}") for i, (m, s) in enumerate([(0, 1), (0, 2), (0, 3), (1, 0), (1, 1), (1, 2), (2, 0)])]
    df = spark.createDataFrame(rows, "seq bigint, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r.seq: (r.minute_ok, r.admitted) for r in batch.admit_quota(df, 2, 3).collect()}
    assert got == {0: (True, True), 1: (True, True), 2: (False, False), 3: (True, True), 4: (True, False), 5: (False, False), 6: (True, False)}


def test_incremental_analysis_skips_known_content(spark, tmp_path, make_files):
    src, store, chk = str(tmp_path / "in"), str(tmp_path / "cache"), str(tmp_path / "chk")
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")

    def run():
        incremental.analyze_incremental(files.read_files_stream(spark, src), store, chk, now).awaitTermination()
        return spark.read.parquet(store)

    make_files(("a.go", "1"), ("b.go", "2")).coalesce(1).write.parquet(src)
    assert run().count() == 2
    make_files(("a.go", "1"), ("b.go", "changed")).coalesce(1).write.mode("append").parquet(src)
    assert run().count() == 3
    assert cache.cache_read(spark, store, "file").count() == 2


def test_expiry(spark):
    row = spark.range(1).select(text.is_expired(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-02 00:00:01").cast("timestamp")).alias("a"),
                                text.is_expired(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-02 00:00:00").cast("timestamp")).alias("b")).first()
    assert (row.a, row.b) == (True, False)
