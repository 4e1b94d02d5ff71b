"""Progress events: latest state, stalls, outcomes, rates and request quotas.

A run may own a third of all events, so nothing here sorts a whole run.  Stall
detection first folds events into fixed buckets as wide as the allowed gap: two
events of one bucket cannot be further apart than the gap, so gaps only occur
between consecutive non-empty buckets and the window runs over bucket rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codestrata.functions import fixed


def latest_progress(progress: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("ts", "seq", "type", "stage", "progress"), F.struct("ts", "seq"))
    return progress.groupBy("run_id").agg(last.alias("l"), F.count("*").alias("n_events")).select(
        "run_id", "l.ts", "l.seq", "l.type", "l.stage", "l.progress", "n_events")


def _bucket(gap_seconds: int) -> Column:
    return F.window("ts", f"{gap_seconds} seconds").start


def buckets(progress: DataFrame, gap_seconds: int = fixed.STALL_SECONDS) -> DataFrame:
    """Per (run, bucket): first and last event time, counts; combines before the shuffle."""
    return progress.groupBy("run_id", _bucket(gap_seconds).alias("bucket")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_events"),
        F.count_if(F.col("type") == "complete").alias("n_complete"),
        F.max_by("progress", F.struct("ts", "seq")).alias("last_progress"))


def _with_gap(df: DataFrame, gap_seconds: int) -> DataFrame:
    w = Window.partitionBy("run_id").orderBy("bucket")
    prev = F.lag("last_ts").over(w)
    return df.withColumn("prev_ts", prev).withColumn(
        "is_gap", F.coalesce(F.col("first_ts") > F.col("prev_ts") + F.expr(f"INTERVAL '{gap_seconds}' SECOND"), F.lit(False)))


def stalls(progress: DataFrame, gap_seconds: int = fixed.STALL_SECONDS) -> DataFrame:
    """Silences longer than the gap: last event before, first event after."""
    return _with_gap(buckets(progress, gap_seconds), gap_seconds).filter("is_gap").select(
        "run_id", F.col("prev_ts").alias("stalled_at"), F.col("first_ts").alias("resumed_at"))


def sessions(progress: DataFrame, gap_seconds: int = fixed.STALL_SECONDS) -> DataFrame:
    """Runs of events without a longer silence; ``stalled`` sessions saw no completion."""
    gaps = _with_gap(buckets(progress, gap_seconds), gap_seconds)
    w = Window.partitionBy("run_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    marked = gaps.withColumn("session_no", F.sum(F.col("is_gap").cast("int")).over(w))
    return marked.groupBy("run_id", "session_no").agg(
        F.min("first_ts").alias("started_at"), F.max("last_ts").alias("ended_at"),
        F.sum("n_events").alias("n_events"), F.max_by("last_progress", "bucket").alias("last_progress"),
        (F.sum("n_complete") == 0).alias("stalled"))


def outcomes(progress: DataFrame, done: int = fixed.DONE_PERCENT, timeout: int = fixed.TIMEOUT_PERCENT,
             timeout_minutes: int = fixed.TIMEOUT_MINUTES, open_minutes: int = 10) -> DataFrame:
    """How each run ended: by its first final event, by its last progress, or by timeout.

    The timeout counts in whole seconds from the first event of the run; events
    after it only show, within ``open_minutes``, that the run was still open.
    """
    end = F.expr(f"INTERVAL '{timeout_minutes}' MINUTE")
    still = F.expr(f"INTERVAL '{timeout_minutes + open_minutes}' MINUTE")
    timed = progress.withColumn("sec", F.window("ts", "1 second").start)
    started = timed.groupBy("run_id").agg(F.min("sec").alias("started_at"))
    seen = timed.join(started, "run_id").filter(F.col("sec") <= F.col("started_at") + still)
    on_time = F.col("sec") <= F.col("started_at") + end
    order = F.struct("ts", "seq")
    final = F.col("type").isin("complete", "error")
    folded = seen.groupBy("run_id").agg(
        F.min_by("type", F.when(final & on_time, order)).alias("final_type"),
        F.max_by("progress", F.when(on_time, order)).alias("last_progress"),
        F.bool_or(~on_time).alias("late"))
    timed_out = F.col("late")
    need = F.when(timed_out, F.lit(timeout)).otherwise(F.lit(done))
    outcome = (F.when(F.col("final_type") == "complete", "complete").when(F.col("final_type") == "error", "error")
               .when(F.col("last_progress") >= need, F.when(timed_out, "accepted at timeout").otherwise("accepted at end"))
               .otherwise(F.when(timed_out, "timeout").otherwise("incomplete")))
    return folded.select("run_id", "last_progress", timed_out.alias("timed_out"), outcome.alias("outcome"))


def progress_rate(progress: DataFrame, width: str = "1 minute", slide: str | None = None) -> DataFrame:
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return progress.groupBy(w.alias("w"), "stage").agg(F.count("*").alias("n_events")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "stage", "n_events")


def phase_of(progress: Column | str) -> Column:
    """Phase a percentage belongs to: the last one that has started."""
    p = F.col(progress) if isinstance(progress, str) else progress
    out = F.lit("start")
    for percent, name in fixed.PHASES:
        out = F.when(p >= percent, name).otherwise(out)
    return out


def phase_counts(progress: DataFrame) -> DataFrame:
    return progress.groupBy("run_id", phase_of("progress").alias("phase")).agg(
        F.count("*").alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def report_frequency(n_files: Column | str) -> Column:
    """Files between two progress reports, by corpus size."""
    n = F.col(n_files) if isinstance(n_files, str) else n_files
    return F.when(n > 500, 50).when(n > 100, 20).otherwise(5)


def admit_quota(requests: DataFrame, per_minute: int = fixed.REQUESTS_PER_MINUTE, per_day: int = fixed.REQUESTS_PER_DAY,
                order: tuple[str, str] = ("ts", "seq")) -> DataFrame:
    """Flag the first n requests of every calendar minute and day as admitted.

    A request refused by the minute quota uses no day quota.  Only the cut-off of
    each minute and day is computed: the rank filter keeps at most ``per_minute``
    rows of a minute before the shuffle, and a day then holds at most 1,440 times
    that many.  All other rows merely compare themselves with the cut-off.
    """
    at = F.struct(*order)
    slots = (requests.withColumn("minute", F.window("ts", "1 minute").start)
             .withColumn("day", F.window("ts", "1 day").start))
    by_minute = Window.partitionBy("minute").orderBy(*order)
    first = (slots.select("minute", "day", *order).withColumn("rank", F.row_number().over(by_minute))
             .filter(F.col("rank") <= per_minute))
    minute_cut = first.groupBy("minute").agg(F.max(at).alias("minute_cut"))
    by_day = Window.partitionBy("day").orderBy(*order)
    day_cut = (first.drop("rank").withColumn("rank", F.row_number().over(by_day)).filter(F.col("rank") <= per_day)
               .groupBy("day").agg(F.max(at).alias("day_cut")))
    in_minute = at <= F.col("minute_cut")
    return (slots.join(minute_cut, "minute").join(day_cut, "day", "left")
            .withColumn("minute_ok", in_minute)
            .withColumn("admitted", in_minute & F.coalesce(at <= F.col("day_cut"), F.lit(False)))
            .drop("minute_cut", "day_cut"))


def quota_usage(admitted: DataFrame) -> DataFrame:
    """Requests and admissions per minute."""
    return admitted.groupBy("minute").agg(F.count("*").alias("n_requests"), F.count_if("admitted").alias("n_admitted"))
