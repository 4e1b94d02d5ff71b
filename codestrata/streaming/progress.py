"""Structured Streaming over progress events.

Every query has a batch twin in ``operators.progress``; on a finished stream both
give the same rows.  Events later than the watermark are dropped by the engine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codestrata.functions import fixed


def timed(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Event time as a zoned timestamp with a watermark."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def latest_by_run(stream: DataFrame) -> DataFrame:
    """Current state of every run (update or complete mode)."""
    last = F.max_by(F.struct("ts", "seq", "type", "stage", "progress"), F.struct("ts", "seq"))
    return stream.groupBy("run_id").agg(last.alias("l"), F.count("*").alias("n_events")).select(
        "run_id", "l.ts", "l.seq", "l.type", "l.stage", "l.progress", "n_events")


def stall_sessions(stream: DataFrame, gap: str = f"{fixed.STALL_SECONDS} seconds") -> DataFrame:
    """Sessions closed by a silence; ``stalled`` means that no completion was seen."""
    return (stream.groupBy("run_id", F.session_window("ts", gap).alias("w"))
            .agg(F.count("*").alias("n_events"), F.count_if(F.col("type") == "complete").alias("n_complete"))
            .select("run_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("closed_at"),
                    "n_events", (F.col("n_complete") == 0).alias("stalled")))


def progress_rate(stream: DataFrame, width: str = "1 minute", slide: str | None = None) -> DataFrame:
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return stream.groupBy(w.alias("w"), "stage").agg(F.count("*").alias("n_events")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "stage", "n_events")


OUTCOME = "run_id bigint, outcome string, last_progress int, timed_out boolean"
_VALUES = ("run", "started", "late", "at_us", "at_seq", "progress", "final_us", "final_seq", "final", "due_ms")
_STATE = ", ".join(f"{v} array<bigint>" for v in _VALUES)


def outcomes(stream: DataFrame, done: int = fixed.DONE_PERCENT, timeout: int = fixed.TIMEOUT_PERCENT,
             timeout_minutes: int = fixed.TIMEOUT_MINUTES, open_minutes: int = 10,
             forget_days: int = 30, buckets: int = 4096) -> DataFrame:
    """How each run ended, emitted once its timeout has passed in event time.

    A run counts as still open at its timeout when it sends another event within
    ``open_minutes``.  A closed run stays closed: a marker swallows its later
    events until it has been silent for ``forget_days``.

    The state of a run is ten numbers however many events it has.  Runs share a state
    by the hash of their number, so that ``buckets`` calls of Python serve all of them.
    Arrow batches are folded one after the other to rows per second, so a run that fills a whole
    micro-batch is never held in memory as a group.  The run starts with the
    earliest event of the micro-batch that first shows it.  Events without a time are left out.
    """
    limit, grace = timeout_minutes * 60, open_minutes * 60
    forget_ms = forget_days * 86_400_000
    second, n_values = 1_000_000, len(_VALUES)

    # All functions are closures without module globals, so workers need no package.
    def by_second(rows: list, old: list) -> list:
        """Sorted rows (run, us, seq, progress, final): at most two of a run and second, its last event and its first final
        one; none that lie too late to matter, except the last of each run."""
        order = np.lexsort((rows[2], rows[1], rows[0]))
        run, us, seq, progress, final = (x[order] for x in rows)
        sec = us // second
        new_run = np.append(True, run[1:] != run[:-1])
        new_sec = new_run | np.append(True, sec[1:] != sec[:-1])
        keeps = np.append(new_sec[1:], True)
        finals = np.flatnonzero(final)
        keeps[finals[np.unique(np.cumsum(new_sec)[finals], return_index=True)[1]]] = True
        first, owner = np.flatnonzero(new_run), np.cumsum(new_run) - 1
        keeps &= sec <= starts(run[first], sec[first], old)[0][owner] + limit + grace
        keeps |= np.append(new_run[1:], True)
        return [x[keeps] for x in (run, us, seq, progress, final)]

    def starts(runs, low, old: list) -> tuple:
        """Start of each run (negative if it is closed), whether it is known, and its place in the state."""
        place = np.searchsorted(old[0], runs)
        known = place < len(old[0])
        known[known] = old[0][place[known]] == runs[known]
        started = low.copy()
        started[known] = old[1][place[known]]
        return started, known, place

    def merged(rows: list, old: list, watermark: int) -> list:
        """State of the runs of some ``by_second`` rows."""
        run, us, seq, progress, final = rows
        sec, new_run = us // second, np.append(True, run[1:] != run[:-1])
        first, owner = np.flatnonzero(new_run), np.cumsum(new_run) - 1
        last = np.append(first[1:], len(run)) - 1
        started, known, place = starts(run[first], sec[first], old)
        out = [np.zeros(len(first), np.int64) for _ in range(n_values)]
        out[3:5] = [x - 1 for x in out[3:5]]
        for x, before in zip(out, old):
            x[known] = before[place[known]]
        out[0], out[1] = run[first], started
        inside = sec <= started[owner] + limit
        late = ~inside & (sec <= started[owner] + limit + grace)
        out[2] |= np.logical_or.reduceat(late, first)
        n_inside = np.add.reduceat(inside.astype(np.int64), first)
        at = np.maximum(first + n_inside - 1, first)
        newer = (n_inside > 0) & ((us[at] > out[3]) | ((us[at] == out[3]) & (seq[at] > out[4])))
        for i, x in ((3, us), (4, seq), (5, progress)):
            out[i][newer] = x[at[newer]]
        ends = np.flatnonzero(inside & (final > 0))
        ended, nth = np.unique(owner[ends], return_index=True)
        ends = ends[nth]
        earlier = (out[8][ended] == 0) | (us[ends] < out[6][ended]) | ((us[ends] == out[6][ended]) & (seq[ends] < out[7][ended]))
        for i, x in ((6, us), (7, seq), (8, final)):
            out[i][ended[earlier]] = x[ends[earlier]]
        out[9] = np.maximum((started + limit + grace + 1) * 1000, watermark + 1)
        closed = started < 0
        for i in range(2, 9):
            out[i][closed] = 0
        out[9][closed] = np.maximum(sec[last[closed]] * 1000, watermark) + forget_ms
        return out

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        old = [np.array(x, np.int64) for x in state.get] if state.exists else [np.zeros(0, np.int64)] * n_values
        kept, more, n_more = None, [], 0
        for rows in () if state.hasTimedOut else batches:
            more.append([rows[c].to_numpy().astype(np.int64) for c in ("run", "us", "seq", "progress", "final")])
            n_more += len(rows)
            if n_more > max(100_000, 0 if kept is None else len(kept[0])):
                kept = by_second([np.concatenate(x) for x in zip(*more, *([kept] if kept else []))], old)
                more, n_more = [], 0
        if more:
            kept = by_second([np.concatenate(x) for x in zip(*more, *([kept] if kept else []))], old)
        new = merged(kept, old, watermark) if kept else [x[:0] for x in old]
        # runs without events here, of which some have come to their end
        silent = [x[~np.isin(old[0], new[0])] for x in old]
        due = silent[9] < watermark
        over = [x[due & (silent[1] >= 0)] for x in silent]
        marks = [over[0], *[np.full(len(over[0]), v, np.int64) for v in (-1, 0, 0, 0, 0, 0, 0, 0, watermark + forget_ms)]]
        now = [np.concatenate(x) for x in zip(new, [x[~due] for x in silent], marks)]
        order = np.argsort(now[0])
        if len(order):
            state.update(tuple(x[order].tolist() for x in now))
            state.setTimeoutTimestamp(max(int(now[9].min()), watermark))
        elif state.exists:
            state.remove()
        if len(over[0]):
            _, _, late, _, _, progress, _, _, final, _ = over
            accepted = progress >= np.where(late > 0, timeout, done)
            outcome = np.select([final == 1, final == 2, accepted & (late > 0), accepted, late > 0],
                                ["complete", "error", "accepted at timeout", "accepted at end", "timeout"], "incomplete")
            runs = over[0] if key[0] >= 0 else np.full(len(late), None)  # events without a run have a bucket of their own
            yield pd.DataFrame({"run_id": runs, "outcome": outcome.astype(object), "last_progress": progress.astype(np.int32), "timed_out": late > 0})

    final = F.when(F.col("type") == "complete", 1).when(F.col("type") == "error", 2).otherwise(0)
    bucket = F.when(F.col("run_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("run_id"), F.lit(buckets)).cast("int"))
    slim = stream.filter("ts is not null").select(
        bucket.alias("bucket"), F.coalesce("run_id", F.lit(0)).alias("run"), "ts", F.unix_micros("ts").alias("us"),
        F.coalesce("seq", F.lit(-1)).alias("seq"), F.coalesce("progress", F.lit(0)).alias("progress"), final.alias("final"))
    return slim.groupBy("bucket").applyInPandasWithState(
        step, OUTCOME, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
