"""Queries over progress events and request quotas."""

from __future__ import annotations

from codestrata.functions import fixed
from codestrata.operators import progress
from codestrata.plans.registry import query
from codestrata.sources import views

_GAP = 1800  # the test events are minutes apart; half an hour is a stall there


@query("progress_latest", """WITH $PROGRESS
SELECT run_id, arg_max(ts, (ts, seq)) AS ts, arg_max(seq, (ts, seq)) AS seq, arg_max(type, (ts, seq)) AS type, arg_max(stage, (ts, seq)) AS stage,
  arg_max(progress, (ts, seq)) AS progress, count(*) AS n_events FROM progress GROUP BY run_id""")
def q_latest(spark, sf):
    return progress.latest_progress(views.progress(spark, sf))


_STALLS = """WITH $PROGRESS, g AS (SELECT *, lag(ts) OVER (PARTITION BY run_id ORDER BY ts, seq) AS prev FROM progress)
SELECT run_id, prev AS stalled_at, ts AS resumed_at FROM g WHERE ts > prev + INTERVAL {} SECOND"""


@query("progress_stalls", _STALLS.format(_GAP))
def q_stalls(spark, sf):
    return progress.stalls(views.progress(spark, sf), _GAP)


@query("progress_stalls_30s", _STALLS.format(fixed.STALL_SECONDS))
def q_stalls_30(spark, sf):
    return progress.stalls(views.progress(spark, sf))


@query("progress_sessions", f"""WITH $PROGRESS,
g AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL {_GAP} SECOND THEN 1 ELSE 0 END AS gap FROM progress WINDOW w AS (PARTITION BY run_id ORDER BY ts, seq)),
s AS (SELECT *, CAST(sum(gap) OVER (PARTITION BY run_id ORDER BY ts, seq) AS BIGINT) AS session_no FROM g)
SELECT run_id, session_no, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS n_events, arg_max(progress, (ts, seq)) AS last_progress,
  count(*) FILTER (type = 'complete') = 0 AS stalled FROM s GROUP BY ALL""")
def q_sessions(spark, sf):
    return progress.sessions(views.progress(spark, sf), _GAP)


@query("progress_outcome", """WITH $PROGRESS,
s AS (SELECT *, date_trunc('second', ts) AS sec, date_trunc('second', min(ts) OVER (PARTITION BY run_id)) AS t0 FROM progress),
f AS (SELECT run_id, arg_min(type, (ts, seq)) FILTER (type IN ('complete', 'error') AND sec <= t0 + INTERVAL 35 MINUTE) AS final_type,
   arg_max(progress, (ts, seq)) FILTER (sec <= t0 + INTERVAL 35 MINUTE) AS last_progress,
   bool_or(sec > t0 + INTERVAL 35 MINUTE AND sec <= t0 + INTERVAL 45 MINUTE) AS timed_out FROM s GROUP BY run_id)
SELECT run_id, last_progress, timed_out, CASE WHEN final_type IS NOT NULL THEN final_type
  WHEN timed_out AND last_progress >= 75 THEN 'accepted at timeout' WHEN timed_out THEN 'timeout'
  WHEN last_progress >= 90 THEN 'accepted at end' ELSE 'incomplete' END AS outcome FROM f""")
def q_outcome(spark, sf):
    return progress.outcomes(views.progress(spark, sf))


@query("progress_rate", """WITH $PROGRESS
SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE AS window_end, stage, count(*) AS n_events
FROM progress GROUP BY ALL""")
def q_rate(spark, sf):
    return progress.progress_rate(views.progress(spark, sf))


@query("progress_rate_sliding", """WITH $PROGRESS,
x AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE * k AS window_start, stage FROM progress, LATERAL (SELECT unnest([0, 1]) AS k) u)
SELECT window_start, window_start + INTERVAL 10 MINUTE AS window_end, stage, count(*) AS n_events FROM x GROUP BY ALL""")
def q_rate_sliding(spark, sf):
    return progress.progress_rate(views.progress(spark, sf), "10 minutes", "5 minutes")


@query("progress_phases", f"""WITH $PROGRESS
SELECT run_id, CASE {" ".join(f"WHEN progress >= {p} THEN '{n}'" for p, n in reversed(fixed.PHASES))} ELSE 'start' END AS phase,
  count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts FROM progress GROUP BY ALL""")
def q_phases(spark, sf):
    return progress.phase_counts(views.progress(spark, sf))


_PER_MINUTE, _PER_DAY = 2, 100


@query("quota_admission", f"""WITH $PROGRESS,
m AS (SELECT seq, ts, time_bucket(INTERVAL 1 MINUTE, ts) AS minute, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day,
  row_number() OVER (PARTITION BY time_bucket(INTERVAL 1 MINUTE, ts) ORDER BY ts, seq) <= {_PER_MINUTE} AS minute_ok FROM progress),
d AS (SELECT *, sum(CASE WHEN minute_ok THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY ts, seq) AS used FROM m)
SELECT seq, ts, minute, day, minute_ok, minute_ok AND used <= {_PER_DAY} AS admitted FROM d""")
def q_quota(spark, sf):
    return progress.admit_quota(views.progress(spark, sf).select("seq", "ts"), _PER_MINUTE, _PER_DAY)


@query("quota_usage", f"""WITH $PROGRESS,
m AS (SELECT seq, ts, time_bucket(INTERVAL 1 MINUTE, ts) AS minute, row_number() OVER (PARTITION BY time_bucket(INTERVAL 1 MINUTE, ts) ORDER BY ts, seq) <= {fixed.REQUESTS_PER_MINUTE} AS ok FROM progress),
d AS (SELECT *, ok AND sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, seq) <= {fixed.REQUESTS_PER_DAY} AS adm FROM m)
SELECT minute, count(*) AS n_requests, count(*) FILTER (adm) AS n_admitted FROM d GROUP BY minute""")
def q_usage(spark, sf):
    return progress.quota_usage(progress.admit_quota(views.progress(spark, sf).select("seq", "ts")))
