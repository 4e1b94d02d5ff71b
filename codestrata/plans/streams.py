"""Streaming twins of the progress queries, run over everything available.

Append queries release a window once the watermark has passed it, so their SQL
keeps the rows up to the newest event minus the allowed delay.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from codestrata.operators import filters
from codestrata.plans.registry import query
from codestrata.session import shared_dir
from codestrata.sources import views
from codestrata.sources.files import read_files_stream
from codestrata.streaming import progress as sp, schema_state
from codestrata.streaming.run import drain

_GAP = 1800
_CLOSED = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM progress)"


def _stream(spark, sf):
    schema = views.table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return sp.timed(views.shape_progress(events))


def _plain(df, *columns):
    """Zoned stream times back to the plain times of the events table."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("stream_latest", """WITH $PROGRESS
SELECT run_id, arg_max(ts, (ts, seq)) AS ts, arg_max(seq, (ts, seq)) AS seq, arg_max(type, (ts, seq)) AS type, arg_max(stage, (ts, seq)) AS stage,
  arg_max(progress, (ts, seq)) AS progress, count(*) AS n_events FROM progress GROUP BY run_id""")
def q_latest(spark, sf):
    return _plain(drain(sp.latest_by_run(_stream(spark, sf)), "complete"), "ts")


@query("stream_rate", f"""WITH $PROGRESS,
r AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, stage, count(*) AS n_events FROM progress GROUP BY ALL)
SELECT window_start, window_start + INTERVAL 1 MINUTE AS window_end, stage, n_events FROM r WHERE window_start + INTERVAL 1 MINUTE <= {_CLOSED}""")
def q_rate(spark, sf):
    return _plain(drain(sp.progress_rate(_stream(spark, sf))), "window_start", "window_end")


@query("stream_sessions", f"""WITH $PROGRESS,
g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL {_GAP} SECOND THEN 1 ELSE 0 END AS gap FROM progress WINDOW w AS (PARTITION BY run_id ORDER BY ts, seq)),
s AS (SELECT *, sum(gap) OVER (PARTITION BY run_id ORDER BY ts, seq) AS no FROM g),
z AS (SELECT run_id, min(ts) AS started_at, max(ts) + INTERVAL {_GAP} SECOND AS closed_at, count(*) AS n_events, count(*) FILTER (type = 'complete') = 0 AS stalled
  FROM s GROUP BY run_id, no)
SELECT * FROM z WHERE closed_at <= {_CLOSED}""")
def q_sessions(spark, sf):
    return _plain(drain(sp.stall_sessions(_stream(spark, sf), f"{_GAP} seconds")), "started_at", "closed_at")


@query("stream_outcome", f"""WITH $PROGRESS,
s AS (SELECT *, date_trunc('second', ts) AS sec, date_trunc('second', min(ts) OVER (PARTITION BY run_id)) AS t0 FROM progress),
f AS (SELECT run_id, arg_min(type, (ts, seq)) FILTER (type IN ('complete', 'error') AND sec <= t0 + INTERVAL 35 MINUTE) AS final_type,
   arg_max(progress, (ts, seq)) FILTER (sec <= t0 + INTERVAL 35 MINUTE) AS last_progress,
   bool_or(sec > t0 + INTERVAL 35 MINUTE AND sec <= t0 + INTERVAL 45 MINUTE) AS timed_out FROM s
  WHERE t0 + INTERVAL 45 MINUTE + INTERVAL 1 SECOND < {_CLOSED} GROUP BY run_id)
SELECT run_id, last_progress, timed_out, CASE WHEN final_type IS NOT NULL THEN final_type
  WHEN timed_out AND last_progress >= 75 THEN 'accepted at timeout' WHEN timed_out THEN 'timeout'
  WHEN last_progress >= 90 THEN 'accepted at end' ELSE 'incomplete' END AS outcome FROM f""")
def q_outcome(spark, sf):
    return drain(sp.outcomes(_stream(spark, sf)))


@query("stream_schema", """WITH $REPOS, $DDL
SELECT project, 'table' AS part, tbl AS name, '' AS item, since_path AS body FROM live
UNION ALL SELECT project, 'column', tbl, col, concat_ws(' ', type, nullable, "default", is_pk) FROM columns
UNION ALL SELECT project, 'key', tbl, kind, array_to_string(cols, ',') FROM keysets
UNION ALL SELECT project, 'foreign key', tbl, array_to_string(cols, ','), ref_tbl || '.' || array_to_string(ref_cols, ',') FROM fkeys
UNION ALL SELECT project, 'index', tbl, name, array_to_string(cols, ',') FROM liveidx
UNION ALL SELECT project, 'enum', name, '', array_to_string(vals, ',') FROM enums
UNION ALL SELECT project, 'view', name, '', sql FROM liveviews
UNION ALL SELECT project, 'progress', path, '', row_number() OVER (PARTITION BY project ORDER BY starts_with(path, 'db/'), path) || '/' ||
  CASE WHEN starts_with(path, 'db/') THEN count(*) OVER (PARTITION BY project) ELSE count(*) FILTER (NOT starts_with(path, 'db/')) OVER (PARTITION BY project) END FROM mig""")
def q_schema(spark, sf):
    """Two batches: migrations of the main folder, then those of ``db``, which come first in the order of the log."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    migrations = filters.migration_files(views.repos(spark, sf)).select("project", "path", "content")
    for late in (False, True):
        migrations.filter(F.col("path").startswith("db/") == late).write.mode("append").parquet(f"{base}/in")
        schema_state.schema_stream(read_files_stream(spark, f"{base}/in"), f"{base}/store", f"{base}/checkpoint").awaitTermination()
    s = schema_state.current(spark, f"{base}/store", persist=True)
    joined = lambda c: F.array_join(c, ",")
    empty = F.lit("")

    def part(df: DataFrame, name: str, owner: str, item, body) -> DataFrame:
        return df.select("project", F.lit(name).alias("part"), F.col(owner).alias("name"), item.alias("item"), body.alias("body"))

    progress = spark.read.parquet(f"{base}/store/progress")
    return reduce(DataFrame.unionByName, [
        part(s.tables, "table", "tbl", empty, F.col("since_path")),
        part(s.columns, "column", "tbl", F.col("col"), F.concat_ws(" ", "type", F.col("nullable").cast("string"), "default", F.col("is_pk").cast("string"))),
        part(s.keys, "key", "tbl", F.col("kind"), joined("cols")),
        part(s.fks, "foreign key", "tbl", joined("cols"), F.concat("ref_tbl", F.lit("."), joined("ref_cols"))),
        part(s.indexes, "index", "tbl", F.col("name"), joined("cols")),
        part(s.enums, "enum", "name", empty, joined("vals")), part(s.views, "view", "name", empty, F.col("sql")),
        part(progress, "progress", "path", empty, F.concat_ws("/", "current", "total"))])
