"""Batch twins of the streaming operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.sources.corpus import NOW, Corpus, job_events, query_log
from shelfmark.sources.durable import checkpoint_folder
from shelfmark.streaming import jobs as T
from shelfmark.streaming import progress as P
from shelfmark.streaming import query_log as L

from .registry import query

_STATE = """s AS (SELECT job_id, coalesce(arg_min(status, (ts, event_id)) FILTER (WHERE status IN ('succeeded', 'failed')), arg_max(status, (ts, event_id))) AS status,
    coalesce(min(ts) FILTER (WHERE status IN ('succeeded', 'failed')), max(ts)) AS ts FROM job_events GROUP BY job_id)"""
_NEXT = "n AS (SELECT *, lead(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS next_ts FROM job_events)"


@query(f"WITH {_STATE} SELECT * FROM s", "job_events")
def t1_job_state(c: Corpus) -> DataFrame:
    return T.job_state(c.job_events)


@query(f"WITH {_NEXT} SELECT job_id, min(ts) + INTERVAL 600 SECOND AS ts FROM n WHERE status = 'running' AND epoch_us(next_ts) - epoch_us(ts) > 600000000 GROUP BY job_id", "job_events")
def t2_watchdog(c: Corpus) -> DataFrame:
    return T.watchdog(c.job_events)


@query(f"WITH {_NEXT} SELECT job_id, stage, CAST(sum(coalesce(floor((epoch_us(next_ts) - epoch_us(ts)) / 1000.0::DOUBLE), 0)) AS BIGINT) AS ms FROM n GROUP BY ALL", "job_events")
def t3_stage_durations(c: Corpus) -> DataFrame:
    return T.stage_durations(c.job_events)


@query(
    """WITH e AS (SELECT job_id, arg_min(done_files, (ts, event_id)) AS d0, arg_max(done_files, (ts, event_id)) AS d1, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE AS gone FROM job_events GROUP BY 1)
    SELECT job_id, CASE WHEN gone >= 1 AND d1 > d0 THEN round(gone / (d1 - d0) * (10 - d1), 3) END AS seconds FROM e""",
    "job_events",
)
def t4_eta(c: Corpus) -> DataFrame:
    return T.eta(c.job_events)


@query("SELECT job_id, stage FROM (SELECT job_id, arg_max(status, (ts, event_id)) AS status, arg_max(stage, (ts, event_id)) AS stage FROM job_events GROUP BY 1) WHERE status = 'running'", "job_events")
def t5_active_stages(c: Corpus) -> DataFrame:
    from shelfmark.operators.tables import latest

    return T.active_stages(latest(c.job_events, "job_id", "ts")).select("job_id", "stage")


@query(f"WITH {_STATE} SELECT job_id, status FROM s WHERE NOT (status IN ('succeeded', 'failed') AND ts < TIMESTAMP '2024-01-31' - INTERVAL 14 DAY)", "job_events")
def t7_purge_old(c: Corpus) -> DataFrame:
    return T.purge_old(T.job_state(c.job_events), NOW, 14).select("job_id", "status")


@query(f"WITH {_STATE} SELECT job_id, CASE WHEN status IN ('pending', 'running') THEN 'failed' ELSE status END AS status, CASE WHEN status IN ('pending', 'running') THEN 'server_restart' END AS error FROM s", "job_events")
def t8_close_orphans(c: Corpus) -> DataFrame:
    return T.close_orphans(T.job_state(c.job_events)).select("job_id", "status", "error")


@query("SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM query_log WHERE length(trim(CASE WHEN event_id % 9 = 0 THEN '  ' ELSE query END)) > 0 GROUP BY 1", "query_log")
def t9_query_log(c: Corpus) -> DataFrame:
    from shelfmark.operators.stats import queries_by_day

    blank = c.query_log.withColumn("query", F.when(F.col("event_id") % 9 == 0, "  ").otherwise(F.col("query")))
    return queries_by_day(T.capture_queries(blank)).select("day", "n")


@query(
    """WITH p AS (SELECT *, CASE WHEN lag(stage) OVER w = stage THEN 0 ELSE 1 END AS new FROM job_events WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)),
    e AS (SELECT job_id, arg_max(stage, (ts, event_id)) AS stage, max(ts) AS ts, arg_max(done_files, (ts, event_id)) AS done, arg_max(ts, (ts, event_id)) FILTER (WHERE new = 1) AS ts0, arg_max(done_files, (ts, event_id)) FILTER (WHERE new = 1) AS done0 FROM p GROUP BY 1),
    g AS (SELECT *, (epoch_us(ts) - epoch_us(ts0)) / 1000000.0::DOUBLE AS gone FROM e)
    SELECT job_id, stage, CASE WHEN gone >= 1 AND done > done0 THEN CAST(floor(greatest(10 - done, 0) / ((done - done0) / gone)) AS BIGINT) END AS seconds FROM g""",
    "job_events",
)
def t4_stage_eta(c: Corpus) -> DataFrame:
    return T.stage_eta(c.job_events.select("job_id", "stage", "ts", "event_id", F.col("done_files").alias("done"), F.col("total_files").alias("total")))


@query(
    """WITH t AS (SELECT CAST(user_id AS VARCHAR) AS job_id, avg(value * 1000) FILTER (WHERE event_type <> 'error' AND value > 0) / 1000 AS mean, CAST(max(event_id % 10) AS INT) AS processed, max(user_id) AS u FROM events GROUP BY 1)
    SELECT job_id, CASE WHEN mean IS NOT NULL THEN CAST(floor(greatest((10 - processed) * mean - coalesce(least(CASE WHEN u % 3 <> 0 THEN (u % 60)::DOUBLE END, mean), 0), 0)) AS BIGINT) END AS seconds FROM t"""
)
def t4_job_eta(c: Corpus) -> DataFrame:
    """Each user's events are the files of a job; errors were skipped."""
    name = F.col("user_id").cast("string").alias("job_id")
    timings = c.events.select(name, F.when(F.col("event_type") == "error", "skipped").otherwise("indexed").alias("status"), (F.col("value") * 1000).alias("total_ms"))
    jobs = c.events.groupBy("user_id").agg(F.max(F.col("event_id") % 10).cast("int").alias("processed_files"))
    jobs = jobs.select(name, F.lit(10).alias("total_files"), "processed_files", F.when(F.col("user_id") % 3 != 0, (F.col("user_id") % 60).cast("double")).alias("elapsed"))
    return T.job_eta(jobs, timings)


def _live_progress(c: Corpus) -> DataFrame:
    """The last rows that a stream over the events leaves, run until there is nothing new."""
    path = f"{checkpoint_folder(c.spark)}/progress-{uuid.uuid4().hex}"
    events = c.spark.readStream.schema(c.events.schema).parquet(f"{c.sf_dir}/events.parque[t]")
    rows = job_events(events).withColumn("ts", F.col("ts").cast("timestamp"))
    P.progress_stream(rows).writeStream.outputMode("update").foreachBatch(P.keep_progress(f"{path}/rows")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return P.last_progress(c.spark.read.parquet(f"{path}/rows"))


@query(
    f"""WITH {_NEXT}, d AS (SELECT job_id, stage, CAST(sum(coalesce(floor((epoch_us(next_ts) - epoch_us(ts)) / 1000.0::DOUBLE), 0)) AS BIGINT) AS ms FROM n GROUP BY ALL),
    l AS (SELECT job_id, arg_max(status, (ts, event_id)) AS status, arg_max(stage, (ts, event_id)) AS now_in FROM job_events GROUP BY 1), {_STATE}
    SELECT d.*, s.status, CASE WHEN l.status = 'running' THEN now_in END AS active FROM d JOIN l USING (job_id) JOIN s USING (job_id)""",
    "job_events",
)
def t3_live_progress(c: Corpus) -> DataFrame:
    """Stage times, states and running stages of all jobs, from the stream."""
    rows = _live_progress(c)
    out = P.live_stage_durations(rows).join(P.live_states(rows).select("job_id", "status"), "job_id")
    return out.join(P.live_active_stages(rows).withColumnRenamed("stage", "active"), "job_id", "left")


def _live(c: Corpus) -> DataFrame:
    """The sketches that a stream over the log leaves, run until there is nothing new."""
    path = f"{checkpoint_folder(c.spark)}/queries-{uuid.uuid4().hex}"
    events = c.spark.readStream.schema(c.events.schema).parquet(f"{c.sf_dir}/events.parque[t]")  # a pattern, since a stream takes no single file
    log = query_log(events).withColumn("created_at", F.col("created_at").cast("timestamp"))
    L.query_sketches_stream(log).writeStream.outputMode("update").foreachBatch(L.keep_sketches(f"{path}/sketches")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return L.last_sketches(c.spark.read.parquet(f"{path}/sketches"))


@query("SELECT query, count(*) AS n, round(avg(result_count), 1) AS avg_hits, 0 AS error FROM query_log GROUP BY 1 ORDER BY n DESC, query LIMIT 20", "query_log")
def t9_live_top_queries(c: Corpus) -> DataFrame:
    """The most frequent queries from the stream's sketches, which hold all of them here."""
    return L.live_top_queries(_live(c), 20)


@query(
    """SELECT count(*) AS total, count(*) FILTER (WHERE result_count = 0) AS zero, round(count(*) FILTER (WHERE result_count = 0) / count(*), 4) AS zero_rate,
    CAST(round(avg(latency_ms)) AS BIGINT) AS avg_latency_ms, count(DISTINCT query) AS queries FROM query_log""",
    "query_log",
)
def t9_live_kpis(c: Corpus) -> DataFrame:
    sketches = _live(c)
    return L.live_kpis(sketches).crossJoin(L.live_distinct(sketches))  # a row each
