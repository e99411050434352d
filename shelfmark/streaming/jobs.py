"""Job state, heartbeats and stage times from a table or stream of job events; each stream has a batch twin."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("succeeded", "partial_success", "failed", "cancelled")
HEARTBEAT_SECONDS = 600
#: The state of a job that has ended is kept so long, to hold later events of it off.
KEPT_SECONDS = 24 * 3600


def job_state(events: DataFrame) -> DataFrame:
    """(job_id, status, ts): the first terminal event of a job wins, later ones don't count; without one the last event counts."""
    order = F.struct("ts", "event_id")
    done = F.col("status").isin(*TERMINAL)
    return events.groupBy("job_id").agg(F.min_by(F.struct("status", "ts"), F.when(done, order)).alias("_end"), F.max_by(F.struct("status", "ts"), order).alias("_last")).select("job_id", F.coalesce("_end", "_last")["status"].alias("status"), F.coalesce("_end", "_last")["ts"].alias("ts"))


def watchdog(events: DataFrame, seconds: int = HEARTBEAT_SECONDS) -> DataFrame:
    """(job_id, ts): jobs that gave no sign for so long while running, and the first time they are given up."""
    w = Window.partitionBy("job_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.lead("ts").over(w).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    silent = events.withColumn("_gap", gap).where((F.col("status") == "running") & (F.col("_gap") > seconds * 1_000_000))
    return silent.groupBy("job_id").agg((F.min("ts") + F.make_dt_interval(secs=F.lit(seconds))).alias("ts"))


def stage_durations(events: DataFrame) -> DataFrame:
    """(job_id, stage, ms): time from each event to the next belongs to the event's stage; runs of a stage add up."""
    w = Window.partitionBy("job_id").orderBy("ts", "event_id")
    ms = F.floor((F.unix_micros(F.lead("ts").over(w).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1000)
    return events.withColumn("_ms", ms).groupBy("job_id", "stage").agg(F.sum(F.coalesce("_ms", F.lit(0))).alias("ms"))


def eta(events: DataFrame) -> DataFrame:
    """(job_id, seconds): time that a job needs yet, by its rate since its first event; NULL without progress or a second gone."""
    order = F.struct("ts", "event_id")
    ends = events.groupBy("job_id").agg(F.min_by(F.struct("ts", "done_files"), order).alias("a"), F.max_by(F.struct("ts", "done_files", "total_files"), order).alias("b"))
    gone = (F.unix_micros(F.col("b.ts").cast("timestamp")) - F.unix_micros(F.col("a.ts").cast("timestamp"))) / 1e6
    progress = F.col("b.done_files") - F.col("a.done_files")
    return ends.select("job_id", F.when((gone >= 1) & (progress > 0), F.round(gone / progress * (F.col("b.total_files") - F.col("b.done_files")), 3)).alias("seconds"))


def stage_eta(progress: DataFrame) -> DataFrame:
    """(job_id, stage, seconds): time that a job's current stage needs yet, by the rate since the stage began; NULL without progress or before a second has gone.

    progress: (job_id, stage, ts, event_id, done, total). A stage begins where the job's stage changes; rates of different stages are not mixed.
    """
    w = Window.partitionBy("job_id").orderBy("ts", "event_id")
    begins = progress.withColumn("_new", F.coalesce(F.lag("stage").over(w) != F.col("stage"), F.lit(True)).cast("int"))
    order = F.struct("ts", "event_id")
    ends = begins.groupBy("job_id").agg(F.max_by(F.struct("stage", "ts", "done", "total"), order).alias("b"), F.max_by(F.struct("ts", "done"), F.when(F.col("_new") == 1, order)).alias("a"))
    gone = (F.unix_micros(F.col("b.ts").cast("timestamp")) - F.unix_micros(F.col("a.ts").cast("timestamp"))) / 1e6
    return ends.select("job_id", "b.stage", left_at_rate(gone, F.col("b.done") - F.col("a.done"), F.col("b.total") - F.col("b.done")).alias("seconds"))


def left_at_rate(gone: Column, made: Column, left: Column) -> Column:
    """Whole seconds that what is left takes yet, at the rate of what was made in the seconds gone; NULL without progress or before a second has gone."""
    return F.when((gone >= 1) & (made > 0), F.floor(F.greatest(left, F.lit(0)) / (made / gone))).cast("bigint")


def job_eta(jobs: DataFrame, timings: DataFrame) -> DataFrame:
    """(job_id, seconds): the mean time of the job's files that were not skipped, times the files left, less what the current file has had (its mean time at most).

    jobs: (job_id, total_files, processed_files, elapsed seconds of the current file or NULL); timings: (job_id, status, total_ms). NULL before a file is done, 0 at the end.
    """
    mean = timings.where((F.col("status") != "skipped") & (F.col("total_ms") > 0)).groupBy("job_id").agg((F.avg("total_ms") / 1000).alias("mean"))
    left = F.greatest(F.col("total_files") - F.col("processed_files"), F.lit(0))
    rest = left * F.col("mean") - F.coalesce(F.least("elapsed", "mean"), F.lit(0.0))
    return jobs.join(mean, "job_id", "left").select("job_id", F.when(F.col("mean").isNotNull(), F.when(left == 0, 0).otherwise(F.floor(F.greatest(rest, F.lit(0.0))))).cast("bigint").alias("seconds"))


def active_stages(states: DataFrame) -> DataFrame:
    return states.where("status = 'running' AND stage IS NOT NULL")


def purge_old(states: DataFrame, now: str, days: int = 30) -> DataFrame:
    """States without terminal ones older than so many days."""
    old = F.col("status").isin(*TERMINAL) & (F.col("ts") < F.to_timestamp_ntz(F.lit(now)) - F.make_dt_interval(days=F.lit(days)))
    return states.where(~old)


def close_orphans(states: DataFrame) -> DataFrame:
    """After a restart, jobs that were active have failed."""
    active = F.col("status").isin("pending", "running")
    return states.withColumns({"error": F.when(active, "server_restart"), "status": F.when(active, "failed").otherwise(F.col("status"))})


_STATE = "status string, ts timestamp, event_id bigint, done boolean"


def _reduce(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    status, ts, event_id, done = state.get if state.exists else (None, None, None, False)
    if state.hasTimedOut:
        if done:
            state.remove()  # long ended
            return
        status, done = "failed", True
    else:
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for row in rows.itertuples():
            if done:
                break
            if ts is None or (row.ts, row.event_id) >= (pd.Timestamp(ts), event_id):
                status, ts, event_id, done = row.status, row.ts, int(row.event_id), row.status in TERMINAL
    at, now = int(pd.Timestamp(ts).timestamp() * 1000), state.getCurrentWatermarkMs()
    if not done and at + HEARTBEAT_SECONDS * 1000 <= now:
        status, done = "failed", True  # its time was over before its last event came
    state.update((status, pd.Timestamp(ts).to_pydatetime(), event_id, done))
    state.setTimeoutTimestamp(max(now + 1, at + (KEPT_SECONDS if done else HEARTBEAT_SECONDS) * 1000))
    yield pd.DataFrame({"job_id": [key[0]], "status": [status], "ts": [pd.Timestamp(ts)]})


def job_state_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A stream of job states by event time: the first terminal status stays, and a job without a sign for HEARTBEAT_SECONDS has failed.
    States of ended jobs go after KEPT_SECONDS.

    events: a stream of (job_id, status, ts TIMESTAMP, event_id).
    """
    watched = events.withWatermark("ts", late)
    return watched.groupBy("job_id").applyInPandasWithState(_reduce, "job_id string, status string, ts timestamp", _STATE, "update", "EventTimeTimeout")


def daily_queries_stream(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of daily counts of a query log (created_at TIMESTAMP, query, result_count): queries are trimmed and cut to 2000 characters, blank ones dropped."""
    rows = capture_queries(log).withWatermark("created_at", late)
    return rows.groupBy(F.window("created_at", "1 day")).agg(F.count("*").alias("n"), F.count_if(F.col("result_count") == 0).alias("zero")).select(F.to_date("window.start").alias("day"), "n", "zero")


def capture_queries(log: DataFrame) -> DataFrame:
    query = F.left(F.trim("query"), F.lit(2000))
    return log.withColumn("query", query).where(F.length("query") > 0)


def upsert_jobs(states: DataFrame, path: str) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch: keeps the latest state of each job in a table under path, where each batch makes a version `v=<number>` from the one before.

    The two last versions stay, so that a batch that is written again starts from the same table. states: the first rows of a new table. A stream that begins
    anew (with batch 0, under a new checkpoint) goes on from the table that is there.
    """
    from shelfmark.operators.tables import latest
    from shelfmark.sources.files import delete, versions

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        there = versions(spark, path)
        before = [v for v in there if v < number]
        if number == 0 and there:  # a new stream over an old table: its last version becomes the one before the first
            last = max(there)
            if last >= 0:
                spark.read.parquet(f"{path}/v={last}").write.mode("overwrite").parquet(f"{path}/v=-1")
                for v in there:
                    if v >= 0:
                        delete(spark, f"{path}/v={v}")
            before = [-1]
        known = spark.read.parquet(f"{path}/v={max(before)}") if before else states
        columns = known.columns
        latest(known.unionByName(batch.select(columns)), "job_id", "ts").select(columns).write.mode("overwrite").parquet(f"{path}/v={number}")
        for v in sorted(before)[:-1]:
            delete(spark, f"{path}/v={v}")

    return write


def auto_index(files: DataFrame, index: Callable[[DataFrame], None], checkpoint: str):
    """Indexes new files as they come: `index` gets each batch and must be idempotent, as write_chunks is."""
    return files.writeStream.foreachBatch(lambda batch, _: index(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def auto_index_corpus(files: DataFrame, index_path: str, chunks_path: str, checkpoint: str, first_index: DataFrame, **options):
    """Indexes new files (file_id, folder_id, content_hash, text, ...) end to end as they come: chunks into the table at chunks_path, their status into versions under index_path.

    first_index: the index before any file. A batch that is written again changes nothing, since what it indexed is unchanged; a version that was killed half-written is written anew. options: those of `index_corpus`.
    """
    from shelfmark.plans.index import index_corpus
    from shelfmark.sources.files import delete, versions

    def write(batch: DataFrame) -> None:
        spark = batch.sparkSession
        there = versions(spark, index_path)
        known = spark.read.parquet(f"{index_path}/v={max(there)}") if there else first_index
        fresh = index_corpus(batch, known, path=chunks_path, **options)["index"]
        fresh.write.mode("overwrite").parquet(f"{index_path}/v={max(there, default=-1) + 1}")
        for v in sorted(there)[:-1]:
            delete(spark, f"{index_path}/v={v}")

    return auto_index(files, write, checkpoint)
