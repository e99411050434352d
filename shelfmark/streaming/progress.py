"""Live stage times, time that is left and running stages of jobs: one row a job from a stream of its events, with batch twins in `jobs.py`.

Events come in any order. A job's state folds those that the watermark has passed, in the order of (ts, event_id), and holds the later ones, so that an event which comes late, but
in time, takes its place among them. Each row tells what all events so far say, the held ones included: it equals the batch twin over the same events. Repeated events
(same ts and event_id) count once. Events older than the watermark are left out, and a job's state goes KEPT_SECONDS after its last event.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import KEPT_SECONDS, TERMINAL, left_at_rate

_POINT = "us bigint, event_id bigint, status string, stage string, done bigint, total bigint"
_NAMES = [x.split()[0] for x in _POINT.split(", ")]
#: first: the job's first event; began: the first of the current stage; last: the last one; ended: the first terminal one.
_FIELDS = ", ".join(f"{name} struct<{_POINT.replace(' ', ':').replace(',:', ',')}>" for name in ("first", "began", "last", "ended")) + ", stages array<struct<stage:string,ms:bigint>>"
#: Groups of jobs that have one state together.
BUCKETS = 4096
_NEW = (None, None, None, None, [])
_US, _ID, _STATUS, _STAGE = range(4)


def folded(state: tuple, events: list[tuple]) -> tuple:
    """(first, began, last, ended, stages) after more events, which are sorted and no older than those before."""
    first, began, last, ended, stages = state
    ms = {s: n for s, n in stages}
    for event in events:
        if last is not None:
            ms[last[_STAGE]] += (event[_US] - last[_US]) // 1000
        if last is None or event[_STAGE] is None or event[_STAGE] != last[_STAGE]:
            began = event
        ms.setdefault(event[_STAGE], 0)
        first, last = first or event, event
        if ended is None and event[_STATUS] in TERMINAL:
            ended = event
    return first, began, last, ended, list(ms.items())


def _turn(known: tuple, held: list, found: list[tuple], now: int) -> tuple[tuple, list, tuple]:
    """A job's folded state, its later events and the state with those, after more events at a watermark in microseconds."""
    events = {(e[_US], e[_ID]): e for e in map(tuple, held)}
    for event in found:
        events.setdefault((event[_US], event[_ID]), event)
    order = lambda e: (e[_US], e[_ID])
    # what was folded before lies behind the watermark of then, so that no event comes before it
    passed = sorted((e for e in events.values() if e[_US] <= now), key=order)
    later = sorted((e for e in events.values() if e[_US] > now), key=order)
    known = folded(known, [e for e in passed if known[2] is None or order(e) > order(known[2])])
    return known, later, folded(known, later)


def _expires(last_us: int) -> int:
    return last_us // 1000 + KEPT_SECONDS * 1000


def _update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """The jobs of one bucket: {job: (folded state, later events, time of the last event)} as packed JSON. A group has a cost of its own, so that one for each job would be what takes time."""
    watermark = state.getCurrentWatermarkMs()
    jobs = {name: rest for name, *rest in json.loads(zlib.decompress(state.get[0]))} if state.exists else {}
    found: dict[str | None, list[tuple]] = {}
    if not state.hasTimedOut:
        for rows in batches:
            for name, event in zip(rows["job_id"].tolist(), rows["event"].tolist(), strict=True):
                found.setdefault(name, []).append(tuple(map(json.loads(event).get, _NAMES)))
    point = lambda e: None if e is None else tuple(e)
    record = lambda e: None if e is None else dict(zip(_NAMES, e, strict=True))
    names, out = [], []
    jobs = {name: job for name, job in jobs.items() if name in found or _expires(job[2]) > watermark}
    for name, events in found.items():
        *first, stages = jobs[name][0] if name in jobs else _NEW
        known = (*map(point, first), [tuple(x) for x in stages])
        known, later, every = _turn(known, jobs[name][1] if name in jobs else [], events, watermark * 1000)
        jobs[name] = (known, later, every[2][_US])
        names.append(name)
        out.append(json.dumps(dict(zip(("first", "began", "last", "ended"), map(record, every[:4]), strict=True)) | {"stages": [{"stage": s, "ms": n} for s, n in every[4]]}))
    if jobs:
        state.update((zlib.compress(json.dumps([(name, *job) for name, job in jobs.items()]).encode(), 1),))
        state.setTimeoutTimestamp(max(min(_expires(job[2]) for job in jobs.values()), watermark + 1))
    elif state.exists:
        state.remove()
    for i in range(0, len(out), 10_000):
        yield pd.DataFrame({"job_id": pd.Series(names[i : i + 10_000], dtype=object), "row": out[i : i + 10_000]})


def progress_stream(events: DataFrame, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """A stream of (job_id, first, began, last, ended, stages): each row takes the place of the one before of its job.

    events: a stream of (job_id STRING, ts TIMESTAMP, event_id, status, stage, done_files, total_files); done_files and total_files are those of the job or of its current stage.
    Events without ts are left out; one job_id may be null, as may all else. late: how long after a newer event an older one is still taken. A job's state has
    its events of that time, one number for each of its stages, and four events. Jobs are dealt by hash into `buckets`, each with one packed state, which is read and written whole
    when any of its jobs has events.
    """
    rows = events.where(F.col("ts").isNotNull()).withWatermark("ts", late)
    event = F.struct(F.unix_micros("ts").alias("us"), F.col("event_id").cast("bigint").alias("event_id"), "status", "stage", F.col("done_files").cast("bigint").alias("done"), F.col("total_files").cast("bigint").alias("total"))
    bucket = F.pmod(F.xxhash64("job_id"), F.lit(buckets)).alias("bucket")
    rows = rows.select("ts", bucket, "job_id", F.to_json(event).alias("event"))
    found = rows.groupBy("bucket").applyInPandasWithState(_update, "job_id string, row string", "state binary", "update", "EventTimeTimeout")
    return found.select("job_id", F.from_json("row", _FIELDS).alias("r")).select("job_id", "r.*")


def keep_progress(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch: each batch's rows in a folder of its own under path; a batch that is written again takes its own place."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def last_progress(written: DataFrame) -> DataFrame:
    """The last row of each job, from what `keep_progress` wrote (read with the column `batch`)."""
    names = [c for c in written.columns if c not in {"job_id", "batch"}]
    return written.groupBy("job_id").agg(F.max_by(F.struct(*names), "batch").alias("r")).select("job_id", "r.*")


def live_stage_durations(progress: DataFrame) -> DataFrame:
    """(job_id, stage, ms), as `stage_durations` has it."""
    return progress.select("job_id", F.inline("stages"))


def live_stage_eta(progress: DataFrame) -> DataFrame:
    """(job_id, stage, seconds), as `stage_eta` has it."""
    gone = (F.col("last.us") - F.col("began.us")) / 1e6
    return progress.select("job_id", "last.stage", left_at_rate(gone, F.col("last.done") - F.col("began.done"), F.col("last.total") - F.col("last.done")).alias("seconds"))


def live_active_stages(progress: DataFrame) -> DataFrame:
    """(job_id, stage) of the jobs whose last event says that they run, as `active_stages` over the last states."""
    return progress.where("last.status = 'running' AND last.stage IS NOT NULL").select("job_id", "last.stage")


def live_states(progress: DataFrame) -> DataFrame:
    """(job_id, status, ts), as `job_state` has it: the first terminal status stays."""
    state = F.coalesce("ended", "last")
    return progress.select("job_id", state["status"].alias("status"), F.timestamp_micros(state["us"]).alias("ts"))
