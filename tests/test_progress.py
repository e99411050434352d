"""Live progress of jobs: each view equals its batch twin on shuffled, late and repeated events."""

import datetime as dt
import random

from pyspark.sql import functions as F

from shelfmark.streaming import jobs as J
from shelfmark.streaming import progress as P

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "job_id string, ts timestamp, event_id long, status string, stage string, done_files int, total_files int"


def run(spark, folder, batches, **options):
    """The last rows after the batches, each a file of its own, and the number of states that are left."""
    (folder / "in").mkdir()
    stream = P.progress_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "in")), **options)
    query = None
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        if query is None:
            query = stream.writeStream.outputMode("update").foreachBatch(P.keep_progress(str(folder / "out"))).option("checkpointLocation", str(folder / "c")).start()
        query.processAllAvailable()
    kept = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    query.stop()
    return P.last_progress(spark.read.parquet(str(folder / "out"))), kept


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def jobs(seed, n=12, start=0):
    rng, rows = random.Random(seed), []
    for j in range(n):
        t, done = start + rng.randrange(60), 0
        for k in range(rng.randrange(1, 20)):
            status = rng.choices(["pending", "running", "failed", "succeeded", None], [1, 6, 1, 1, 0.3])[0]
            rows.append((f"j{seed}-{j}", at(t + rng.random()), 100 * j + k, status, rng.choice(["parse", "embed", "write", "write", None]), done, 30))
            t, done = t + rng.choice([0, 1, 7, 30]), done + rng.randrange(3)
    return rows


def same(live, batch):
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert rows(live) == rows(batch.select(*live.columns))


def test_views_equal_their_batch_twins_on_shuffled_and_repeated_events(spark, tmp_path):
    rows = jobs(1) + jobs(2)
    random.Random(7).shuffle(rows)
    batches = [rows[k::4] + rows[: 9 * k] for k in range(4)] + [[(None, at(3), 1, "running", "parse", 0, 5), ("x", None, 2, "running", "parse", 0, 5)]]
    found, _ = run(spark, tmp_path, batches)
    table = spark.createDataFrame([*rows, batches[-1][0]], SCHEMA)
    same(P.live_stage_durations(found), J.stage_durations(table))
    same(P.live_stage_eta(found), J.stage_eta(table.select("job_id", "stage", "ts", "event_id", F.col("done_files").alias("done"), F.col("total_files").alias("total"))))
    same(P.live_states(found), J.job_state(table))
    last = table.groupBy("job_id").agg(F.max_by(F.struct("status", "stage"), F.struct("ts", "event_id")).alias("r")).select("job_id", "r.*")
    same(P.live_active_stages(found), J.active_stages(last))


def test_late_events_are_left_out_and_held_ones_keep_their_place(spark, tmp_path):
    job = lambda t, n, stage, name="a": (name, at(t), n, "running", stage, n, 9)
    batches = [[job(0, 1, "parse"), job(100, 3, "write")], [job(60, 2, "embed")], [job(900, 4, "write")], [job(905, 5, "embed")], [job(50, 9, "late"), job(700, 8, "parse")]]
    found, _ = run(spark, tmp_path, batches, late="5 minutes")
    assert {(r.stage, r.ms) for r in P.live_stage_durations(found).collect()} == {("parse", 60_000 + 200_000), ("embed", 40_000), ("write", 600_000 + 5_000)}


def test_states_of_silent_jobs_go_after_a_day(spark, tmp_path):
    event = lambda name, t: (name, at(t), 1, "running", "parse", 0, 9)
    _, kept = run(spark, tmp_path, [[event("a", 0), event("b", 5)], [event("c", 50_000)], [event("d", 120_000)], [event("d", 120_001)]])
    assert kept == 2


def test_folding_in_parts_is_folding_at_once():
    rows = sorted((((r[1] - T0) // dt.timedelta(microseconds=1), *r[2:]) for r in jobs(3, 1)), key=lambda e: e[:2])
    for cut in range(len(rows) + 1):
        assert P.folded(P.folded(P._NEW, rows[:cut]), rows[cut:]) == P.folded(P._NEW, rows)
