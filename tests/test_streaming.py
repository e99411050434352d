import datetime as dt
import itertools

from pyspark.sql import functions as F

from shelfmark.sources import files as A
from shelfmark.sources.chunk_store import read_chunks, write_chunks
from shelfmark.streaming import jobs as J

T0 = dt.datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame([(j, s, T0 + dt.timedelta(seconds=t), i) for i, (j, s, t) in enumerate(rows)], "job_id string, status string, ts timestamp_ntz, event_id long")


def test_first_terminal_status_wins(spark):
    rows = [("a", "running", 0), ("a", "failed", 5), ("a", "succeeded", 9), ("b", "pending", 1), ("b", "running", 2)]
    assert {(r.job_id, r.status) for r in J.job_state(events(spark, rows)).collect()} == {("a", "failed"), ("b", "running")}


def test_watchdog_and_stages(spark):
    rows = [("a", "running", 0), ("a", "running", 601), ("b", "running", 0), ("b", "running", 600)]
    assert [r.job_id for r in J.watchdog(events(spark, rows)).collect()] == ["a"]
    staged = events(spark, [("a", "running", t) for t in (0, 2, 5, 9)]).withColumn("stage", F.element_at(F.array(*[F.lit(x) for x in "xyxz"]), (F.col("event_id") + 1).cast("int")))
    assert {(r.stage, r.ms) for r in J.stage_durations(staged).collect()} == {("x", 6000), ("y", 3000), ("z", 0)}


def _run(spark, tmp_path, stream, name):
    query = stream.writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/c-{name}").start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_stream_of_states_equals_its_batch_twin(spark, tmp_path):
    rows = [(f"j{i % 7}", s, i * 3) for i, s in enumerate(itertools.islice(itertools.cycle(["pending", "running", "running", "running", "succeeded", "failed"]), 60))]
    batch = events(spark, rows).withColumn("ts", F.col("ts").cast("timestamp"))
    for part in range(3):
        batch.where(F.col("event_id") % 3 == part).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    out = _run(spark, tmp_path, J.job_state_stream(stream), "states")
    last = {r.job_id: r.status for r in out.collect()}
    assert last == {r.job_id: r.status for r in J.job_state(batch).collect()}


def test_daily_queries_stream(spark, tmp_path):
    log = spark.createDataFrame([(T0 + dt.timedelta(hours=h), q, n) for h, q, n in ((1, " a ", 0), (2, "  ", 1), (30, "b", 3))], "created_at timestamp, query string, result_count int")
    log.write.parquet(str(tmp_path / "log"))
    out = _run(spark, tmp_path, J.daily_queries_stream(spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))), "daily")
    assert sorted((str(r.day), r.n, r.zero) for r in out.collect()) == [("2024-01-01", 1, 1), ("2024-01-02", 1, 0)]


def test_upsert_sink_and_auto_index(spark, tmp_path):
    states = spark.createDataFrame([], "job_id string, event_id long, ts timestamp, status string")
    write = J.upsert_jobs(states, str(tmp_path / "jobs"))
    for number, status in enumerate(("running", "succeeded")):
        write(spark.createDataFrame([("a", number, T0 + dt.timedelta(seconds=number), status)], states.schema), number)
    assert [(r.job_id, r.status) for r in spark.read.parquet(str(tmp_path / "jobs/v=1")).collect()] == [("a", "succeeded")]
    chunks = spark.createDataFrame([("en", "f", "text")], "folder_id string, file_id string, text string")
    chunks.write.parquet(str(tmp_path / "new"))
    stream = spark.readStream.schema(chunks.schema).parquet(str(tmp_path / "new"))
    for k in range(2):
        J.auto_index(stream, lambda b: write_chunks(b, str(tmp_path / "chunks")), str(tmp_path / f"c{k}")).awaitTermination()
    assert read_chunks(spark, str(tmp_path / "chunks")).count() == 1


def test_chunk_sink_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = spark.createDataFrame([("en", "f", "1"), ("en", "f", "2"), ("de", "g", "3")], "folder_id string, file_id string, text string")
    write_chunks(rows, path)
    write_chunks(rows.where("file_id = 'f'"), path)
    write_chunks(spark.createDataFrame([("en", "h", "4")], rows.schema), path)
    assert sorted(r.text for r in read_chunks(spark, path).collect()) == ["1", "2", "3", "4"]


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"q": "x"}\nbroken\n{"q": "y"}\n')
    assert [r.q for r in A.read_jsonl(spark, str(tmp_path / "a.jsonl"), "q string").collect()] == ["x", "y"]
    (tmp_path / "t.tsv").write_text('path\tsentence\na.mp3\t"Hi" there\n')
    assert [tuple(r) for r in A.read_transcripts(spark, str(tmp_path / "t.tsv")).collect()] == [("a.mp3", '"Hi" there')]
    (tmp_path / "bin").mkdir()
    for name, data in {"u8": "é".encode(), "bom": b"\xef\xbb\xbfx", "u16": "é".encode("utf-16"), "u32": "é".encode("utf-32"), "bad": b"\xff\x00\x81\xfe\x80"}.items():
        (tmp_path / "bin" / name).write_bytes(data)
    rows = {r.file_name: (r.text, r.error) for r in A.decode_text(A.read_binary(spark, str(tmp_path / "bin"))).collect()}
    assert rows == {"u8": ("é", None), "bom": ("x", None), "u16": ("é", None), "u32": ("é", None), "bad": (None, "undecodable")}
    empty = A.decode_text(spark.createDataFrame([(b'',), (None,)], "content binary")).collect()
    assert [(r.text, r.error) for r in empty] == [("", None), (None, None)]


def test_report_and_history(spark, tmp_path):
    run = spark.createDataFrame([(1, 0.5)], "run int, recall double")
    A.write_report(run, str(tmp_path / "r"))
    for _ in range(2):
        A.append_history(run, str(tmp_path / "h"))
    assert spark.read.json(str(tmp_path / "r")).count() == 1 and spark.read.json(str(tmp_path / "h")).count() == 2


def test_a_table_of_jobs_outlives_its_stream(spark, tmp_path):
    states = spark.createDataFrame([], "job_id string, event_id long, ts timestamp, status string")
    path = str(tmp_path / "jobs")
    row = lambda job, n, status: spark.createDataFrame([(job, n, T0 + dt.timedelta(seconds=n), status)], states.schema)
    for _ in range(2):  # written again
        J.upsert_jobs(states, path)(row("a", 0, "running"), 0)
    for number in (1, 2, 3):
        J.upsert_jobs(states, path)(row("b", number, "running"), number)
    assert sorted(A.versions(spark, path)) == [2, 3]
    J.upsert_jobs(states, path)(row("a", 9, "failed"), 0)  # another stream over the same table
    J.upsert_jobs(states, path)(row("c", 9, "running"), 1)
    assert {(r.job_id, r.status) for r in spark.read.parquet(f"{path}/v=1").collect()} == {("a", "failed"), ("b", "running"), ("c", "running")}


def test_silent_jobs_fail_and_ended_ones_are_forgotten(spark, tmp_path):
    schema = "job_id string, status string, ts timestamp, event_id long"
    source = str(tmp_path / "in")
    batches = [[("a", "running", 0, 1), ("b", "succeeded", 0, 2)], [("c", "running", 2000, 3)], [("d", "running", 200_000, 4)], [("e", "running", 1000, 5), ("d", "running", 200_100, 6)], [("f", "running", 300_000, 7)]]
    (tmp_path / "in").mkdir()
    stream = J.job_state_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), "1 second")
    query = None
    for k, rows in enumerate(batches):
        spark.createDataFrame([(j, s, T0 + dt.timedelta(seconds=t), i) for j, s, t, i in rows], schema).coalesce(1).write.mode("append").parquet(source)
        if query is None:
            query = stream.writeStream.outputMode("update").format("memory").queryName("silent").option("checkpointLocation", str(tmp_path / "c")).start()
        query.processAllAvailable()
    kept = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    query.stop()
    seen = {}
    for r in spark.table("silent").collect():
        seen.setdefault(r.job_id, []).append(r.status)
    assert seen["a"][-1] == "failed" and seen["c"][-1] == "failed" and seen["b"] == ["succeeded"]
    assert "e" not in seen or seen["e"][-1] == "failed"  # its events came after the watermark
    assert kept <= 3


def test_stage_and_job_eta(spark):
    rows = [("a", "parse", 0, 1, 0, 100), ("a", "embed", 10, 2, 5, 100), ("a", "embed", 20, 3, 25, 100), ("b", "embed", 0, 4, 1, 9), ("b", "embed", 0, 5, 5, 9), ("c", "embed", 0, 6, 3, 3)]
    progress = spark.createDataFrame([(j, s, T0 + dt.timedelta(seconds=t), i, d, n) for j, s, t, i, d, n in rows], "job_id string, stage string, ts timestamp, event_id long, done int, total int")
    assert {(r.job_id, r.stage, r.seconds) for r in J.stage_eta(progress).collect()} == {("a", "embed", 37), ("b", "embed", None), ("c", "embed", None)}
    jobs = spark.createDataFrame([("a", 10, 4, 1.0), ("b", 3, 3, None), ("c", 5, 0, None), ("d", 2, 1, 99.0)], "job_id string, total_files int, processed_files int, elapsed double")
    timings = spark.createDataFrame([("a", "indexed", 2000), ("a", "skipped", 1), ("a", "failed", 4000), ("b", "indexed", 10), ("d", "indexed", 1500)], "job_id string, status string, total_ms int")
    assert {(r.job_id, r.seconds) for r in J.job_eta(jobs, timings).collect()} == {("a", 17), ("b", 0), ("c", None), ("d", 0)}


def test_new_files_are_indexed_end_to_end(spark, tmp_path):
    schema = "file_id string, folder_id string, file_name string, content_hash string, text string"
    index = spark.createDataFrame([], "file_id string, folder_id string, index_status string, content_hash string, chunk_count int, error string")
    paths = {k: str(tmp_path / k) for k in ("in", "index", "chunks")}

    def run(k):
        J.auto_index_corpus(spark.readStream.schema(schema).parquet(paths["in"]), paths["index"], paths["chunks"], str(tmp_path / f"c{k}"), index).awaitTermination()
        last = max(A.versions(spark, paths["index"]))
        return {(r.file_id, r.index_status, r.content_hash, r.chunk_count) for r in spark.read.parquet(f"{paths['index']}/v={last}").collect()}

    spark.createDataFrame([("f", "en", "f.txt", "h1", "One sentence. Two."), ("g", "en", "g.txt", "h2", " ")], schema).write.mode("append").parquet(paths["in"])
    assert run(0) == {("f", "indexed", "h1", 1), ("g", "failed", None, 0)}
    spark.createDataFrame([("h", "de", "h.txt", "h3", "Drei.")], schema).write.mode("append").parquet(paths["in"])
    assert run(0) == run(1) == {("f", "indexed", "h1", 1), ("g", "failed", None, 0), ("h", "indexed", "h3", 1)}
    assert read_chunks(spark, paths["chunks"]).where("node_role = 'leaf'").count() == 2
