"""Statistics of folders, files, index, jobs and the query log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import ranking as R
from shelfmark.operators import stats as S
from shelfmark.operators import tables as T
from shelfmark.sources.corpus import NOW, Corpus

from .registry import query


@query(
    """SELECT (SELECT count(*) FROM folders) AS folders, (SELECT count(*) FROM files) AS files, (SELECT CAST(sum(file_size) AS BIGINT) FROM files) AS bytes, (SELECT count(*) FROM file_index WHERE index_status = 'indexed') AS indexed,
    (SELECT count(*) FROM file_index WHERE index_status = 'failed') AS failed, (SELECT CAST(sum(chunk_count) AS BIGINT) FROM file_index) AS chunks, (SELECT count(*) FROM job_events) AS jobs, (SELECT count(*) FROM files) - (SELECT count(*) FROM file_index) AS unindexed""",
    "folders", "files", "file_index", "job_events",
)
def f1_overview(c: Corpus) -> DataFrame:
    return S.overview(c.folders, c.files, c.file_index, c.job_events)


@query("SELECT f.folder_id, count(*) AS total, count(*) FILTER (WHERE index_status = 'indexed') AS indexed, count(*) FILTER (WHERE index_status = 'failed') AS failed, count(*) FILTER (WHERE index_status IS NULL) AS pending FROM files f LEFT JOIN file_index i USING (file_id) GROUP BY 1", "files", "file_index")
def f3_index_summary(c: Corpus) -> DataFrame:
    return S.index_summary(c.files, c.file_index)


@query("SELECT s.status, count(j.status) AS n FROM (SELECT unnest(['pending', 'running', 'succeeded', 'partial_success', 'failed', 'cancelled']) AS status) s LEFT JOIN job_events j USING (status) GROUP BY 1", "job_events")
def f4_count_by_status(c: Corpus) -> DataFrame:
    return S.count_by_status(c.job_events)


_SINCE = "created_at >= TIMESTAMP '2024-01-31' - INTERVAL {} DAY"


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE result_count = 0) AS zero, round(count(*) FILTER (WHERE result_count = 0) / count(*)::DOUBLE, 4) AS zero_rate, CAST(round(avg(latency_ms)) AS BIGINT) AS avg_latency_ms FROM query_log WHERE {_SINCE.format(7)}", "query_log")
def f5_query_kpis(c: Corpus) -> DataFrame:
    return S.query_kpis(c.query_log, NOW, 7)


@query("SELECT 0 AS total, 0 AS zero, 0.0::DOUBLE AS zero_rate, 0 AS avg_latency_ms")
def f5_query_kpis_empty(c: Corpus) -> DataFrame:
    """A folder that nobody asked: all zero."""
    return S.query_kpis(c.query_log, NOW, 7, folder=-1)


@query("SELECT query, count(*) AS n, round(avg(result_count), 1) AS avg_hits FROM query_log GROUP BY query ORDER BY n DESC, query LIMIT 10", "query_log")
def f6_top_queries(c: Corpus) -> DataFrame:
    return S.top_queries(c.query_log, 10)


@query("SELECT query, count(*) AS n FROM query_log WHERE result_count = 0 GROUP BY query ORDER BY n DESC, query LIMIT 5", "query_log")
def f7_zero_queries(c: Corpus) -> DataFrame:
    return S.zero_queries(c.query_log, 5)


@query("SELECT CAST(created_at AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE result_count = 0) AS zero FROM query_log GROUP BY 1", "query_log")
def f8_queries_by_day(c: Corpus) -> DataFrame:
    return S.queries_by_day(c.query_log)


@query("""SELECT day, count(i.indexed_at) AS n FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-17', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day) s
    LEFT JOIN file_index i ON CAST(i.indexed_at AS DATE) = day AND index_status = 'indexed' AND i.indexed_at >= TIMESTAMP '2024-01-17' GROUP BY 1""", "file_index")  # fmt: skip
def f9_index_trend(c: Corpus) -> DataFrame:
    return S.index_trend(c.file_index, NOW, 14)


@query("SELECT DISTINCT folder_id, embedding_model FROM file_index WHERE index_status = 'indexed'", "file_index")
def f10_embedding_models(c: Corpus) -> DataFrame:
    return S.embedding_models(c.file_index)


@query("SELECT folder_id, count(DISTINCT embedding_model) AS others FROM file_index WHERE index_status = 'indexed' AND embedding_model <> 'model-a' GROUP BY 1", "file_index")
def f10_model_conflicts(c: Corpus) -> DataFrame:
    return S.model_conflicts(c.file_index, "model-a")


@query("SELECT 'documents' AS table_name, count(*) AS n FROM documents UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events")
def f11_table_counts(c: Corpus) -> DataFrame:
    return S.table_counts({"documents": c.documents, "lineitem": c.lineitem, "events": c.events})


@query("SELECT folder_id, count(*) AS file_count, CAST(sum(file_size) AS BIGINT) AS total_size FROM files GROUP BY 1", "files")
def f12_refresh_folder_stats(c: Corpus) -> DataFrame:
    return S.refresh_folder_stats(c.files)


@query(
    """WITH r AS (SELECT l_orderkey AS job_id, CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_returnflag = 'A' THEN 'skipped' ELSE 'success' END AS result, CAST(l_quantity AS BIGINT) AS file_size FROM lineitem),
    a AS (SELECT job_id, count(*) FILTER (WHERE result = 'success') AS success, count(*) FILTER (WHERE result = 'failed') AS failed, count(*) FILTER (WHERE result = 'skipped') AS skipped, count(*) AS total, CAST(sum(CASE WHEN result = 'success' THEN file_size ELSE 0 END) AS BIGINT) AS bytes FROM r GROUP BY 1)
    SELECT *, CASE WHEN failed > 0 AND success = 0 THEN 'failed' WHEN failed > 0 THEN 'partial_success' ELSE 'succeeded' END AS status FROM a"""
)
def f13_job_outcome(c: Corpus) -> DataFrame:
    result = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "skipped").otherwise("success")
    return S.job_outcome(c.lineitem.select(F.col("l_orderkey").alias("job_id"), result.alias("result"), F.col("l_quantity").cast("bigint").alias("file_size")))


@query("SELECT label, 32 AS dim, count(*) AS n FROM embeddings WHERE vec_id % 7 = 0 GROUP BY label")
def f14_dim_audit(c: Corpus) -> DataFrame:
    some = c.embeddings.withColumn("embedding", F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")))
    return S.dim_audit(some, 64, "label")


@query(
    """SELECT l_orderkey AS query_id, count(*) AS results, count(*) FILTER (WHERE l_returnflag = 'A') AS parents, count(*) FILTER (WHERE l_returnflag = 'R') AS expanded, count(DISTINCT l_partkey) AS files,
    min(l_discount) AS least, max(l_discount) AS most, round(avg(l_discount), 6) AS mean, CAST(sum(l_linenumber) AS BIGINT) AS merged_leaves FROM lineitem GROUP BY 1"""
)
def f15_result_profile(c: Corpus) -> DataFrame:
    role = F.when(F.col("l_returnflag") == "A", "parent").when(F.col("l_returnflag") == "R", "expanded").otherwise("leaf")
    rows = c.lineitem.select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("file_id"), role.alias("role"), F.col("l_discount").alias("score"), F.col("l_linenumber").cast("bigint").alias("merged"))
    return S.result_profile(rows).withColumn("mean", F.round("mean", 6))


@query("SELECT l_suppkey AS query_id, l_partkey AS file_id, count(*) AS hits, min(l_linenumber) AS first_rank FROM lineitem GROUP BY ALL")
def f16_files_by_hits(c: Corpus) -> DataFrame:
    return S.files_by_hits(c.lineitem.select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("file_id"), F.col("l_linenumber").alias("rank")))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS job_id, l_partkey AS file_id, l_extendedprice AS seconds FROM lineitem ORDER BY l_extendedprice DESC, job_id, file_id LIMIT 15")
def f17_slowest_files(c: Corpus) -> DataFrame:
    jobs = c.lineitem.groupBy(F.col("l_orderkey").cast("string").alias("job_id")).agg(F.collect_list(F.struct(F.col("l_partkey").alias("file_id"), F.col("l_extendedprice").alias("seconds"))).alias("file_timings"))
    return S.slowest_files(jobs, 15)


@query("SELECT event_id, CAST(round(100 * done_files / 10.0) AS INT) AS percent FROM job_events", "job_events")
def f19_job_progress(c: Corpus) -> DataFrame:
    return S.job_progress(c.job_events).select("event_id", "percent")


@query(
    """SELECT f.folder_id, CAST(coalesce(sum(chunk_count), 0) AS BIGINT) AS chunks, count(*) FILTER (WHERE index_status = 'indexed') AS indexed, count(*) FILTER (WHERE index_status = 'failed') AS failed,
    coalesce(string_agg(DISTINCT embedding_model, ',' ORDER BY embedding_model), '') AS models FROM files f LEFT JOIN file_index i USING (file_id) GROUP BY 1""",
    "files", "file_index",
)
def f20_folder_panel(c: Corpus) -> DataFrame:
    return S.folder_panel(T.files_with_status(c.files, c.file_index).join(c.file_index.select("file_id", "embedding_model"), "file_id", "left"))


@query("SELECT slug, mode, generated_at, recall, round(recall - lag(recall) OVER (PARTITION BY slug, mode ORDER BY generated_at), 6) AS delta FROM (SELECT event_type AS slug, CASE WHEN user_id % 2 = 0 THEN 'rrf' ELSE 'dense' END AS mode, CAST(ts AS DATE) AS generated_at, round(max(value), 3) AS recall FROM events GROUP BY ALL)")
def w6_run_deltas(c: Corpus) -> DataFrame:
    runs = c.events.groupBy(F.col("event_type").alias("slug"), F.when(F.col("user_id") % 2 == 0, "rrf").otherwise("dense").alias("mode"), F.to_date("ts").alias("generated_at")).agg(F.round(F.max("value"), 3).alias("recall"))
    return R.run_deltas(runs, "recall").select("slug", "mode", "generated_at", "recall", F.round("delta", 6).alias("delta"))
