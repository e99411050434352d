"""Statistics over folders, files, index, jobs and the query log; each a group-by, never a driver-side loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ("pending", "running", "succeeded", "partial_success", "failed", "cancelled")


def overview(folders: DataFrame, files: DataFrame, index: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row of totals; unindexed files are those beyond the index rows."""
    a = folders.agg(F.count("*").alias("folders"))
    b = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"))
    c = index.agg(F.count_if(F.col("index_status") == "indexed").alias("indexed"), F.count_if(F.col("index_status") == "failed").alias("failed"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"), F.count("*").alias("rows"))
    d = jobs.agg(F.count("*").alias("jobs"))
    return a.crossJoin(b).crossJoin(c).crossJoin(d).withColumn("unindexed", F.greatest(F.col("files") - F.col("rows"), F.lit(0))).drop("rows")


def folder_stats(folders: DataFrame, index: DataFrame) -> DataFrame:
    per = index.groupBy("folder_id").agg(F.count_if(F.col("index_status") == "indexed").alias("indexed"), F.count_if(F.col("index_status") == "failed").alias("failed"), F.sum("chunk_count").alias("chunks"), F.max("indexed_at").alias("last_indexed"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("indexed", "failed", "chunks")}
    return folders.join(per, "folder_id", "left").withColumns(zero)


def index_summary(files: DataFrame, index: DataFrame) -> DataFrame:
    """Per folder: files in all, indexed, failed, and pending, which have no index row."""
    joined = files.select("folder_id", "file_id").join(index.select("file_id", "index_status"), "file_id", "left")
    return joined.groupBy("folder_id").agg(F.count("*").alias("total"), F.count_if(F.col("index_status") == "indexed").alias("indexed"), F.count_if(F.col("index_status") == "failed").alias("failed"), F.count_if(F.col("index_status").isNull()).alias("pending"))


def count_by_status(jobs: DataFrame, statuses: tuple[str, ...] = STATUSES) -> DataFrame:
    """Jobs of every known status, 0 where there are none."""
    known = jobs.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    return known.join(jobs.groupBy("status").agg(F.count("*").alias("n")), "status", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _since(log: DataFrame, at: str, now: str, days: int) -> DataFrame:
    return log.where(F.col(at) >= F.to_timestamp_ntz(F.lit(now)) - F.make_dt_interval(days=F.lit(days)))


def query_kpis(log: DataFrame, now: str, days: int, folder: object = None) -> DataFrame:
    """One row: queries, those without result, their rate, the average latency of those that have one. Without queries all are 0."""
    rows = _since(log, "created_at", now, days)
    rows = rows if folder is None else rows.where(F.col("folder_id") == F.lit(folder))
    out = rows.agg(F.count("*").alias("total"), F.count_if(F.col("result_count") == 0).alias("zero"), F.avg("latency_ms").alias("latency"))
    rate = F.when(F.col("total") > 0, F.round(F.col("zero") / F.col("total"), 4)).otherwise(0.0)
    return out.select("total", "zero", rate.alias("zero_rate"), F.coalesce(F.round("latency"), F.lit(0)).cast("long").alias("avg_latency_ms"))


def top_queries(log: DataFrame, k: int) -> DataFrame:
    """The k most frequent queries with their average hits; ties by text."""
    return log.groupBy("query").agg(F.count("*").alias("n"), F.round(F.avg("result_count"), 1).alias("avg_hits")).orderBy(F.desc("n"), "query").limit(k)


def zero_queries(log: DataFrame, k: int) -> DataFrame:
    """The k most frequent queries among those that found nothing."""
    return log.where("result_count = 0").groupBy("query").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query").limit(k)


def queries_by_day(log: DataFrame) -> DataFrame:
    return log.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("result_count") == 0).alias("zero"))


def index_trend(index: DataFrame, now: str, days: int) -> DataFrame:
    """Files indexed on each of the last days, days without any included; the first day is cut at the time of now."""
    spine = index.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(now)) - days, F.to_date(F.lit(now)), F.expr("interval 1 day"))).alias("day"))
    done = _since(index.where("index_status = 'indexed'"), "indexed_at", now, days).groupBy(F.to_date("indexed_at").alias("day")).agg(F.count("*").alias("n"))
    return spine.join(done, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def embedding_models(index: DataFrame) -> DataFrame:
    return index.where("index_status = 'indexed'").select("folder_id", "embedding_model").distinct()


def model_conflicts(index: DataFrame, model: str) -> DataFrame:
    """Folders that have vectors of another model."""
    return embedding_models(index).where(F.col("embedding_model") != model).groupBy("folder_id").agg(F.count("*").alias("others"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def refresh_folder_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("folder_id").agg(F.count("*").alias("file_count"), F.sum("file_size").alias("total_size"))


def job_outcome(results: DataFrame) -> DataFrame:
    """Per job: results by kind, bytes of successes, and the job's status. results: (job_id, result, file_size)."""
    out = results.groupBy("job_id").agg(*[F.count_if(F.col("result") == r).alias(r) for r in ("success", "failed", "skipped")], F.count("*").alias("total"), F.sum(F.when(F.col("result") == "success", F.col("file_size")).otherwise(0)).alias("bytes"))
    return out.withColumn("status", F.when((F.col("failed") > 0) & (F.col("success") == 0), "failed").when(F.col("failed") > 0, "partial_success").otherwise("succeeded"))


def dim_audit(chunks: DataFrame, expected: int, key: str) -> DataFrame:
    """Vectors whose length is not as expected, by key and length."""
    return chunks.groupBy(key, F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).where(F.col("dim") != expected)


def result_profile(results: DataFrame) -> DataFrame:
    """Per query: results by role, files, and the range of scores. results: (query_id, file_id, role, score, merged)."""
    return results.groupBy("query_id").agg(
        F.count("*").alias("results"), F.count_if(F.col("role") == "parent").alias("parents"), F.count_if(F.col("role") == "expanded").alias("expanded"), F.count_distinct("file_id").alias("files"),
        F.min("score").alias("least"), F.max("score").alias("most"), F.avg("score").alias("mean"), F.sum("merged").alias("merged_leaves"),
    )


def files_by_hits(results: DataFrame) -> DataFrame:
    """Files of each query by hits; ties by their first appearance. results: (query_id, file_id, rank)."""
    return results.groupBy("query_id", "file_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first_rank"))


def slowest_files(jobs: DataFrame, n: int) -> DataFrame:
    """The n files that took longest, from jobs' file_timings ARRAY<STRUCT<file_id, seconds>>."""
    return jobs.select("job_id", F.inline("file_timings")).orderBy(F.desc("seconds"), "job_id", "file_id").limit(n)


def job_progress(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("percent", F.when(F.col("total_files") > 0, F.round(100 * F.col("done_files") / F.col("total_files")).cast("int")).otherwise(0))


def folder_panel(files: DataFrame) -> DataFrame:
    """Per folder: chunks, indexed and failed files, and models. files: as files_with_status, with embedding_model."""
    return files.groupBy("folder_id").agg(F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"), F.count_if("is_indexed").alias("indexed"), F.count_if(F.col("index_status") == "failed").alias("failed"), F.array_join(F.array_sort(F.collect_set("embedding_model")), ",").alias("models"))
