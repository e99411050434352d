"""The given tables, and the domain tables that stand on them (folders, files, index, jobs, query log)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The time at which reports are made.
NOW = "2024-01-31 00:00:00"


#: Bytes of input for each core below which a table is dealt out anew.
BYTES_PER_CORE = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table of texts over all cores, if it is so small that it may lie in one row group, which Spark can't split; a larger one, and one of a file for each core or more, as it is.

    What is sent is bounded by BYTES_PER_CORE for each core, and large inputs are never sent.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if 0 < size < cores * BYTES_PER_CORE and len(df.inputFiles()) < cores else df


def query_log(events: DataFrame) -> DataFrame:
    """Events, as a table or a stream, as a query log."""
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp_ntz").alias("created_at"),
        F.col("user_id").alias("folder_id"),
        F.concat("event_type", F.lit(" "), (F.col("user_id") % 7).cast("string")).alias("query"),
        F.when(F.col("event_type") == "error", 0).otherwise((F.col("event_id") % 20 + 1).cast("int")).alias("result_count"),
        F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("latency_ms"),
    )


def job_events(events: DataFrame) -> DataFrame:
    """Events, as a table or a stream, as events of indexing jobs."""
    status = F.when(F.col("event_type") == "signup", "pending").when(F.col("event_type") == "purchase", "succeeded").when(F.col("event_type") == "error", "failed").otherwise("running")
    # a user's events of one day are one job
    return events.select(
        "event_id",
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("job_id"),
        F.col("user_id").alias("folder_id"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        status.alias("status"),
        F.element_at(F.array(*[F.lit(x) for x in ("parse", "chunk", "embed", "write")]), (F.col("event_id") % 4 + 1).cast("int")).alias("stage"),
        (F.col("event_id") % 10).cast("int").alias("done_files"),
        F.lit(10).alias("total_files"),
    )


class Corpus:
    """Tables by name: those in the folder as they are, the others derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread(df) if name in {"documents", "pages"} else df

    def __getattr__(self, name: str) -> DataFrame:
        if name in {"region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"}:
            return self.table(name)
        raise AttributeError(name)

    @cached_property
    def files(self) -> DataFrame:
        d = self.documents
        return d.select(
            F.col("lang").alias("folder_id"),
            F.col("doc_id").cast("string").alias("file_id"),
            F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.element_at(F.array(*[F.lit(x) for x in (".txt", ".md", ".html", ".pdf", ".mp3")]), (F.col("doc_id") % 5 + 1).cast("int"))).alias("file_name"),
            F.col("n_chars").alias("file_size"),
            F.sha2("text", 256).alias("content_hash"),
            F.array("source", "lang").alias("tags"),
            F.element_at(F.array(*[F.lit(x) for x in ("text/plain", "text/markdown", "text/html", "application/pdf", "audio/mpeg")]), (F.col("doc_id") % 5 + 1).cast("int")).alias("mime_type"),
            (F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(mins=F.col("doc_id").cast("int"))).alias("uploaded_at"),
            "text",
        )

    @cached_property
    def file_index(self) -> DataFrame:
        """Status of the labelled files: quality 1 is indexed, 0 failed; toxic 1 has an old hash."""
        rows = self.labels.join(self.documents.select("doc_id", "text", "lang"), "doc_id")
        return rows.select(
            F.col("lang").alias("folder_id"),
            F.col("doc_id").cast("string").alias("file_id"),
            F.when(F.col("quality") == 1, "indexed").otherwise("failed").alias("index_status"),
            F.when(F.col("toxic") == 0, F.sha2("text", 256)).otherwise("old").alias("content_hash"),
            (F.col("doc_id") % 50 + 1).cast("int").alias("chunk_count"),
            F.when(F.col("toxic") == 0, "model-a").otherwise("model-b").alias("embedding_model"),
            F.when(F.col("quality") == 0, F.repeat(F.lit("parse error; "), (F.col("doc_id") % 40).cast("int"))).alias("error"),
            (F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(hours=(F.col("doc_id") % 720).cast("int"))).alias("indexed_at"),
        )

    @cached_property
    def folders(self) -> DataFrame:
        d = self.documents.groupBy("lang").agg(F.count("*").alias("file_count"), F.sum("n_chars").alias("total_size"))
        return d.select(
            F.col("lang").alias("folder_id"),
            F.concat(F.lit("Folder "), F.upper("lang")).alias("name"),
            F.concat(F.lit("texts in "), F.col("lang")).alias("description"),
            F.when(F.col("lang") == "es", F.lit(None).cast("string")).otherwise(F.concat(F.lit("owner-"), F.substring("lang", 1, 1))).alias("user_token"),
            "file_count",
            "total_size",
        )

    @cached_property
    def query_log(self) -> DataFrame:
        return query_log(self.events)

    @cached_property
    def job_events(self) -> DataFrame:
        return job_events(self.events)


#: The same tables as SQL, each a common table expression by name.
SQL = {
    "files": """files AS (SELECT lang AS folder_id, CAST(doc_id AS VARCHAR) AS file_id,
      source || '/' || CAST(doc_id AS VARCHAR) || ['.txt', '.md', '.html', '.pdf', '.mp3'][CAST(doc_id % 5 + 1 AS INT)] AS file_name,
      n_chars AS file_size, sha256(text) AS content_hash, [source, lang] AS tags,
      ['text/plain', 'text/markdown', 'text/html', 'application/pdf', 'audio/mpeg'][CAST(doc_id % 5 + 1 AS INT)] AS mime_type,
      TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id AS INT)) AS uploaded_at, text FROM documents)""",
    "file_index": """file_index AS (SELECT lang AS folder_id, CAST(l.doc_id AS VARCHAR) AS file_id,
      CASE WHEN quality = 1 THEN 'indexed' ELSE 'failed' END AS index_status,
      CASE WHEN toxic = 0 THEN sha256(text) ELSE 'old' END AS content_hash, CAST(l.doc_id % 50 + 1 AS INT) AS chunk_count,
      CASE WHEN toxic = 0 THEN 'model-a' ELSE 'model-b' END AS embedding_model,
      CASE WHEN quality = 0 THEN repeat('parse error; ', CAST(l.doc_id % 40 AS INT)) END AS error,
      TIMESTAMP '2024-01-01' + to_hours(CAST(l.doc_id % 720 AS INT)) AS indexed_at
      FROM labels l JOIN documents d USING (doc_id))""",
    "folders": """folders AS (SELECT lang AS folder_id, 'Folder ' || upper(lang) AS name, 'texts in ' || lang AS description,
      CASE WHEN lang = 'es' THEN NULL ELSE 'owner-' || substr(lang, 1, 1) END AS user_token,
      count(*) AS file_count, CAST(sum(n_chars) AS BIGINT) AS total_size FROM documents GROUP BY lang)""",
    "query_log": """query_log AS (SELECT event_id, ts AS created_at, user_id AS folder_id, event_type || ' ' || CAST(user_id % 7 AS VARCHAR) AS query,
      CASE WHEN event_type = 'error' THEN 0 ELSE CAST(event_id % 20 + 1 AS INT) END AS result_count,
      CASE WHEN event_id % 11 <> 0 THEN value END AS latency_ms FROM events)""",
    "job_events": """job_events AS (SELECT event_id, CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS job_id, user_id AS folder_id, ts,
      CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'running' END AS status,
      ['parse', 'chunk', 'embed', 'write'][CAST(event_id % 4 + 1 AS INT)] AS stage, CAST(event_id % 10 AS INT) AS done_files, 10 AS total_files FROM events)""",
}


def sql(text: str, *names: str, recursive: bool = False) -> str:
    """A statement over the domain tables of the given names."""
    body = text.strip()
    ctes = ", ".join(SQL[n] for n in names)
    more = body.startswith("WITH ")
    if not ctes:
        return body
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}" + (", " + body[5:] if more else " " + body)
