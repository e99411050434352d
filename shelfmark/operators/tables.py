"""Filters, lookups, joins and updates over the tables of a document store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import is_safe_name

MOST_BYTES = 100 * 1024 * 1024
PLAIN = ("txt", "csv", "json", "log", "xml", "yaml", "yml")
STRUCTURED = ("pdf", "docx", "pptx", "xlsx", "html", "htm", "md", "epub", "odt")
AUDIO = ("wav", "mp3", "m4a", "aac", "ogg", "flac")


def extension(name: Column) -> Column:
    """What follows the last dot of a file name, in lower case; empty where there is no dot."""
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))


def intake(raw: DataFrame, allowed: tuple[str, ...] = PLAIN + STRUCTURED + AUDIO) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) files of (file_id, file_name, file_size, ...): by size, extension and safe name; rejected ones have a reason."""
    name = F.element_at(F.split("file_name", "/"), -1)
    reason = F.when(F.col("file_size") > MOST_BYTES, "too_large").when(F.coalesce(F.col("file_size"), F.lit(0)) <= 0, "empty").when(~extension(F.col("file_name")).isin(*allowed), "extension").when(~is_safe_name(name), "name")
    judged = raw.withColumn("reason", reason)
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


def route(files: DataFrame) -> DataFrame:
    """files with `route`: plain, structured, audio or fallback."""
    kind = extension(F.col("file_name"))
    return files.withColumn("route", F.when(kind.isin(*PLAIN), "plain").when(kind.isin(*STRUCTURED), "structured").when(kind.isin(*AUDIO), "audio").otherwise("fallback"))


def filter_eq(df: DataFrame, **values: object) -> DataFrame:
    """Rows equal in all given columns; an unknown column is an error."""
    unknown = set(values) - set(df.columns)
    if unknown:
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    return df.where(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in values.items()], F.lit(True)))


def owned_by(df: DataFrame, owner: str) -> DataFrame:
    """Rows of one owner; rows without owner belong to nobody."""
    return df.where(F.col("user_token") == F.lit(owner))


def jobs_for_owner(jobs: DataFrame, folders: DataFrame, owner: Column, status: str | None = None) -> DataFrame:
    """Jobs of the folders that an owner has (a condition over folders), those of one status if it is given."""
    mine = jobs.join(folders.where(owner).select("folder_id"), "folder_id", "left_semi")
    return mine if status is None else mine.where(F.col("status") == status)


def search_files(files: DataFrame, tag: str | None = None, mime: str | None = None, name: str | None = None) -> DataFrame:
    """Files with a tag and a type that contain a term in any case, and with an exact name; a None does not count."""
    out = files
    if tag is not None:
        out = out.where(F.exists("tags", lambda t: F.contains(F.lower(t), F.lit(tag.lower()))))
    if mime is not None:
        out = out.where(F.contains(F.lower("mime_type"), F.lit(mime.lower())))
    return out if name is None else out.where(F.col("file_name") == name)


def search_folders(folders: DataFrame, term: str) -> DataFrame:
    return folders.where(F.contains(F.lower(F.concat_ws(" ", "name", "description")), F.lit(term.lower())))


def validate_queries(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid): a query needs two characters that are not blank at its ends."""
    ok = F.coalesce(F.length(F.trim("query")) >= 2, F.lit(False))
    return queries.where(ok), queries.where(~ok).withColumn("error", F.lit("query too short"))


def resolve_params(queries: DataFrame, top_k: int = 10, cutoff: float = 0.0, sparse_top_k: int = 12) -> DataFrame:
    """Parameters with defaults for NULL; `valid` tells whether they are within bounds."""
    out = queries.withColumns({"top_k": F.coalesce("top_k", F.lit(top_k)), "cutoff": F.coalesce("cutoff", F.lit(cutoff)), "sparse_top_k": F.coalesce("sparse_top_k", F.lit(sparse_top_k))})
    return out.withColumn("valid", F.col("top_k").between(1, 20) & F.col("cutoff").between(0, 1) & F.col("sparse_top_k").between(1, 100))


def files_with_status(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files with the index status, NULL where there is none, and is_indexed."""
    status = index.select("file_id", "index_status", "chunk_count", "indexed_at", "error")
    return files.join(status, "file_id", "left").withColumn("is_indexed", F.coalesce(F.col("index_status") == "indexed", F.lit(False)))


def lookup(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose key is among the ids; repeated and unknown ids make no difference."""
    return df.join(ids.select(ids.columns[0]).toDF(key).distinct(), key, "left_semi")


def indexed_files(index: DataFrame, files: DataFrame) -> DataFrame:
    """Index rows with their file's name, `Unknown` where the file is gone."""
    return index.join(files.select("file_id", "file_name"), "file_id", "left").withColumn("file_name", F.coalesce("file_name", F.lit("Unknown")))


def needs_index(files: DataFrame, index: DataFrame, force: bool = False) -> DataFrame:
    """Files whose content is not indexed already; with force all."""
    if force:
        return files
    done = index.where(F.col("index_status") == "indexed").select("file_id", "content_hash")
    return files.join(done, ["file_id", "content_hash"], "left_anti")


def upsert_index(current: DataFrame, updates: DataFrame) -> DataFrame:
    """The index after updates (file_id, index_status, chunk_count, error and any other columns of an index row).

    Success replaces all fields that the update has and clears the error; failure sets status and error only. All columns of both tables stay.
    """
    a, b = current.alias("a"), updates.alias("b")
    ok, new = F.col("b.index_status") == "indexed", F.col("b.file_id").isNotNull() & F.col("a.file_id").isNull()
    joined = a.join(b, F.col("a.file_id") == F.col("b.file_id"), "full_outer")

    def field(name: str) -> Column:
        old = F.col(f"a.{name}") if name in current.columns else F.lit(None)
        if name == "file_id":
            return F.coalesce("a.file_id", "b.file_id")
        if name == "index_status":
            return F.coalesce("b.index_status", "a.index_status")
        if name == "error":
            return F.when(ok, F.lit(None).cast("string")).when(F.col("b.file_id").isNotNull(), F.col("b.error")).otherwise(old)
        if name not in updates.columns:
            return old
        if name == "chunk_count":
            return F.when(ok, F.col("b.chunk_count")).otherwise(F.coalesce(old, F.lit(0)))
        if name == "folder_id":  # where a file lies is known whatever comes of it
            return F.coalesce("b.folder_id", old)
        return F.when(ok, F.col(f"b.{name}")).when(new, F.lit(None)).otherwise(old)

    names = [*current.columns, *[c for c in updates.columns if c not in current.columns]]
    return joined.select(*[field(c).alias(c) for c in names])


def patch_rows(df: DataFrame, patches: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(patched, unknown): values of the patch that are not NULL replace old ones; patches without a row are given back."""
    fields = [c for c in patches.columns if c != key]
    renamed = patches.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields])
    out = df.join(renamed, key, "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in df.columns])
    return out, patches.join(df.select(key), key, "left_anti")


def delete_folders(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows of the given folders."""
    gone = ids.select(F.col(ids.columns[0]).alias("folder_id")).distinct()
    return {name: df.join(gone, "folder_id", "left_anti") for name, df in tables.items()}


def latest(updates: DataFrame, key: str, at: str) -> DataFrame:
    """The last row of each key by (at, event_id)."""
    rest = [c for c in updates.columns if c != key]
    return updates.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, "event_id")).alias("r")).select(key, "r.*")


def file_status(files: DataFrame, index: DataFrame, jobs: DataFrame) -> DataFrame:
    """Status of each file: indexed, failed, indexing (a running job's current file), queued (in its scope), or not_indexed.

    jobs: (status, current_file_id, scope_file_ids).
    """
    running = jobs.where(F.col("status") == "running")
    current = running.where("current_file_id IS NOT NULL").select(F.col("current_file_id").alias("file_id")).distinct().withColumn("now", F.lit(True))
    queued = running.select(F.explode("scope_file_ids").alias("file_id")).distinct().withColumn("later", F.lit(True))
    joined = files.select("file_id").join(index.select("file_id", "index_status"), "file_id", "left").join(current, "file_id", "left").join(queued, "file_id", "left")
    status = F.when(F.col("index_status").isin("indexed", "failed"), F.col("index_status")).when(F.col("now"), "indexing").when(F.col("later"), "queued").otherwise("not_indexed")
    return joined.select("file_id", status.alias("status"))


def parents_of(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Parents of the hit leaves, once each."""
    return parents.join(hits.select(F.col("parent_node_id").alias("node_id")).distinct(), "node_id", "left_semi")
