"""Readers and sinks for files, transcripts, question sets and chunk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Byte order marks, the longer ones first: UTF-32 begins like UTF-16.
MARKS = [("FFFE0000", "UTF-32"), ("0000FEFF", "UTF-32"), ("EFBBBF", "UTF-8"), ("FFFE", "UTF-16LE"), ("FEFF", "UTF-16BE")]


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder with their content's digest: file_name, file_size, content, content_hash."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("file_size"), "content", F.sha2("content", 256).alias("content_hash"))


def decode_text(files: DataFrame, content: str = "content", encoding: Column | None = None) -> DataFrame:
    """files with `text` and `error`: by byte order mark, else as strict UTF-8, else as the encoding hinted at; a text that none fits is an error."""
    raw = F.col(content)
    head = F.hex(F.substring(raw, 1, 4))
    text = F.lit(None).cast("string")
    for mark, name in reversed(MARKS):
        body = raw.substr(F.lit(len(mark) // 2 + 1), F.greatest(F.octet_length(raw) - len(mark) // 2, F.lit(0)))
        if name == "UTF-8":
            value = F.when(F.is_valid_utf8(body.cast("string")), body.cast("string"))
        else:
            value = F.decode(raw if name == "UTF-32" else body, name)  # the decoder of UTF-32 reads the mark itself
        text = F.when(F.startswith(head, F.lit(mark)), value).otherwise(text)
    marked = F.lit(False)
    for mark, _ in MARKS:
        marked = marked | F.startswith(head, F.lit(mark))
    plain = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    if encoding is not None:
        plain = F.coalesce(plain, F.when(encoding == "latin-1", F.decode(raw, "ISO-8859-1")))
    out = F.when(marked, text).otherwise(plain)
    return files.withColumn("text", out).withColumn("error", F.when(raw.isNotNull() & F.col("text").isNull(), F.lit("undecodable")))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; malformed ones are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """A table of tab-separated (path, sentence) with a header line."""
    return spark.read.option("header", "true").option("sep", "\t").option("quote", "").schema("path string, sentence string").csv(path)


def sample_transcripts(transcripts: DataFrame, clips: DataFrame, n: int, seed: int) -> DataFrame:
    """n transcripts in the order of a seeded hash, with their clips; those without clip fall out after the choice."""
    chosen = transcripts.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "path")), "path").limit(n)
    return chosen.join(clips, "path")


def with_question(entries: DataFrame, column: str = "question") -> DataFrame:
    """Entries that have a question."""
    return entries.where(F.length(F.trim(column)) > 0)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark knows."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions `v=<number>` of a table under path."""
    return [int(n[2:]) for n in listed(spark, path) if n.startswith("v=") and exists(spark, f"{path}/{n}/_SUCCESS")]


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system that Spark knows; none where there is no folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in store.listStatus(folder)] if store.exists(folder) else []


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def delete_file_chunks(chunks: DataFrame, file_ids: DataFrame) -> DataFrame:
    """Chunks without those of the given files."""
    return chunks.join(file_ids.select(F.col(file_ids.columns[0]).alias("file_id")).distinct(), "file_id", "left_anti")


def clear_folder(index: DataFrame, chunks: DataFrame, folder_id: str) -> tuple[DataFrame, DataFrame]:
    """(index, chunks) without a folder; a caller writes the index first, so that a failure leaves no index row without chunks."""
    keep = F.col("folder_id") != folder_id
    return index.where(keep), chunks.where(keep)


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)


def append_history(run: DataFrame, path: str) -> None:
    run.coalesce(1).write.mode("append").json(path)
