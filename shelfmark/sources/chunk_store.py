"""The table of chunks: leaves and parents of files, replaced file by file in one commit.

Under the table's path lie `data/batch=<name>` with the rows of each batch, and `commits/<number>` with a row (file_id, batch) for each file that the batch replaced; a file without
chunks has no batch. A commit counts once it is complete, so that a reader sees the old state or the new one, whatever was killed in between,
and a batch without commit is never read. What is written follows the batch, not the table. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .files import delete, exists, listed


def _commits(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete commits."""
    return sorted(int(n) for n in listed(spark, f"{path}/commits") if n.isdigit() and exists(spark, f"{path}/commits/{n}/_SUCCESS"))


def _current(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, batch) of each file that has chunks, by its last commit."""
    rows = spark.read.parquet(*[f"{path}/commits/{n}" for n in _commits(spark, path)])
    return rows.groupBy("file_id").agg(F.max_by("batch", "number").alias("batch")).where("batch IS NOT NULL")


def write_batch(chunks: DataFrame, path: str) -> str:
    """Writes rows (file_id, folder_id, ...) beside the table, and returns the batch's name; nobody reads them before `commit`."""
    name = f"b{uuid.uuid4().hex}"
    chunks.withColumn("folder", _folder(F.col("folder_id"))).write.partitionBy("folder").parquet(f"{path}/data/batch={name}")
    return name


def _folder(folder_id: Column) -> Column:
    """What names a folder's part of the data; the letter keeps it a text."""
    return F.concat(F.lit("f"), folder_id.cast("string"))


def read_batch(spark: SparkSession, path: str, name: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/data/batch={name}")


def commit(files: DataFrame, chunks: DataFrame | None, path: str, batch: str | None) -> None:
    """From now on the given files (file_id), and no others, have the chunks of the batch and no older ones, in whatever folder those lie."""
    spark = files.sparkSession
    number = max(_commits(spark, path), default=-1) + 1
    ids = files.select("file_id").where("file_id IS NOT NULL").distinct()
    has = ids.withColumn("batch", F.lit(None).cast("string")) if chunks is None else ids.join(chunks.select("file_id").distinct().withColumn("batch", F.lit(batch)), "file_id", "left")
    has.select("file_id", "batch", F.lit(number).cast("bigint").alias("number")).write.mode("overwrite").parquet(f"{path}/commits/{number}")


def write_chunks(chunks: DataFrame, path: str, files: DataFrame | None = None) -> None:
    """Replaces the chunks of `files` (file_id; by default those that have chunks) by `chunks`, wherever they lay, and leaves others; writing the same twice changes nothing.

    A file without chunks among `files` loses those it had.
    """
    batch = write_batch(chunks, path)
    written = read_batch(chunks.sparkSession, path, batch, chunks.schema)
    commit(written if files is None else files.select("file_id").union(written.select("file_id")), written, path, batch)


def read_chunks(spark: SparkSession, path: str, folder_id: str | None = None) -> DataFrame:
    """The chunks of each file's last commit; with folder_id those of one folder, whose part of the data alone is read. A table without chunks has the columns file_id and folder_id."""
    now = _current(spark, path)
    batches = [r["batch"] for r in now.select("batch").distinct().collect()]  # as many as were written since `compact`
    if not batches:
        return spark.createDataFrame([], "file_id string, folder_id string")
    rows = spark.read.option("mergeSchema", "true").option("basePath", f"{path}/data").parquet(*[f"{path}/data/batch={b}" for b in batches])
    if folder_id is not None:
        rows = rows.where(F.col("folder") == _folder(F.lit(folder_id)))
    return rows.join(now, ["file_id", "batch"]).drop("batch", "folder")


def compact(spark: SparkSession, path: str) -> None:
    """Brings all chunks into one batch, and then deletes what no commit needs."""
    now = _commits(spark, path)
    rows = read_chunks(spark, path)
    batch = write_batch(rows, path)
    written = read_batch(spark, path, batch, rows.schema)
    commit(_current(spark, path), written, path, batch)
    # files without chunks need no row: without one they have none
    for n in now:
        delete(spark, f"{path}/commits/{n}")
    for name in listed(spark, f"{path}/data"):
        if name.startswith("batch=") and name != f"batch={batch}":
            delete(spark, f"{path}/data/{name}")
