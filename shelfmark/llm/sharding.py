"""Sharding: a two-pass external shuffle made of DataFrame operations only.

Pass one scatters the records uniformly into buckets by a seeded hash; the number of buckets follows from the
input's bytes, so that each bucket fits in a task's memory. The scattered records are written to the shared
checkpoint folder. Pass two takes each bucket as one array, shuffles it by Fisher-Yates (Spark's `shuffle` with a
seed) and numbers it after the buckets before it. Dealing the numbers round by round gives shards whose row counts
differ by one at most.

Nothing is grouped by a value of the data: the hash is taken of the row's number, so that a document that occurs
a million times is spread like a million documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Scratch, durable

#: Bytes of records in a bucket on average; as objects of the JVM they take a few times as much.
BUCKET_BYTES = 16 << 20
#: Buckets at least, so that small inputs are spread over all tasks as well.
LEAST_BUCKETS = 1024
#: Buckets whose numbers are summed up in one window; the sums of these groups are summed up again.
GROUP = 4096


def external_shuffle(records: DataFrame, row_bytes: Column | int, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, least_buckets: int = LEAST_BUCKETS, keep: Callable[[DataFrame], DataFrame] = durable) -> DataFrame:
    """All rows of `records` in random order: columns `position` (0, 1, ... without gaps) and `record` (a struct of all columns).

    row_bytes: size of a row, as a column or as a bound for all. keep: writes the scattered records to the shared folder. A position is uniform up to the size of a bucket:
    buckets are in their own order, the rows of each bucket in the order that Fisher-Yates gives.
    An empty table gives an empty one; nulls and repeated rows are ordinary rows.
    """
    if isinstance(row_bytes, int):
        total = records.count() * row_bytes
    else:
        total = records.agg(F.sum(row_bytes)).first()[0] or 0
    buckets = max(least_buckets, -(-total // bucket_bytes))
    numbered = records.select(F.struct("*").alias("record"), F.monotonically_increasing_id().alias("row_no"))
    scattered = keep(numbered.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "row_no"), F.lit(buckets))))
    counts = scattered.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("part", F.floor(F.col("bucket") / GROUP))
    parts = counts.groupBy("part").agg(F.sum("n").alias("part_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_n").over(before), F.lit(0)).alias("part_offset"))
    inside = Window.partitionBy("part").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.join(parts, "part").select("bucket", (F.col("part_offset") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("offset"))
    # by the number alone: records may have columns that have no order
    by_number = lambda a, b: F.when(a["row_no"] < b["row_no"], -1).when(a["row_no"] > b["row_no"], 1).otherwise(0)
    arrays = scattered.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("row_no", "record")), by_number).alias("rows"))
    shuffled = arrays.join(offsets, "bucket").sortWithinPartitions("bucket").withColumn("rows", F.shuffle("rows", F.lit(seed)))
    return shuffled.select("offset", F.posexplode("rows")).select((F.col("offset") + F.col("pos")).alias("position"), F.col("col.record").alias("record"))


def assign_shards(docs: DataFrame, shards: int = 8, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """A shard and a slot in it for each document, by the law `rows`: shards' counts are at most one apart.

    Takes doc_id, text and any other columns. The whole documents are written as shards (`write_shards`) under the shared
    checkpoint folder, where they stay; size, checksum, shard and slot are those of the records read back from there.
    A null text has no bytes: size 1, text_crc32 0. A null or repeated doc_id gets a place as any other.
    """
    path = Scratch(docs.sparkSession, "shards").path
    schema = write_shards(docs, path, shards, seed, bucket_bytes)
    text = F.coalesce(F.col("record.text").cast("string"), F.lit(""))
    return docs.sparkSession.read.schema(schema).parquet(path).select(
        F.col("record.doc_id").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> StructType:
    """Writes whole documents as Parquet, a folder `shard=k` for each shard, with their slot in a column `slot`; returns the schema to read them with.

    A column of docs named slot or shard would clash; it stays inside the struct `record`, as all columns do.
    """
    size = F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))) + 64
    scratch = Scratch(docs.sparkSession)
    placed = external_shuffle(docs, size, seed, bucket_bytes, keep=scratch.keep)
    placed = placed.select("record", F.floor(F.col("position") / shards).cast("long").alias("slot"), (F.col("position") % shards).cast("int").alias("shard"))
    placed.write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(path)
    scratch.clear()
    return placed.schema
