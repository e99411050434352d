"""Top-k, running budgets, ordered deduplication and samples; all orders are total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, k: int | Column, group: list[str], *order: Column) -> DataFrame:
    """The first k rows of each group, with `rank`. Spark keeps k rows of each partition before it sends them."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def chunks_of_file(leaves: DataFrame, file_id: str, limit: int) -> DataFrame:
    return leaves.where(F.col("file_id") == file_id).orderBy(F.asc_nulls_last("chunk_index"), "node_id").limit(limit)


def read_files(leaves: DataFrame, budget: int, tokens: Column, file: str = "file_id", index: str = "chunk_index") -> DataFrame:
    """Chunks of each file in order until the next would exceed the budget of tokens; `truncated` where some are left."""
    order = Window.partitionBy(file).orderBy(index)
    running = leaves.withColumn("_tokens", tokens).withColumn("running", F.sum("_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = running.withColumn("truncated", F.max("running").over(Window.partitionBy(file)) > budget)
    return whole.where(F.col("running") <= budget).drop("_tokens")


def dedup_ranked(df: DataFrame, group: str, key: str) -> DataFrame:
    """Each key at its first rank in the group, ranked anew."""
    first = df.groupBy(group, key).agg(F.min("rank").alias("first_rank"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("first_rank", key)))


def rank_by_best(df: DataFrame, group: str, key: str, *order: Column) -> DataFrame:
    """(group, key, rank): the keys of each group in the order of their best row. Rows become one for each key before any is sent, so that large groups don't meet in a task."""
    best = df.groupBy(group, key).agg(F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("best"))
    return best.select(group, key, F.row_number().over(Window.partitionBy(group).orderBy("best", key)).alias("rank"))


def dedup_leaves(leaves: DataFrame, file: str = "file_id", at: str = "chunk_index", text: str = "text") -> DataFrame:
    """The first of each file's chunks with the same trimmed text; only hashes are sorted."""
    key = F.xxhash64(F.trim(text))
    return leaves.withColumn("_n", F.row_number().over(Window.partitionBy(file, key, F.length(F.trim(text))).orderBy(at))).where("_n = 1").drop("_n")


def run_deltas(runs: DataFrame, metric: str) -> DataFrame:
    """Each run's metric against the run before in the same mode."""
    w = Window.partitionBy("slug", "mode").orderBy("generated_at")
    return runs.withColumn("previous", F.lag(metric).over(w)).withColumn("delta", F.col(metric) - F.col("previous"))


def best_mode(runs: DataFrame, metric: str) -> DataFrame:
    """The best mode of each run; ties by name."""
    return runs.groupBy("slug", "generated_at").agg(F.max_by("mode", F.struct(F.col(metric), F.col("mode"))).alias("best_mode"), F.max(metric).alias("best"))


def sample(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows in the order of a seeded hash of their key: the same for the same rows."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)
