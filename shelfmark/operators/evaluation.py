"""Evaluation of retrieval and of transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import cer, clean_transcript, simplified_ratio

from .ranking import dedup_ranked, sample

#: Share of stale questions beyond which a set is made anew.
MOST_STALE = 0.3


def make_eval_set(leaves: DataFrame, n: int, seed: int, writer: Column | None = None) -> DataFrame:
    """(query, gold_node_id) from n sampled leaves of more than 80 characters; by default a leaf's first sentence is its question."""
    question = writer if writer is not None else F.regexp_extract("text", r"^\s*([^.!?\n]*[.!?]?)", 1)
    chosen = sample(leaves.where(F.length("text") > 80), n, seed, "node_id")
    return chosen.select(F.trim(question).alias("query"), F.col("node_id").alias("gold_node_id"))


def alive_gold(items: DataFrame, leaves: DataFrame) -> DataFrame:
    return items.join(leaves.select(F.col("node_id").alias("gold_node_id")).distinct(), "gold_node_id", "left_semi")


def prune_stale(items: DataFrame, leaves: DataFrame) -> DataFrame:
    """One row: items, those alive, the stale share, and whether to make a new set (more than MOST_STALE stale, or none alive)."""
    alive = alive_gold(items, leaves).agg(F.count("*").alias("alive"))
    out = items.agg(F.count("*").alias("items")).crossJoin(alive)  # two single rows
    share = F.when(F.col("items") > 0, 1 - F.col("alive") / F.col("items")).otherwise(1.0)
    return out.withColumn("stale", F.round(share, 6)).withColumn("regenerate", (F.col("items") - F.col("alive") > MOST_STALE * F.col("items")) | (F.col("alive") == 0))


def gold_ranks(items: DataFrame, results: DataFrame) -> DataFrame:
    """Rank of each item's gold node in each mode's results; NULL if missing. items: (query_id, gold_node_id); results: (query_id, mode, node_id, rank)."""
    modes = results.select("mode").distinct()
    asked = items.crossJoin(F.broadcast(modes))  # modes are a handful
    hit = results.select("query_id", "mode", F.col("node_id").alias("gold_node_id"), "rank")
    return asked.join(hit, ["query_id", "mode", "gold_node_id"], "left").groupBy("query_id", "mode").agg(F.min("rank").alias("rank"))


def score_modes(ranks: DataFrame, k: int) -> DataFrame:
    """Per mode: recall at k, mean reciprocal rank and nDCG at k for one gold node a query."""
    at = F.when(F.col("rank") <= k, F.col("rank"))
    zero = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 3)
    return ranks.groupBy("mode").agg(F.count("*").alias("n"), zero(F.when(at.isNotNull(), 1.0)).alias("recall"), zero(1.0 / F.col("rank")).alias("mrr"), zero(1.0 / F.log2(at + 1)).alias("ndcg"))


def recall_at_k(retrieved: Column, expected: Column, k: int) -> Column:
    """Share of expected items among the first k; 1 if none is expected."""
    found = F.size(F.filter(expected, lambda e: F.array_contains(F.slice(retrieved, 1, k), e)))
    return F.when(F.size(expected) == 0, 1.0).otherwise(found / F.size(expected))


def mrr(retrieved: Column, expected: Column) -> Column:
    """Reciprocal of the first expected item's place; 0 without one."""
    places = F.filter(F.transform(retrieved, lambda r, i: F.when(F.array_contains(expected, r), i + 1)), lambda p: p.isNotNull())
    return F.coalesce(1.0 / F.array_min(places), F.lit(0.0))


def file_eval(results: DataFrame, qa: DataFrame) -> DataFrame:
    """Per question: recall at 5 and 10 and reciprocal rank over files. results: (query_id, file_id, rank); qa: (query_id, expected ARRAY).

    The mean over all questions, and what changed against a baseline, comes from `summary`.
    """
    ranked = dedup_ranked(results, "query_id", "file_id")
    lists = ranked.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "file_id"))), lambda x: x["file_id"]).alias("files"))
    joined = qa.join(lists, "query_id", "left").withColumn("files", F.coalesce("files", F.array().cast(lists.schema["files"].dataType)))
    return joined.select("query_id", F.round(recall_at_k(F.col("files"), F.col("expected"), 5), 6).alias("recall_5"), F.round(recall_at_k(F.col("files"), F.col("expected"), 10), 6).alias("recall_10"), F.round(mrr(F.col("files"), F.col("expected")), 6).alias("mrr"))


def summary(scores: DataFrame, metrics: list[str], baseline: DataFrame | None = None) -> DataFrame:
    """One row: n, the mean of each metric, and with a baseline (one row of the same metrics, or none) the difference to it, NULL where it lacks the metric."""
    out = scores.agg(F.count("*").alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in metrics])
    if baseline is None:
        return out
    old = baseline.agg(*[(F.first(m) if m in baseline.columns else F.first(F.lit(None).cast("double"))).alias(f"old_{m}") for m in metrics])
    both = out.crossJoin(old)  # two single rows
    return both.select("n", *metrics, *[F.round(F.col(m) - F.col(f"old_{m}"), 6).alias(f"{m}_delta") for m in metrics])


def answer_quality(scores: DataFrame) -> DataFrame:
    return scores.agg(F.round(F.avg("faithfulness"), 3).alias("faithfulness"), F.round(F.avg("relevance"), 3).alias("relevance"), F.greatest(F.count("faithfulness"), F.count("relevance")).alias("n_judged"))


def guard_non_empty(items: DataFrame) -> DataFrame:
    """The items; an empty set is an error before anything is written."""
    if items.isEmpty():
        raise ValueError("the evaluation set is empty")
    return items


def transcript_eval(pairs: DataFrame) -> DataFrame:
    """Per clip: error rate, share of simplified characters and removed noise. pairs: (clip_id, reference, hypothesis)."""
    cleaned = pairs.withColumn("_c", clean_transcript(F.col("hypothesis")))
    return cleaned.select("clip_id", F.round(cer(F.col("reference"), F.col("_c.text")), 6).alias("cer"), F.round(simplified_ratio(F.col("_c.text")), 6).alias("simplified"), F.col("_c.n").alias("noise"))
