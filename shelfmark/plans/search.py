"""Whole tables of queries answered in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import retrieval as R
from shelfmark.operators.chunking import chunk_corpus
from shelfmark.operators.ranking import read_files, top_k
from shelfmark.sources.durable import Scratch

#: Candidates that are fetched for each one asked for when they are reranked.
OVER_FETCH = 3


def candidates(queries: DataFrame, leaves: DataFrame, k: int, fusion: str = "concat", vectors: bool = True, undefined_first: bool = False) -> DataFrame:
    """(query_id, node_id, score, rank): leaves from both lists, fused by rrf, or the dense list and then what only the keyword list has. Rows with another role than leaf don't count."""
    if "node_role" in leaves.columns:
        leaves = R.only_leaves(leaves)
    sparse = R.bm25_topk(queries, leaves, k)
    if not vectors:
        return sparse
    dense = R.dense_topk(queries, leaves, k, undefined_first)
    return R.rrf([dense, sparse], k) if fusion == "rrf" else R.concat_fuse(dense, sparse, k)


def ordered(found: DataFrame, queries: DataFrame, leaves: DataFrame, k: int, scorer: Callable[[Column, Column], Column] | None) -> DataFrame:
    """Candidates in the order of scorer(query, text), k of them."""
    texts = found.join(leaves.select("node_id", "text"), "node_id").join(queries.select("query_id", "query"), "query_id")
    return R.rerank(texts, (scorer or R.lexical_score)(F.col("query"), F.col("text")), k).drop("text", "query")


def query(queries: DataFrame, leaves: DataFrame, k: int = 10, fusion: str = "rrf", vectors: bool = True, rerank: bool = False, cutoff: float | None = None, scorer: Callable[[Column, Column], Column] | None = None, undefined_first: bool = False) -> DataFrame:
    """(query_id, node_id, score, rank): dense and keyword lists fused by rrf or concat, reranked by `scorer` (shared tokens by default), and cut.

    queries: (query_id, query[, embedding][, folder_id]), leaves: (node_id, text[, embedding][, tokens][, folder_id][, node_role]). The cutoff holds only for concat without reranking.
    undefined_first: the order of cosines with vectors of zeros (`dense_topk`).
    """
    out = candidates(queries, leaves, k * OVER_FETCH if rerank else k, fusion, vectors, undefined_first)
    if rerank:
        return ordered(out, queries, leaves, k, scorer)
    return R.apply_cutoff(out, cutoff) if cutoff is not None and fusion == "concat" else out


def search(queries: DataFrame, leaves: DataFrame, parents: DataFrame, k: int = 10, threshold: float = 0.4, neighbours: int = 5, fusion: str = "concat", vectors: bool | None = None, rerank: bool = False, cutoff: float | None = None) -> DataFrame:
    """Hits of both lists with parents in place of their leaves where enough were hit, and other leaves with their neighbours: (query_id, node_id, role, score, merged, text, rank).

    Hits are fetched and fused, only leaves stay, then they are reranked (three times as many are fetched) or cut by their score; merging and expansion
    follow. vectors: by default where both sides have an embedding.
    """
    vectors = vectors if vectors is not None else "embedding" in queries.columns and "embedding" in leaves.columns
    # few rows a query, written so that nothing before them is done again and Spark sends them to the leaves
    scratch = Scratch(leaves.sparkSession, "hits")
    found = scratch.keep(candidates(queries, leaves, k * OVER_FETCH if rerank else k, fusion, vectors))
    if rerank:
        found = ordered(found, queries, leaves, k, None)
    elif cutoff is not None:
        found = R.apply_cutoff(found, cutoff)
    hits = scratch.keep(found.select("query_id", "node_id", "score").join(leaves.select("node_id", "parent_node_id", "file_id", "chunk_index"), "node_id"))
    merged = scratch.keep(R.auto_merge(hits, parents, threshold))
    whole = merged.where("role = 'parent'").join(parents.select("node_id", "text"), "node_id")
    single = merged.where("role = 'leaf'").join(hits.select("query_id", "node_id", "file_id", "chunk_index"), ["query_id", "node_id"])
    wide = R.neighbor_windows(single.select("query_id", "node_id", "score", "merged", "file_id", "chunk_index"), leaves.select("file_id", "chunk_index", "text"), neighbours)
    wide = wide.select("query_id", "node_id", "score", F.lit("expanded" if neighbours else "leaf").alias("role"), "merged", "text")
    out = whole.select("query_id", "node_id", "score", "role", "merged", "text").unionByName(wide).withColumn("score", F.round("score", 4))
    return top_k(out, k, ["query_id"], F.desc("score"), F.col("node_id"))


def list_files(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files with status, chunks and a guess of their tokens; NULL where there are no chunks."""
    joined = files.select("file_id", "file_name").join(index.select("file_id", "index_status", "chunk_count"), "file_id", "left")
    chunks = F.coalesce("chunk_count", F.lit(0))
    return joined.select("file_id", "file_name", F.coalesce("index_status", F.lit("not_indexed")).alias("status"), chunks.alias("chunks"), F.when(chunks > 0, 200 * chunks).alias("tokens"))


def run_requests(requests: DataFrame, folders: DataFrame, files: DataFrame, index: DataFrame, leaves: DataFrame, parents: DataFrame, k: int = 5, budget: int = 30_000) -> DataFrame:
    """(request_id, mode, results, error) for requests (request_id, owner, folder_id, mode, query).

    Ownership comes first: a folder that is missing and one of another owner look alike. Then each mode is answered in its own plan, from the folder alone; an
    unknown one is an error. leaves: (node_id, file_id, chunk_index, text, n_tokens, parent_node_id).
    """
    leaves = leaves.drop("folder_id").join(files.select("file_id", "folder_id"), "file_id")
    owned = folders.select("folder_id", F.col("user_token").alias("owner"))
    allowed = requests.join(owned, ["folder_id", "owner"], "left_semi")
    error = lambda df, text: df.select("request_id", "mode", F.lit(None).cast("bigint").alias("results"), F.lit(text).alias("error"))
    denied = error(requests.join(allowed.select("request_id"), "request_id", "left_anti"), "folder not found")
    unknown = error(allowed.where(~F.col("mode").isin("search", "list", "read")), "unknown mode")
    size = lambda df: df.groupBy("request_id").agg(F.count("*").alias("results"))
    found = search(allowed.where("mode = 'search'").select(F.col("request_id").alias("query_id"), "query", "folder_id"), leaves, parents, k).select(F.col("query_id").alias("request_id"))
    listed = allowed.where("mode = 'list'").join(files.select("folder_id", "file_id"), "folder_id").select("request_id")
    asked = leaves.join(allowed.where("mode = 'read'").select("folder_id"), "folder_id", "left_semi")
    chosen = read_files(asked, budget, F.col("n_tokens")).select("folder_id")
    read = allowed.where("mode = 'read'").join(chosen, "folder_id").select("request_id")
    counts = size(found.unionByName(listed).unionByName(read))
    answered = allowed.where(F.col("mode").isin("search", "list", "read")).join(counts, "request_id", "left").select("request_id", "mode", F.coalesce("results", F.lit(0)).cast("bigint").alias("results"), F.lit(None).cast("string").alias("error"))
    return answered.unionByName(denied).unionByName(unknown)


def best_documents(documents: DataFrame, benchmark: DataFrame, k: int = 10) -> DataFrame:
    """The k best chunks of the documents for each benchmark passage, with their document: the flagship query."""
    leaves, _ = chunk_corpus(documents.select(F.col("doc_id").cast("string").alias("file_id"), "text"))
    node = F.concat_ws(":", F.col("file_id"), F.lpad(F.col("chunk_index").cast("string"), 9, "0"))  # a leaf's id tells its place
    hits = R.bm25_topk(benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), leaves.select(node.alias("node_id"), "text"), k)
    place = F.split("node_id", ":")
    return hits.select(F.col("query_id").alias("item_id"), place[0].cast("bigint").alias("doc_id"), place[1].cast("int").alias("chunk_index"), "score", "rank")
