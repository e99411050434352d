"""An inverted index for keyword ranking, written once, with the greatest impact of each block of leaves.

Leaves are taken as they lie, SLICE of them at a time; a task turns a slice into rows of one term each: the leaves that have it, the impact of each (the part of its
Okapi BM25 score that does not depend on the query), and the greatest impact in each block of BLOCK leaves. Inside a slice, leaves that look alike lie
together, so that a block's greatest impacts are close to those of its leaves. No shuffle is needed.

A table of queries is answered in two rounds. The first scores the leaves with a query's rarest terms, which gives a score that the k-th best leaf reaches at least.
The second goes to the slices, inside them to the blocks, and in those to the leaves that can still reach it: terms whose greatest scores together don't are not
looked up for new leaves (MaxScore), and a slice or block whose greatest scores together don't is left out (block-max). Nothing that could be among the k best, ties
included, is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.functions.text import or_query, tokenize
from shelfmark.sources.durable import Scratch

from .ranking import top_k

#: Leaves of a slice and of a block; tokens of a slice (a longer leaf is a slice of its own).
SLICE, BLOCK, SLICE_TOKENS = 16384, 8, 1 << 19
#: Queries that a task holds against a slice.
QUERIES = 2048
#: The first round scores leaves with a query's rarest terms, until these have so many leaves for each one asked for.
SEEDS = 4
#: Bits that tell which terms an index for given queries needs: 128 KB, however many terms they have.
_BITS = 1 << 20
#: Scores are rounded to nine places; a bound that misses by less does not rule out.
_SLACK = 1e-8


@dataclass(frozen=True)
class KeywordIndex:
    """Where an index lies. postings: (slice, term, n, best, leaf, impact, block, block_best, nodes), where the row without term has the slice's nodes; scopes: (scope, docs, mean)."""

    spark: SparkSession
    path: str
    scoped: bool
    block: int = BLOCK

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    @property
    def scopes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/scopes")


def _term(term: Column, scope: Column) -> Column:
    """A term of a folder as a number; the same word in another folder is another term, with statistics of its own."""
    return F.xxhash64(term, scope)


def _scope(df: DataFrame, scoped: bool) -> Column:
    return (F.col("folder_id").cast("string") if scoped else F.lit("")).alias("scope")


def _terms(queries: DataFrame, scoped: bool) -> DataFrame:
    words = queries.select("query_id", _scope(queries, scoped), F.explode(or_query(F.col("query"))).alias("word"))
    return words.select("query_id", "scope", _term(F.col("word"), F.col("scope")).alias("term"))


def _bits(terms: DataFrame) -> bytes:
    """A bit for each remainder of a term by _BITS; Spark gathers them in pieces of 4 KB."""
    size = 1 << 15
    bit = terms.select(F.pmod("term", F.lit(_BITS)).alias("bit"))
    pieces = bit.groupBy(F.floor(F.col("bit") / size).alias("piece")).agg(F.bitmap_construct_agg(F.col("bit") % size).alias("bits")).collect()
    out = bytearray(_BITS // 8)
    for row in pieces:
        out[row.piece * size // 8 : (row.piece + 1) * size // 8] = row.bits
    return bytes(out)


def build_index(
    leaves: DataFrame, path: str, k1: float = 1.2, b: float = 0.75, segmenter: Column | None = None, slice_leaves: int = SLICE, block: int = BLOCK, queries: DataFrame | None = None,
) -> KeywordIndex:
    """Writes the index of leaves (node_id, text[, tokens][, folder_id]) under path.

    segmenter: tokens of a leaf from another segmenter; a null falls back to the text's own tokens, as does a leaf without `tokens`. With folder_id the
    statistics are those of each folder. Leaves without text and tokens are left out.
    queries: all that will be asked (query_id, query[, folder_id]); terms that none of them has need no rows then. Which these are is told by a bit for each
    remainder, so that some others stay. Lengths and statistics are those of all tokens.
    """
    spark, scoped = leaves.sparkSession, "folder_id" in leaves.columns
    own = tokenize(F.col("text"))
    given = segmenter if segmenter is not None else (F.col("tokens") if "tokens" in leaves.columns else None)
    tokens = leaves.select("node_id", (own if given is None else F.coalesce(given, own)).alias("tokens"), _scope(leaves, scoped)).where("tokens IS NOT NULL AND scope IS NOT NULL")
    scratch = Scratch(spark, "tokens")
    tokens = scratch.keep(tokens.select("node_id", "scope", F.transform("tokens", lambda t: _term(t, F.col("scope"))).alias("tokens")))
    tokens.groupBy("scope").agg(F.count("*").alias("docs"), F.avg(F.size("tokens")).alias("mean"), F.lit(scoped).alias("scoped"), F.lit(block).alias("block")).write.mode("overwrite").parquet(f"{path}/scopes")
    index = KeywordIndex(spark, path, scoped, block)
    kind = leaves.schema["node_id"].dataType.simpleString()
    schema = f"slice bigint, term bigint, n int, best double, leaf array<int>, impact array<double>, block array<int>, block_best array<double>, nodes array<{kind}>"
    counted = tokens.join(index.scopes.select("scope", "mean"), "scope").select("node_id", "tokens", "mean")
    asked = None if queries is None else _bits(_terms(queries, scoped))
    counted.mapInArrow(_inverted(k1, b, slice_leaves, block, asked), schema).write.mode("overwrite").parquet(f"{path}/postings")
    scratch.clear()
    return index


def open_index(spark: SparkSession, path: str) -> KeywordIndex:
    """An index that `build_index` has written."""
    made = spark.read.parquet(f"{path}/scopes").select("scoped", "block").first()
    return KeywordIndex(spark, path, *(made or (False, BLOCK)))


def _inverted(k1: float, b: float, most: int, block: int, asked: bytes | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, leaves, size = TaskContext.get().partitionId(), 0, [], 0, 0
        needed = None if asked is None else np.unpackbits(np.frombuffer(asked, np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column("tokens")).to_numpy(zero_copy_only=False))
            i = 0
            while i < batch.num_rows:
                before = ends[i - 1] if i else 0
                fits = max(int(np.searchsorted(ends, before + SLICE_TOKENS - size, "right")) - i, 0 if leaves else 1)
                take = min(fits, most - leaves, batch.num_rows - i)
                if take:
                    held.append(batch.slice(i, take))
                    leaves, size = leaves + take, size + int(ends[i + take - 1] - before)
                    i += take
                if i < batch.num_rows or leaves == most:
                    yield from _slice(held, (part << 32) + made, k1, b, block, needed)
                    made, held, leaves, size = made + 1, [], 0, 0
        if held:
            yield from _slice(held, (part << 32) + made, k1, b, block, needed)

    return run


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), pa.array(values))


def _slice(held: list[pa.RecordBatch], number: int, k1: float, b: float, block: int, needed: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """The rows of one slice."""
    table = pa.Table.from_batches(held).combine_chunks()
    tokens = table.column("tokens").combine_chunks()
    length = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
    each = tokens.flatten().to_numpy(zero_copy_only=False)
    leaf = np.repeat(np.arange(len(length)), length)
    if needed is not None:
        kept = needed[each & (_BITS - 1)]
        leaf, each = leaf[kept], each[kept]
    # terms by their places in order, so that one number tells a leaf and a term
    known, at = np.unique(each, return_inverse=True)
    pairs, tf = np.unique(leaf * max(1, len(known)) + at, return_counts=True)
    leaf, at = np.divmod(pairs, max(1, len(known)))
    term = known[at]
    # leaves with the same most frequent term lie together, the shorter ones first
    starting = np.flatnonzero(np.concatenate((np.ones(min(1, len(leaf)), dtype=bool), leaf[1:] != leaf[:-1])))
    mode = np.zeros(len(length), dtype=np.int64)
    if len(starting):
        most = np.repeat(np.maximum.reduceat(tf, starting), np.diff(np.append(starting, len(leaf))))
        lead = np.flatnonzero(tf == most)[::-1]
        mode[leaf[lead]] = term[lead]  # of several the least term, which is set last
    laid = np.lexsort((length, mode))
    place = np.empty(len(laid), dtype=np.int64)
    place[laid] = np.arange(len(laid))
    mean = table.column("mean").to_numpy()
    impact = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[leaf] / np.maximum(mean[leaf], 1e-12)))
    leaf = place[leaf]
    order = np.argsort(at * len(length) + leaf)
    leaf, term, impact = leaf[order], term[order], impact[order]
    nodes = table.column("node_id").combine_chunks().take(pa.array(laid))
    names = ["slice", "term", "n", "best", "leaf", "impact", "block", "block_best", "nodes"]
    none = pa.nulls(1, pa.list_(pa.float64()))
    numbers = pa.nulls(1, pa.list_(pa.int32()))
    every = pa.ListArray.from_arrays(pa.array([0, len(nodes)], pa.int32()), nodes)
    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.nulls(1, pa.int64()), pa.array([len(nodes)], pa.int32()), pa.nulls(1, pa.float64()), numbers, none, numbers, none, every], names=names)
    if not len(term):
        return
    starts = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
    blocks = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (leaf[1:] // block != leaf[:-1] // block))))
    block_best = np.maximum.reduceat(impact, blocks)
    columns = [
        pa.array(np.full(len(starts), number, dtype=np.int64)), pa.array(term[starts]), pa.array(np.diff(np.append(starts, len(term))).astype(np.int32)), pa.array(np.maximum.reduceat(impact, starts)),
        _lists(leaf.astype(np.int32), starts), _lists(impact, starts),
        _lists((leaf[blocks] // block).astype(np.int32), np.searchsorted(blocks, starts)), _lists(block_best, np.searchsorted(blocks, starts)), pa.nulls(len(starts), every.type),
    ]
    rows = pa.RecordBatch.from_arrays(columns, names=names)
    for i in range(0, len(starts), 4096):
        yield rows.slice(i, 4096)


def _scorer(k: int, block: int, measure: bool):
    def run(postings: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """The k best leaves of a slice for each query, ties with the last one included; with `measure` a row without node for each query, with the number of leaves scored by all its terms."""
        head = postings["nodes"].notna()
        if not head.any() or not len(asked):
            return pd.DataFrame({"query_id": [], "node_id": [], "score": []})
        nodes = np.asarray(postings.loc[head, "nodes"].iloc[0])
        lists = {int(r.term): (np.asarray(r.leaf), np.asarray(r.impact), np.asarray(r.block), np.asarray(r.block_best)) for r in postings[~head].itertuples()}
        score, bound, rest = np.zeros(len(nodes)), *(np.zeros(-(-len(nodes) // block)) for _ in range(2))
        ids, found, points = [], [], []
        for query in asked.itertuples():
            terms = [(lists[term], idf, essential) for term, idf, essential in zip(query.terms.tolist(), query.idfs, query.essentials, strict=True) if term in lists]
            bound[:], rest[:], score[:] = 0, 0, 0
            for (_, _, blocks, best), idf, essential in terms:
                (bound if essential else rest)[blocks] += idf * best
            alive = bound + rest + _SLACK >= query.least
            every, touched = alive.all(), []
            for (leaf, impact, _, _), idf, essential in terms:
                if essential:
                    if not every:
                        inside = alive[leaf // block]
                        leaf, impact = leaf[inside], impact[inside]
                    score[leaf] += idf * impact
                    touched.append(leaf)
            leaves = np.unique(np.concatenate(touched)) if touched else np.zeros(0, dtype=np.int64)
            # the other terms are looked up for leaves that can still reach the least score with them
            leaves = leaves[score[leaves] + rest[leaves // block] + _SLACK >= query.least]
            for (leaf, impact, _, _), idf, essential in terms:
                if not essential and len(leaves):
                    at = np.minimum(np.searchsorted(leaf, leaves), len(leaf) - 1)
                    has = leaf[at] == leaves
                    score[leaves[has]] += idf * impact[at[has]]
            if measure:
                ids.append(query.query_id), found.append(None), points.append(float(len(leaves)))
            if not len(leaves):
                continue
            got = score[leaves].round(9)
            n = min(k, len(got))
            least = max(np.partition(got, len(got) - n)[len(got) - n], query.least - _SLACK)
            best = np.flatnonzero((got >= least) & (got > 0))
            ids += [query.query_id] * len(best)
            found += nodes[leaves[best]].tolist()
            points += got[best].tolist()
        return pd.DataFrame({"query_id": pd.Series(ids, dtype=object), "node_id": pd.Series(found, dtype=object), "score": np.array(points, dtype=np.float64)})

    return run


def _ranked(index: KeywordIndex, routed: DataFrame, k: int, parts: int, measure: bool = False) -> DataFrame:
    """(query_id, node_id, score) from the slices that the queries (slice, query_id, terms, idfs, essentials, least) are sent to."""
    asked = routed.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
    needed = asked.select("slice", "part", F.explode("terms").alias("term")).distinct()
    rows = index.postings
    lists = rows.where("term IS NOT NULL").join(needed, ["slice", "term"]).select("slice", "part", "term", "leaf", "impact", "block", "block_best", "nodes")
    heads = rows.where("term IS NULL").join(asked.select("slice", "part").distinct(), "slice").select("slice", "part", F.lit(0).cast("bigint").alias("term"), "leaf", "impact", "block", "block_best", "nodes")
    rows = lists.union(heads).withColumnsRenamed({"slice": "of", "part": "dealt"}).select(*[F.col(c).alias(c) for c in ("of", "dealt", "term", "leaf", "impact", "block", "block_best", "nodes")])
    kinds = (routed.schema["query_id"].dataType.simpleString(), rows.schema["nodes"].dataType.elementType.simpleString())
    both = rows.groupBy("of", "dealt").cogroup(asked.groupBy("slice", "part"))
    return both.applyInPandas(_scorer(k, index.block, measure), f"query_id {kinds[0]}, node_id {kinds[1]}, score double")


def ask(index: KeywordIndex, queries: DataFrame, k: int, measure: bool = False) -> DataFrame:
    """(query_id, node_id, score, rank): Okapi BM25 over leaves that have any of a query's tokens; ties by node_id. With measure: (query_id, scored), the leaves that were scored in all.

    queries: (query_id, query[, folder_id]). An index with folders gives a query leaves of its own folder only. The result is written, k rows a query.
    """
    scratch = Scratch(index.spark, "asked")
    terms = scratch.keep(_terms(queries, index.scoped))
    parts = max(1, -(-queries.count() // QUERIES))
    # of the postings only four narrow columns are read here
    here = scratch.keep(index.postings.select("slice", "term", "n", "best").join(terms.select("term").distinct(), "term"))
    known = here.groupBy("term").agg(F.sum("n").alias("df"), F.max("best").alias("best"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = terms.join(known, "term").join(index.scopes.select("scope", "docs"), "scope").select("query_id", "term", idf.alias("idf"), (idf * F.col("best")).alias("most"), "df")
    rarest = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    weighed = scratch.keep(weighed.withColumn("seed", F.coalesce(F.sum("df").over(rarest), F.lit(0)) < SEEDS * k))

    def routed(asked: DataFrame) -> DataFrame:
        """To each slice that has an essential term and can reach the least score, each query with its terms."""
        slices = asked.join(here.select("slice", "term", "best"), "term").groupBy("query_id", "slice").agg(F.sum(F.col("idf") * F.col("best")).alias("bound"), F.bool_or("essential").alias("any"), F.first("least").alias("least"))
        slices = slices.where(F.col("any") & (F.col("bound") + _SLACK >= F.col("least"))).select("query_id", "slice")
        lists = asked.groupBy("query_id", "least").agg(F.collect_list(F.struct("term", "idf", "essential")).alias("all"))
        lists = lists.select("query_id", "least", F.col("all.term").alias("terms"), F.col("all.idf").alias("idfs"), F.col("all.essential").alias("essentials"))
        return scratch.keep(slices.join(lists, "query_id"))

    first = weighed.select("query_id", "term", "idf", F.col("seed").alias("essential"), F.lit(0.0).alias("least"))
    seeds = top_k(_ranked(index, routed(first), k, parts), k, ["query_id"], F.desc("score"), F.col("node_id"))
    reached = scratch.keep(seeds.where(F.col("rank") == k).select("query_id", F.col("score").alias("least")))
    ascending = Window.partitionBy("query_id").orderBy("most", "term")
    second = weighed.join(reached, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    second = second.withColumn("essential", F.sum("most").over(ascending) + _SLACK >= F.col("least"))
    second = second.select("query_id", "term", "idf", "essential", "least")
    found = _ranked(index, routed(second), k, parts, measure)
    if measure:
        out = found.where("node_id IS NULL").groupBy("query_id").agg(F.sum("score").cast("bigint").alias("scored"))
    else:
        out = top_k(found, k, ["query_id"], F.desc("score"), F.col("node_id"))
    out = Scratch(index.spark, "ranked").keep(out)
    scratch.clear()
    return out
