"""A trie of conversation prefixes, and what is saved by reading shared prefixes once, by an Euler tour.

Prefixes are named by hashes that a scan over the sorted turns makes, whatever the length of a conversation. Nodes are numbered in the order of their smallest
member and depth; two arcs, enter and exit, stand for each. The tour is a linked list (into the first child, on to the next sibling, back to the
parent), whose places `list_ranks` finds. Prefix sums over the arcs in that order, taken at a node's two arcs, give the leaves and the savings of its subtree: no
walk through the tree, no task for a level, and no limit of depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Words, as_bytes, small_batches, steps
from .scans import BLOCK, LAST, list_ranks, scan

#: Conversations that share their beginning: the first of so many gives turns to all; so many turns at most.
FAMILY, SHARED = 20, 3
#: Bases of the two hashes of a prefix.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Bytes of conversation numbers in one piece of those that end at a node.
PIECE = 1 << 16
_NOTHING = hashlib.sha256().hexdigest()


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes of each turn's role and text, and the text's words."""
    for batch in batches:
        roles, texts = ([x or b"" for x in as_bytes(batch.column(c))] for c in ("role", "text"))
        digests = [hashlib.blake2b(len(r).to_bytes(8, "little") + r + t, digest_size=16).digest() for r, t in zip(roles, texts, strict=True)]
        marks = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
        n = [k for i, j in steps(texts) for k in Words(texts[i:j]).count]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array(n, pa.int64())], names=["conv_id", "turn", "h1", "h2", "words"])


def _own(c: str) -> Column:
    """Turns that a conversation replaces by those of its family's first."""
    return (F.crc32(F.col(c).cast("string").cast("binary")) % (SHARED + 1)).cast("int")


def rebuilt(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The conversations' ids, and the turns (conv_id, source, place, h1, h2, words) of the rebuilt ones: source 0 from the family's first, 1 their own."""
    some = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    turns = some.mapInArrow(_turns, "conv_id bigint, turn bigint, h1 bigint, h2 bigint, words bigint").withColumn("one", F.lit(1).cast("bigint"))
    numbered = scratch.keep(scan(turns, ["conv_id", F.col("turn").asc_nulls_first(), "h1", "h2"], {"one": 1}, scratch, "conv_id").select("conv_id", "place", "h1", "h2", "words"))
    ids = scratch.keep(numbered.select("conv_id").distinct())
    heads = numbered.where(F.col("place") <= SHARED).withColumnRenamed("conv_id", "first")
    shared = ids.withColumn("first", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "first").where(F.col("place") <= _own("conv_id"))
    own = numbered.where(F.col("place") > _own("conv_id"))
    columns = ["place", "h1", "h2", "words"]
    return ids, shared.select("conv_id", F.lit(0).alias("source"), *columns).union(own.select("conv_id", F.lit(1).alias("source"), *columns))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, conv_id) in order to rows (node, first, ids): decimal numbers joined by commas, in pieces."""
    node, first, held, size = None, None, [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([first], pa.int64()), pa.array([",".join(held)])], names=["node", "first", "ids"])

    for batch in batches:
        for n, c in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if held and (n != node or size > PIECE):
                yield out()
                held, size = [], 0
            if not held:
                node, first = n, c
            held.append(str(c))
            size += len(held[-1]) + 1
    if held:
        yield out()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, first, ids) in order to (node, ends_sha256), by one digest that takes piece after piece."""
    node, digest = None, None
    for batch in batches:
        nodes, found = [], []
        for n, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if digest is not None and n == node:
                digest.update(b"," + ids.encode())
                continue
            if digest is not None:
                nodes.append(node), found.append(digest.hexdigest())
            node, digest = n, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.string())], names=["node", "ends_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([digest.hexdigest()])], names=["node", "ends_sha256"])


def _ends(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of rows (node, conv_id). A node's numbers are joined where they lie after a sort by range, so that the one task that must take them all, since a digest is a chain, gets some long pieces."""
    pieces = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_joined, "node bigint, first bigint, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_digested, "node bigint, ends_sha256 string")


def _tour(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, next) of the arcs: 2 * number enters a node, 2 * number + 1 leaves it. nodes: (number, parent), the root's parent null."""
    below = nodes.where("parent IS NOT NULL").select("parent", "number", (F.col("number") + 1).alias("mark"))
    # from the last sibling to the first, the value before is the next sibling's; groups may be as large as they like
    siblings = scan(below, ["parent", F.col("number").desc()], {"mark": 0}, scratch, "parent").select("number", F.col("mark_before").alias("sibling"), "parent")
    first = below.groupBy("parent").agg(F.min("number").alias("child")).withColumnRenamed("parent", "number")
    entered = nodes.select("number").join(first, "number", "left").select((2 * F.col("number")).alias("id"), F.coalesce(2 * F.col("child"), 2 * F.col("number") + 1).alias("next"))
    left = siblings.select((2 * F.col("number") + 1).alias("id"), F.when(F.col("sibling") > 0, 2 * (F.col("sibling") - 1)).otherwise(2 * F.col("parent") + 1).alias("next"))
    root = nodes.where("parent IS NULL").select((2 * F.col("number") + 1).alias("id"), F.lit(None).cast("bigint").alias("next"))
    return entered.union(left).union(root)


def prefix_trie(conversations: DataFrame, block: int = BLOCK, last: int = LAST) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node, the root included.

    Null roles and texts are empty ones. Rows without conv_id are left out. Turns are ordered by turn, null first, and those of the same turn (repeated rows among them) by a hash of role and
    text. Conversations, nodes and groups of children may have any number of rows; a very long text takes some ten numbers of 8 bytes for each of its bytes. Other
    columns are left out; an empty table gives no node.
    """
    spark = conversations.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "trie")
    ids, turns = rebuilt(conversations, scratch)
    path = scan(turns.withColumnRenamed("place", "turn_no"), ["conv_id", "source", "turn_no"], {"h1": _BASES[0], "h2": _BASES[1]}, scratch, "conv_id")
    path = scratch.keep(path.select("conv_id", F.col("place").alias("depth"), F.col("h1_with").alias("k1"), F.col("h2_with").alias("k2"), F.col("h1_before").alias("p1"), F.col("h2_before").alias("p2"), "words"))
    zero = F.lit(0).cast("bigint")
    roots = ids.select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), zero.alias("p1"), zero.alias("p2"), zero.alias("words"))
    members = path.union(roots)
    named = members.groupBy("depth", "k1", "k2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("words").alias("words"))
    # a conversation has one node at each depth, so that the smallest member and the depth name a node
    numbered = scan(named.withColumn("one", F.lit(1).cast("bigint")), ["conv_id", "depth"], {"one": 1}, scratch)
    numbered = scratch.keep(numbered.select(F.col("one_before").alias("number"), "depth", "k1", "k2", "conv_id", "n_convs", "p1", "p2", "words"))
    above = numbered.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("number").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = scratch.keep(numbered.join(above, ["depth", "p1", "p2"], "left").select("number", "parent", "parent_conv_id", "conv_id", "depth", "k1", "k2", "n_convs", "words"))

    ranks = list_ranks(_tour(nodes.select("number", "parent"), scratch), scratch, block, last)
    children = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "number")
    nodes = scratch.keep(nodes.join(children, "number", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))))
    entering = nodes.select((2 * F.col("number")).alias("id"), (F.col("n_children") == 0).cast("bigint").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    arcs = ranks.join(entering, "id", "left").select("rank", "id", *[F.coalesce(c, zero).alias(c) for c in ("leaves", "saved")])
    summed = scan(arcs, ["rank"], {"leaves": 1, "saved": 1}, scratch)
    leaving = F.col("id") % 2 == 1
    inside = lambda c: F.sum(F.when(leaving, F.col(f"{c}_before")).otherwise(-F.col(f"{c}_before")))
    sums = summed.groupBy(F.floor(F.col("id") / 2).alias("number")).agg(inside("leaves").alias("n_leaves"), inside("saved").alias("saved_tokens"))

    deepest = members.groupBy("conv_id").agg(F.max(F.struct("depth", "k1", "k2")).alias("end")).select(F.col("conv_id").alias("c"), "end.*")
    ends = _ends(deepest.join(nodes.select("number", "depth", "k1", "k2"), ["depth", "k1", "k2"]).select(F.col("number").alias("node"), F.col("c").alias("conv_id")))
    out = nodes.join(sums, "number").join(ends.withColumnRenamed("node", "number"), "number", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256"))
