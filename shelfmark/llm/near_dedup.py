"""MinHash near-dedup with circulant signatures.

One permutation (SIGMA) scatters the shingles; a second (PI), shifted circularly by 0, 1, 2, ... steps, gives all
coordinates of a signature from those places. Bands of coordinates name buckets; exact Jaccard similarity of the full
shingle sets confirms every link.

No group is expanded into pairs. Texts with the same shingle set become one class first. Each bucket then links
its members to its smallest one (a star), and confirmed stars give components. Members of a bucket that are still in
different components are compared with one another inside tasks, in blocks of bounded size: first by their signatures, which
leaves those that have a likely partner, then by their full sets, which gives one link for each two components that meet. All
buckets go by this one rule, whatever their size; buckets with the same members are compared once. Copies cost one comparison
each and no link is given up. Members of a bucket with more than one component are sent once for each block of their bucket, so
that a family of near texts that are not linked costs its size divided by BLOCK; other texts are sent once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, Words, as_bytes, durable, mix, small_batches, steps, windows

#: Bands and coordinates in each: a pair at 0.85 misses all bands with probability 8e-7, at 0.9 with 3e-10.
BANDS, ROWS = 24, 5
SIZE = 3
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
#: A pair whose signatures agree in a smaller share of coordinates is not confirmed: 5 standard deviations below 0.85.
LEAST_AGREEMENT = 0.69
#: Members of a block at most on average, and bytes of what is compared; bytes that one call of Python gets.
BLOCK, BLOCK_BYTES, CALL_BYTES = 1024, 2 << 20, 8 << 20

_NONE = np.zeros(0, dtype=np.uint64)


def _sigma(shingles: np.ndarray) -> np.ndarray:
    """The first permutation: a shingle's place on the circle of 2**32 places."""
    return (mix(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


def _pi(x: np.ndarray) -> np.ndarray:
    """The second permutation of the circle, in place: a bijection of 32-bit integers."""
    x *= np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE3D)
    return x


#: Circular shifts of PI, one for each coordinate: multiples of an odd step.
_SHIFT = (np.arange(BANDS * ROWS, dtype=np.uint64) * np.uint64(0x3C6EF372) % np.uint64(1 << 32)).astype(np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Coordinate k: the least PI(SIGMA(s) + shift k) over the shingles s."""
    places = _sigma(shingles)
    least = np.full(len(_SHIFT), 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(places), 256):
        np.minimum(least, _pi(places[i : i + 256, None] + _SHIFT).min(axis=0), out=least)
    return least


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingles as 64-bit hashes: 3 words in a row, or the whole of a shorter text."""
    words = Words(texts, lower=True)
    hashes = words.hashes()
    grams, at = windows(hashes, words.text, SIZE)
    bounds = np.searchsorted(at, words.first)
    for i, n in enumerate(words.count):
        if n >= SIZE:
            yield np.unique(grams[bounds[i] : bounds[i + 1]])
        elif n:
            few = hashes[words.first[i] : words.first[i + 1]]
            yield mix(few[:1] * np.uint64(3) + few[-1:] * np.uint64(7 * (n - 1)) + np.uint64(n))
        else:
            yield _NONE


def _set_key(found: np.ndarray) -> bytes | None:
    """128 bits that tell a set from others; None for the empty set."""
    if not len(found):
        return None
    total = np.concatenate((found, found[:1] * 0 + np.uint64(len(found))))
    return mix(total).sum(dtype=np.uint64).tobytes() + mix(total ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).tobytes()


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    band_seed = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in batches:
        texts = [t or b"" for t in as_bytes(batch.column("text"))]
        size, key, marks, bands = [], [], [], []
        for i, j in steps(texts):
            for found in shingle_sets(texts[i:j]):
                size.append(len(found))
                if not len(found):
                    key.append(None), marks.append(None), bands.append(None)
                    continue
                key.append(_set_key(found))
                coordinates = signature(found)
                marks.append(coordinates.astype(np.uint8).tobytes())
                rows = coordinates.reshape(BANDS, ROWS).astype(np.uint64)
                h = band_seed.copy()
                for c in range(ROWS):
                    h = mix(h + rows[:, c])
                bands.append(h.view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(marks, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_key", "marks", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, shingles) of rows (id, set_key, text) whose text has the set of that key."""
    for batch in batches:
        texts = [t or b"" for t in as_bytes(batch.column("text"))]
        ids, keys = batch.column("id").to_pylist(), batch.column("set_key").to_pylist()
        for i, j in steps(texts):
            found = [(x, s.tobytes()) for x, k, s in zip(ids[i:j], keys[i:j], shingle_sets(texts[i:j]), strict=True) if _set_key(s) == k]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())], names=["id", "shingles"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the key of their text's set behind them; column `text` is the last but for the key's."""
    for batch in batches:
        texts = [t or b"" for t in as_bytes(batch.column(batch.num_columns - 1))]
        keys = [_set_key(found) for i, j in steps(texts) for found in shingle_sets(texts[i:j])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(keys, pa.binary())], names=[*batch.schema.names[:-1], "set_key"])


@F.pandas_udf(T.BooleanType())
def _linked(a: pd.Series, b: pd.Series) -> pd.Series:
    """Are two full sets similar enough?"""
    out = np.zeros(len(a), dtype=bool)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        u, v = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
        both = len(np.intersect1d(u, v, assume_unique=True))
        out[i] = 100 * both >= PERCENT * (len(u) + len(v) - both)
    return pd.Series(out)


@F.pandas_udf(T.BooleanType())
def _agree(a: pd.Series, b: pd.Series) -> pd.Series:
    """Do enough coordinates of two signatures agree for the sets to be compared?"""
    if not len(a):
        return pd.Series([], dtype=bool)
    x, y = (np.frombuffer(b"".join(s), dtype=np.uint8).reshape(len(s), -1) for s in (a, b))
    return pd.Series((x == y).mean(axis=1) >= LEAST_AGREEMENT)


def _near_sizes(a, b):
    """Sets can only be similar enough if the smaller has PERCENT of the larger's size."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("left_set"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("right_set"))
    return pairs.join(left, "a").join(right, "b").where(_linked("left_set", "right_set")).select("a", "b")


def _agreeing(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures let them be similar enough."""
    left, right = (marks.select(F.col("id").alias(c), F.col("marks").alias(f"{c}_marks")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").where(_agree("a_marks", "b_marks")).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over the edges (a, b), for every id in an edge.

    Every id joins its first neighbour, in two steps; edges then run between what was joined, and edges inside it are gone. The first
    round goes by the ids themselves, which ends a star at once; later rounds go by hashes, so that a chain shrinks by a share of its length.
    """
    scratch = Scratch(edges.sparkSession)
    left = scratch.keep(edges.select("a", "b").where("a != b").distinct())
    roots = None
    for turn in count():
        order = F.lit(0) if turn == 0 else None
        key = lambda c, order=order, turn=turn: F.struct((F.xxhash64(F.lit(turn), c) if order is None else order).alias("order"), F.col(c).alias("id"))
        both = left.select("a", "b").union(left.select("b", "a"))
        near = both.groupBy("a").agg(F.min(key("b")).alias("near"))
        first = scratch.keep(near.select(F.col("a").alias("id"), F.least(key("a"), "near")["id"].alias("to")))
        second = first.select(F.col("id").alias("to"), F.col("to").alias("further"))
        joined = scratch.keep(first.join(second, "to", "left").select("id", F.coalesce("further", "to").alias("root")))
        if roots is None:
            roots = joined
        else:
            roots = scratch.keep(roots.join(joined.select(F.col("id").alias("root"), F.col("root").alias("next")), "root", "left").select("id", F.coalesce("next", "root").alias("root")))
        ends = [joined.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab"]
        left = scratch.keep(left.join(ends[0], "a").join(ends[1], "b").where("a_root != b_root").select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct())
        if left.isEmpty():
            break
    least = roots.groupBy("root").agg(F.min("id").alias("component"))
    out = durable(roots.join(least, "root").select("id", "component"))
    scratch.clear()
    return out


def _units(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The rows of each bucket's block or pair of blocks, two or more."""
    rows = rows.sort_values(["bucket", "low", "high", "id"], ignore_index=True)
    keys = rows[["bucket", "low", "high"]].to_numpy()
    edges = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]))
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        if high - low > 1:
            yield rows.iloc[low:high]


def _comparable(i: int, group: np.ndarray, sizes: np.ndarray, blocks: np.ndarray | None) -> np.ndarray:
    """Which members after i can be linked with it and are not yet: by component, size and, between two blocks, block."""
    ok = (group[i + 1 :] != group[i]) & (100 * np.minimum(sizes[i + 1 :], sizes[i]) >= PERCENT * np.maximum(sizes[i + 1 :], sizes[i]))
    return ok if blocks is None else ok & (blocks[i + 1 :] != blocks[i])


def _likely(rows: pd.DataFrame) -> pd.DataFrame:
    """(bucket, id) of members whose signature agrees with that of another member in a different component."""
    found = []
    for unit in _units(rows):
        sizes, group = unit["n_shingles"].to_numpy(), unit["component"].to_numpy()
        blocks = unit["block"].to_numpy() if unit["low"].iloc[0] != unit["high"].iloc[0] else None
        marks = np.frombuffer(b"".join(unit["payload"]), dtype=np.uint8).reshape(len(unit), -1)
        partner = np.zeros(len(unit), dtype=bool)
        for i in range(len(unit) - 1):
            at = np.flatnonzero(_comparable(i, group, sizes, blocks)) + i + 1
            if len(at):
                at = at[(marks[at] == marks[i]).mean(axis=1) >= LEAST_AGREEMENT]
                partner[at] = True
                partner[i] |= len(at) > 0
        if partner.any():
            found.append(unit.loc[partner, ["bucket", "id"]])
    return pd.concat(found) if found else rows.loc[[], ["bucket", "id"]]


def _across(rows: pd.DataFrame) -> pd.DataFrame:
    """Confirmed links between members of different components; in a unit one for each two components that meet."""
    a, b = [], []
    for unit in _units(rows):
        ids, sizes = unit["id"].to_numpy(), unit["n_shingles"].to_numpy()
        blocks = unit["block"].to_numpy() if unit["low"].iloc[0] != unit["high"].iloc[0] else None
        _, group = np.unique(unit["component"].to_numpy(), return_inverse=True)
        _, codes = np.unique(np.frombuffer(b"".join(unit["payload"]), dtype=np.uint64), return_inverse=True)
        first = np.concatenate(([0], np.cumsum(sizes)))
        present = np.zeros(len(codes) + 1, dtype=bool)
        for i in range(len(ids) - 1):
            ok = _comparable(i, group, sizes, blocks)
            if not ok.any():
                continue
            mine = codes[first[i] : first[i + 1]]
            present[mine] = True
            both = np.add.reduceat(present[codes[first[i + 1] :]].astype(np.int64), first[i + 1 : -1] - first[i + 1])
            present[mine] = False
            for j in np.flatnonzero(ok & (100 * both >= PERCENT * (sizes[i] + sizes[i + 1 :] - both))) + i + 1:
                if group[i] != group[j]:
                    a.append(ids[i]), b.append(ids[j])
                    group[group == group[j]] = group[i]
    return pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})


def _compared(members: DataFrame, payload: DataFrame, weight, compare, schema: str) -> DataFrame:
    """`compare` over the blocks of each bucket's members (bucket, id, component, n_shingles) with their payload (id, payload) of about `weight` bytes."""
    blocks = members.groupBy("bucket").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(weight) / BLOCK_BYTES)).alias("blocks"))
    dealt = members.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("id", "bucket"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    dealt = durable(dealt.select("bucket", "id", "component", "n_shingles", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")))
    calls = max(1, -(-(dealt.agg(F.sum(weight)).first()[0] or 0) // CALL_BYTES))
    sent = dealt.join(payload, "id").withColumn("call", F.pmod(F.xxhash64("bucket", "low", "high"), F.lit(calls)))
    return sent.groupBy("call").applyInPandas(compare, schema)


class _Graph:
    """What near-duplicate detection finds out about the texts of docs.

    signed: (doc_id, n_shingles, set_key, ...) of each row. classes: (set_key, id, least), the different sets with a number and their smallest doc_id.
    links: (a, b), numbers of classes that are similar enough; found: (id, component), their components. repeated: does a doc_id occur again?
    """

    def __init__(self, docs: DataFrame) -> None:
        small_batches(docs.sparkSession)
        texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
        kind = docs.schema["doc_id"].dataType.simpleString()
        self.signed = durable(texts.mapInArrow(_signed, f"doc_id {kind}, n_shingles bigint, set_key binary, marks binary, bands array<bigint>"))
        some = self.signed.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
        self.repeated = not some.groupBy("doc_id").count().where("count > 1").isEmpty()
        classes = durable(some.groupBy("set_key").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("marks").alias("marks"), F.first("bands").alias("bands")).withColumn("id", F.monotonically_increasing_id()))  # numbers that are written once
        self.classes = classes.select("set_key", "id", "least")

        placed = classes.select("id", "n_shingles", F.explode("bands").alias("bucket"))
        buckets = placed.groupBy("bucket").agg(F.min(F.struct("id", "n_shingles")).alias("center"), F.count("*").alias("members")).where("members > 1")
        members = durable(placed.join(buckets.select("bucket", "center"), "bucket"))
        near = _near_sizes(F.col("n_shingles"), F.col("center.n_shingles")) & (F.col("id") != F.col("center.id"))
        stars = durable(members.where(near).select(F.col("id").alias("a"), F.col("center.id").alias("b")).distinct())
        marks = classes.select("id", "marks")
        shared = members.select("id").distinct()
        needed = texts.join(self.classes.join(shared, "id").select(F.col("least").alias("doc_id"), "id", "set_key"), "doc_id").select("id", "set_key", "text")
        sets = needed.mapInArrow(_sets, "id bigint, shingles binary")
        if self.repeated:  # a doc_id's rows can have the same set again
            sets = sets.groupBy("id").agg(F.first("shingles").alias("shingles"))
        sets = durable(sets)
        self.links = durable(_confirm(_agreeing(stars, marks), sets))
        self.found = components(self.links)

        # members of buckets that still have different components
        labelled = members.join(self.found, "id", "left").withColumn("component", F.coalesce("component", "id"))
        content = [F.count("*"), F.bit_xor(F.xxhash64("id")), F.bit_xor(F.xxhash64("id", F.lit(1)))]
        mixed = labelled.groupBy("bucket").agg((F.min("component") != F.max("component")).alias("mixed"), F.struct(*[c.alias(f"c{k}") for k, c in enumerate(content)]).alias("content")).where("mixed")
        mixed = mixed.groupBy("content").agg(F.min("bucket").alias("bucket")).select("bucket")
        rest = durable(labelled.join(mixed, "bucket").select("bucket", "id", "component", "n_shingles"))
        if rest.isEmpty():
            return
        likely = _compared(rest, marks.withColumnRenamed("marks", "payload"), F.lit(BANDS * ROWS + 40), _likely, "bucket bigint, id bigint").distinct()
        rest = durable(rest.join(likely, ["bucket", "id"], "left_semi"))
        late = durable(_compared(rest, sets.withColumnRenamed("shingles", "payload"), 8 * F.col("n_shingles") + 40, _across, "a bigint, b bigint"))
        if not late.isEmpty():
            self.links = self.links.union(late)
            self.found = components(self.links)

    def named(self, found: DataFrame) -> DataFrame:
        """(set_key, id, least, component) of each class, by the components given."""
        return self.classes.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row.

    A null, empty or blank text has no shingles and is linked with nothing. Rows that repeat a doc_id are linked with one another whatever their
    texts, so that a doc_id has one component; n_shingles is that of the row's own text, and of rows with the smallest doc_id all are kept. A row without doc_id gets
    the smallest doc_id of texts with the same shingle set, or null; a set that only such rows have is not linked further. kept: doc_id is component_id (true where
    both are null). Other columns are left out; an empty table gives an empty one.
    """
    graph = _Graph(docs)
    found, signed = graph.found, graph.signed
    if graph.repeated:
        own = signed.where("set_key IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "set_key").distinct().join(graph.classes.select("set_key", "id"), "set_key").select("doc_id", "id")
        firsts = own.groupBy("doc_id").agg(F.min("id").alias("b"))
        again = own.join(firsts, "doc_id").where("id != b").select(F.col("id").alias("a"), "b")
        found = components(graph.links.union(again))
    named = graph.named(found)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("set_key", "component_id")
    out = signed.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    own = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of linked texts, that with the smallest doc_id, with all its columns whatever their names; rows without shingles stay.

    Rows that repeat a doc_id are told apart by their texts: each text that is linked with no other stays, and rows that repeat a doc_id and a text
    become one. Rows without doc_id stay, since no decision can name them. An empty table gives an empty one.
    """
    graph = _Graph(docs)
    first = graph.named(graph.found).groupBy("component").agg(F.min(F.struct("least", "set_key")).alias("first"))
    first = durable(first.select(F.col("first.least").alias("doc_id"), F.col("first.set_key").alias("set_key")))
    if not graph.repeated:
        blank = graph.signed.where("set_key IS NULL AND doc_id IS NOT NULL").select("doc_id")
        kept = first.select("doc_id").union(blank).distinct()
        with_id = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]) if _repeats(blank) else docs.join(kept, "doc_id", "left_semi")
        return with_id.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))
    row = docs.where("doc_id IS NOT NULL").select("doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    keyed = row.mapInArrow(_keyed, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row {row.schema['row'].dataType.simpleString()}, set_key binary")
    blank = keyed.where("set_key IS NULL")
    kept = keyed.join(first, ["doc_id", "set_key"], "left_semi").select("doc_id", "row", "set_key").unionByName(blank).dropDuplicates(["doc_id", "set_key"])
    return kept.select("row.*").unionByName(docs.where("doc_id IS NULL"))


def _repeats(rows: DataFrame) -> bool:
    return not rows.groupBy("doc_id").count().where("count > 1").isEmpty()
