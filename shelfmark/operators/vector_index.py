"""An inverted file of vectors with product codes, for approximate nearest neighbours by cosine.

Cells and codebooks are k-means centres of a bounded sample of the leaves' vectors; every leaf is indexed. A leaf lies in the cell of its nearest centre and is coded by what it
differs from that centre, one byte for each PART dimensions. Leaves of one cell that a task holds become blocks of ids and codes, so that the index is made
without a shuffle and is a small share of the vectors' size.

A query looks into its nearest cells, as many as hold a stated share of all leaves. Leaves are gathered into rows of many in the order of their cells, queries into packs of those whose nearest
cells are the same. A task has one pack and is sent the codes of all leaves, row by row: approximate scores of a cell's leaves come from a matrix product with those queries of the pack that look into it.
Of each query it only holds the best so far, some for each one asked for, whatever the number of leaves. Each leaf that a pack has kept is sent to it once, and scored exactly from the leaf's own vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.sources.durable import Scratch

from .ranking import top_k

#: Vectors that cells and codebooks are fitted on, at most; dimensions of one byte of a code; centres of a codebook.
SAMPLE, PART, CENTRES = 20_000, 4, 256
#: There are CELLS times the square root of the leaves as cells, but PER_CELL sampled vectors for each at least: the finer the cells, the better a share of the leaves
#: is chosen (on embedded chunks, a tenth of all leaves holds 0.84 of the ten nearest with one cell for each square root and 0.93 with eight).
CELLS, PER_CELL = 8, 8
#: Leaves of a block, queries of a pack, and blocks of leaves that a row holds, at most; leaves of a partition of rows, about.
LEAVES, QUERIES, BLOCKS, TASK = 1024, 1 << 14, 16, 1 << 18
#: Vectors that are held against all cells at a time; queries that are held against LEAVES leaves at a time.
AT_ONCE, TILE = 1024, 512
#: Share of all leaves that a query is held against, at most, if its nearest cell alone does not hold more; candidates scored exactly for each one asked for.
SHARE, REFINE = 0.1, 20


@dataclass(frozen=True)
class Model:
    """cells: (cells, width) centres of unit length; books: (parts, CENTRES, PART). The last part is filled up with zeros."""

    cells: np.ndarray
    books: np.ndarray

    @property
    def width(self) -> int:
        return self.cells.shape[1]

    def _parts(self, vectors: np.ndarray) -> np.ndarray:
        parts, _, each = self.books.shape
        return np.pad(vectors, ((0, 0), (0, parts * each - self.width))).reshape(len(vectors), parts, each)

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        out = np.empty(len(vectors), np.int64)
        for i in range(0, len(vectors), AT_ONCE):
            out[i : i + AT_ONCE] = np.argmax(vectors[i : i + AT_ONCE] @ self.cells.T, axis=1)
        return out

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector and its code."""
        cell = self.nearest(vectors)
        rest = self._parts(vectors - self.cells[cell])
        return cell, np.stack([_nearest(rest[:, i], book) for i, book in enumerate(self.books)], axis=1).astype(np.uint8)

    def decode(self, cell: int | np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors of codes of one cell, or of a cell each."""
        rest = np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], axis=1)[:, : self.width]
        return self.cells[cell] + rest


@dataclass(frozen=True)
class VectorIndex:
    """Where an index lies. blocks: (cell, part, number, nodes, codes); model: its arrays."""

    spark: SparkSession
    path: str

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/blocks")

    def model(self) -> Model | None:
        """Bounded by SAMPLE: a cell needs PER_CELL sampled vectors."""
        rows = {r.name: np.frombuffer(r.data, np.float32).reshape(r.shape) for r in self.spark.read.parquet(f"{self.path}/model").collect()}
        return Model(rows["cells"], rows["books"]) if rows else None


def unit(vectors: pa.Array) -> np.ndarray:
    """Rows of unit length; a vector of zeros stays."""
    flat = pa.concat_arrays([vectors]).flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    m = flat.reshape(len(vectors), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(points), np.int64)
    for i in range(0, len(points), 8192):
        out[i : i + 8192] = np.argmin((centres**2).sum(1)[None, :] - 2 * points[i : i + 8192] @ centres.T, axis=1)
    return out


def kmeans(points: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k centres (fewer for fewer points); a centre without points starts again from a point far from its own."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(points, centres)
        n = np.bincount(at, minlength=len(centres))
        sums = np.stack([np.bincount(at, weights=points[:, d], minlength=len(centres)) for d in range(points.shape[1])], axis=1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres).astype(np.float32)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            far = np.argsort(((points - centres[at]) ** 2).sum(1))[::-1]
            centres[empty] = points[far[: len(empty)]]
    return centres


def fit(vectors: np.ndarray, leaves: int, seed: int = 5) -> Model:
    """Cells and codebooks from different sampled vectors of unit length, for an index of so many leaves."""
    points = np.unique(vectors, axis=0)
    count = max(1, min(len(points) // PER_CELL, int(np.ceil(CELLS * np.sqrt(leaves)))))
    cells = kmeans(points, count, seed)
    cells /= np.maximum(np.linalg.norm(cells, axis=1, keepdims=True), 1e-12)
    parts = -(-points.shape[1] // PART)
    model = Model(cells.astype(np.float32), np.zeros((parts, 1, PART), np.float32))
    rest = model._parts(points - cells[np.argmax(points @ cells.T, axis=1)])
    books = np.zeros((parts, CENTRES, PART), np.float32)
    for i in range(parts):
        found = kmeans(rest[:, i], CENTRES, seed + 1 + i)
        books[i, : len(found)] = found
        books[i, len(found) :] = found[0]
    return Model(model.cells, books)


def _usable(df: DataFrame, key: str, width: int | None = None) -> DataFrame:
    """Rows with an id and a whole vector, of the given width."""
    e = F.col("embedding")
    ok = F.col(key).isNotNull() & (F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x.cast("double")))
    return df.select(key, e.cast("array<float>").alias("embedding")).where(ok if width is None else ok & (F.size(e) == width))


def build_vector_index(leaves: DataFrame, path: str, sample: int = SAMPLE, seed: int = 5) -> VectorIndex:
    """Writes the index of leaves (node_id, embedding) under path.

    Rows without id, without vector, with a null or NaN in it or of another width than the sample's first don't count. The sample is the `sample` leaves of the smallest hashed
    ids (`SAMPLE` by default); everything else is from all leaves. No leaves make an index that finds nothing.
    """
    spark = leaves.sparkSession
    rows = _usable(leaves, "node_id")
    drawn = rows.orderBy(F.xxhash64("node_id"), F.col("node_id").cast("string"), "embedding").limit(sample).select("embedding").toArrow()["embedding"].combine_chunks()
    widths = drawn.value_lengths().to_numpy(zero_copy_only=False)
    shape = "name string, shape array<int>, data binary"
    kind = rows.schema["node_id"].dataType.simpleString()
    out = f"cell int, part int, number int, nodes array<{kind}>, codes binary"
    if not len(drawn):
        spark.createDataFrame([], shape).write.parquet(f"{path}/model")
        spark.createDataFrame([], out).write.parquet(f"{path}/blocks")
        return VectorIndex(spark, path)
    width = int(widths[0])
    rows = _usable(leaves, "node_id", width)
    model = fit(unit(drawn.filter(pa.array(widths == width))), rows.count(), seed)
    spark.createDataFrame([(name, list(a.shape), a.tobytes()) for name, a in (("cells", model.cells), ("books", model.books))], shape).coalesce(1).write.parquet(f"{path}/model")
    sent = spark.sparkContext.broadcast(model)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, codes = sent.value.encode(unit(batch.column("embedding")))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch.column("node_id"), pa.array([c.tobytes() for c in codes], pa.binary())], names=["cell", "node_id", "code"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for cell, at in _runs(batch.column("cell"), LEAVES):
                nodes = batch.column("node_id").slice(at.start, len(at))
                codes = b"".join(batch.column("code").slice(at.start, len(at)).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([part], pa.int32()), pa.array([number], pa.int32()), _list(nodes), pa.array([codes], pa.binary())], names=["cell", "part", "number", "nodes", "codes"])
                number += 1

    coded = rows.mapInArrow(code, f"cell int, node_id {kind}, code binary").sortWithinPartitions("cell", "node_id")
    coded.mapInArrow(pack, out).write.parquet(f"{path}/blocks")
    return VectorIndex(spark, path)


def _runs(keys: pa.Array, most: int) -> Iterator[tuple[int, range]]:
    """Runs of equal sorted keys, cut at `most` rows."""
    values = keys.to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        for i in range(a, b, most):
            yield int(values[i]), range(i, min(i + most, b))


def _list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.concat_arrays([values]))


def cell_sizes(index: VectorIndex) -> DataFrame:
    """(cell, n, blocks): leaves and blocks of each cell, as many rows as the model has cells at most."""
    return index.blocks.groupBy("cell").agg(F.sum(F.size("nodes")).alias("n"), F.count("*").alias("blocks"))


def _sizes(index: VectorIndex, model: Model) -> np.ndarray:
    out = np.zeros(len(model.cells), np.int64)
    for row in cell_sizes(index).collect():
        out[row.cell] = row.n
    return out


def _looked_into(vectors: np.ndarray, cells: np.ndarray, sizes: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a vector and a cell that it looks into, the nearest cells first."""
    order = np.argsort(-(vectors @ cells.T), axis=1, kind="stable")
    held = np.cumsum(sizes[order], axis=1)
    first = held == sizes[order]  # nothing before it
    row, at = np.nonzero((sizes[order] > 0) & (first | (held <= share * sizes.sum())))
    return row, order[row, at]


def probes(index: VectorIndex, queries: DataFrame, share: float = SHARE) -> DataFrame:
    """(query_id, embedding, cell, n): the cells that each query looks into, nearest first, while they hold no more than `share` of all leaves together; its nearest cell always."""
    model = index.model()
    kind = queries.schema["query_id"].dataType.simpleString()
    out = f"query_id {kind}, embedding array<float>, cell int, n bigint"
    if model is None:
        return index.spark.createDataFrame([], out)
    sent = index.spark.sparkContext.broadcast((model.cells, _sizes(index, model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, n = sent.value
        for batch in batches:
            for i in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(i, AT_ONCE)
                row, cell = _looked_into(unit(part.column("embedding")), cells, n, share)
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column("query_id").take(taken), part.column("embedding").take(taken), pa.array(cell, pa.int32()), pa.array(n[cell])], names=["query_id", "embedding", "cell", "n"])

    return _usable(queries, "query_id", model.width).mapInArrow(run, out)


class _Best:
    """The `most` best leaves so far of each query of a pack. Leaves come in the order of their places; of those with equal scores the first are kept."""

    #: Scores count in steps of 1 / STEPS, as steps below TOP, which fit into STEP_BITS; numbers of rows that are sorted together into ROW_BITS.
    STEPS, TOP, STEP_BITS, ROW_BITS = 1e5, 4.0, 20, 28

    def __init__(self, most: int, vectors: np.ndarray, looks: np.ndarray) -> None:
        """looks: (cells, queries), whether the query looks into the cell."""
        self.most, self.vectors, self.looks = most, vectors, looks
        self.least = np.full(len(vectors), -np.inf, np.float32)  # what a score must be above
        self.keys: list[np.ndarray] = []  # query, then steps below TOP
        self.places: list[np.ndarray] = []
        self.size = self.held = 0
        self.room = np.empty(TILE * LEAVES, np.float32)

    def add(self, cell: int, place: int, leaves: np.ndarray) -> None:
        """Leaves of one cell, the first of which has this place."""
        mine = np.flatnonzero(self.looks[cell])
        for i in range(0, len(mine), TILE):
            asks = mine[i : i + TILE]
            vectors = self.vectors[asks]
            for j in range(0, len(leaves), LEAVES):
                part = leaves[j : j + LEAVES]
                self._tile(asks, place + j, np.matmul(vectors, part.T, out=self.room[: len(asks) * len(part)].reshape(len(asks), len(part))))

    def _tile(self, asks: np.ndarray, place: int, scores: np.ndarray) -> None:
        some = np.flatnonzero(scores.max(axis=1) > self.least[asks])
        if not len(some):
            return
        if len(some) < len(asks):
            asks, scores = asks[some], scores[some]
        at = np.flatnonzero(scores > self.least[asks][:, None])
        row = at // scores.shape[1]
        steps = np.clip(np.rint((self.TOP - scores.ravel()[at].astype(np.float64)) * self.STEPS), 0, (1 << self.STEP_BITS) - 1).astype(np.int64)
        self.keys.append(asks[row] << self.STEP_BITS | steps)
        self.places.append(place + at - row * scores.shape[1])
        self.size += len(at)
        if self.size - self.held > max(self.most * len(self.vectors) // 2, 1 << 18):
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray]:
        """Queries and places of what is kept."""
        if not self.keys:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        key, place = np.concatenate(self.keys), np.concatenate(self.places)
        self.keys.clear()
        self.places.clear()
        key <<= self.ROW_BITS
        key |= np.arange(len(key))
        key.sort()
        begin = np.searchsorted(key, np.arange(len(self.vectors) + 1) << (self.STEP_BITS + self.ROW_BITS))
        kept = np.minimum(np.diff(begin), self.most)
        full = np.flatnonzero(kept == self.most)
        steps = key[begin[full] + self.most - 1] >> self.ROW_BITS & ((1 << self.STEP_BITS) - 1)
        self.least[full] = self.TOP - (steps - 0.5) / self.STEPS
        key = key[np.repeat(begin[:-1] - np.cumsum(kept) + kept, kept) + np.arange(kept.sum())]
        place = place[key & ((1 << self.ROW_BITS) - 1)]
        key >>= self.ROW_BITS
        self.keys.append(key)
        self.places.append(place)
        self.size = self.held = len(key)
        return key >> self.STEP_BITS, place


def _gathered(index: VectorIndex, schema: str) -> DataFrame:
    """(row, cells, nodes, codes): all leaves in the order of cell and node_id, in rows of LEAVES * BLOCKS at most whose numbers ascend. cells: each cell and how many leaves of it follow."""
    kind = index.blocks.schema["nodes"].dataType.elementType.simpleString()
    total = index.blocks.agg(F.sum(F.size("nodes"))).first()[0] or 0

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column("nodes").flatten()
            if len(nodes):
                cells = np.repeat(batch.column("cell").to_numpy(), pc.list_value_length(batch.column("nodes")).to_numpy())
                codes = b"".join(batch.column("codes").to_pylist())
                each = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(codes) // len(nodes)), len(nodes), [None, pa.py_buffer(codes)])
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), nodes, each.cast(pa.binary())], names=["cell", "node", "code"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, size, most = TaskContext.get().partitionId() << 32, [], 0, LEAVES * BLOCKS

        def row() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            cells = table.column("cell").to_numpy()
            first = np.flatnonzero(np.diff(cells, prepend=-1))
            runs = np.stack([cells[first], np.diff(first, append=len(cells))], axis=1).astype(np.int32)
            codes = b"".join(table.column("code").to_pylist())
            return pa.RecordBatch.from_arrays([pa.array([made], pa.int64()), pa.array([runs.tobytes()], pa.binary()), _list(table.column("node").combine_chunks()), pa.array([codes], pa.binary())], names=["row", "cells", "nodes", "codes"])

        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, most - size))
                size += held[-1].num_rows
                batch = batch.slice(held[-1].num_rows)
                if size == most:
                    yield row()
                    made, held, size = made + 1, [], 0
        if held:
            yield row()

    flat = index.blocks.mapInArrow(leaves, f"cell int, node {kind}, code binary")
    return flat.repartitionByRange(max(1, -(-total // TASK)), "cell", "node").sortWithinPartitions("cell", "node").mapInArrow(gather, schema)


def _packs(total: int, cores: int) -> int:
    """Packs of so many queries: as many for each core, three quarters full at most, since ranges are not quite equal; few queries make few."""
    waves = max(2, -(-total * 4 // (3 * QUERIES * cores)))
    return max(1, min(cores * waves, max(-(-total // 64), -(-total * 4 // (3 * QUERIES)))))


def ask_vectors(index: VectorIndex, queries: DataFrame, leaves: DataFrame, k: int, share: float = SHARE, refine: int = REFINE) -> DataFrame:
    """(query_id, node_id, score, rank): about the k leaves of greatest cosine to each query; scores are exact, ties by node_id.

    queries: (query_id, embedding); rows without id or without whole vector of the index's width find nothing; of a repeated query_id the smallest vector asks.
    leaves: what the index was made of; of a repeated node_id each row can be found. Each pack of queries meets each row of leaves in its own task, which keeps refine * k of each
    query; nothing passes through the driver but the cells' sizes and the packs' numbers.
    """
    model = index.model()
    kinds = queries.schema["query_id"].dataType.simpleString(), leaves.schema["node_id"].dataType.simpleString()
    none = index.spark.createDataFrame([], f"query_id {kinds[0]}, node_id {kinds[1]}, score double, rank int")
    if model is None:
        return none
    sent = index.spark.sparkContext.broadcast((model, _sizes(index, model)))
    most, each = refine * k, LEAVES * BLOCKS
    scratch = Scratch(index.spark, "vectors")
    asked = scratch.keep(_usable(queries, "query_id", model.width).groupBy("query_id").agg(F.min("embedding").alias("embedding")))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value[0].nearest(unit(batch.column("embedding"))), pa.int32())], names=["query_id", "embedding", "cell"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (model, n), made = sent.value, TaskContext.get().partitionId()
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def row() -> pa.RecordBatch:
            ids, vectors, looks = (list(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([made], pa.int64()), _list(pa.concat_arrays(ids)), pa.array([np.concatenate(vectors).tobytes()], pa.binary()), pa.array([np.concatenate(looks).tobytes()], pa.binary())], names=["pack", "queries", "vectors", "looks"])

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, min(AT_ONCE, QUERIES - sum(len(x[1]) for x in held)))
                vectors = unit(part.column("embedding"))
                looks = np.zeros((len(vectors), len(model.cells)), bool)
                looks[_looked_into(vectors, model.cells, n, share)] = True
                held.append((part.column("query_id"), vectors, np.packbits(looks, axis=1)))
                batch = batch.slice(part.num_rows)
                if sum(len(x[1]) for x in held) == QUERIES:
                    yield row()
                    made, held = made + parts, []
        if held:
            yield row()

    parts = _packs(asked.count(), index.spark.sparkContext.defaultParallelism)
    near = asked.mapInArrow(nearest, f"query_id {kinds[0]}, embedding array<float>, cell int").repartitionByRange(parts, "cell", F.xxhash64("query_id"))
    packed = scratch.keep(near.mapInArrow(pack, f"pack bigint, queries array<{kinds[0]}>, vectors binary, looks binary"))
    packs = [r.pack for r in packed.select("pack").collect()]
    if not packs:
        return none
    rows = scratch.keep(_gathered(index, f"row bigint, cells binary, nodes array<{kinds[1]}>, codes binary"))

    def with_pack(own: DataFrame, others: DataFrame, order: str) -> DataFrame:
        """Each pack's own row, then the others that are for it. Both use the same columns, since Arrow takes long over columns that are mostly null."""
        both = own.unionByName(others)
        return both.repartitionById(parts, (F.col("pack") % parts).cast("int")).sortWithinPartitions("pack", order)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, best, pack = sent.value[0], None, None

        def kept() -> Iterator[pa.RecordBatch]:
            query, place = best.cut()
            order = np.argsort(place, kind="stable")
            query, place = query[order].astype(np.int32), place[order]
            first = np.flatnonzero(np.diff(place, prepend=-1))
            ends = np.append(first, len(place))
            for i in range(0, len(first), each):
                cuts = ends[i : i + each + 1]
                asks = pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(((cuts - cuts[0]) * 4).astype(np.int32)), pa.py_buffer(query[cuts[0] : cuts[-1]])])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(asks), pack)), pa.array(place[first[i : i + each]]), asks], names=["pack", "leaf", "asks"])

        for batch in batches:
            for i in range(batch.num_rows):
                row, codes = batch.column("row")[i].as_py(), batch.column("codes")[i].as_buffer()
                if row < 0:
                    if best is not None:
                        yield from kept()
                    pack, vectors = batch.column("pack")[i].as_py(), np.frombuffer(codes, np.float32).reshape(-1, model.width)
                    looks = np.frombuffer(batch.column("cells")[i].as_buffer(), np.uint8).reshape(len(vectors), -1)
                    best = _Best(most, vectors.copy(), np.ascontiguousarray(np.unpackbits(looks, axis=1, count=len(model.cells)).T).view(bool))
                    continue
                runs = np.frombuffer(batch.column("cells")[i].as_buffer(), np.int32).reshape(-1, 2)
                vectors = model.decode(np.repeat(runs[:, 0], runs[:, 1]), np.frombuffer(codes, np.uint8).reshape(runs[:, 1].sum(), -1))
                vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)  # as the leaves' own are; codes shorten them by different amounts
                at = 0
                for cell, n in runs.tolist():
                    best.add(cell, row * each + at, vectors[at : at + n])
                    at += n
        if best is not None:
            yield from kept()

    met = with_pack(packed.select("pack", F.lit(-1).cast("bigint").alias("row"), F.col("looks").alias("cells"), F.col("vectors").alias("codes")), rows.select(F.explode(F.lit(packs).cast("array<bigint>")).alias("pack"), "row", "cells", "codes"), "row")
    found = scratch.keep(met.mapInArrow(score, "pack bigint, leaf bigint, asks binary"))
    places = rows.select("row", F.posexplode("nodes").alias("at", "node_id")).select((F.col("row") * each + F.col("at")).alias("leaf"), "node_id")
    again = scratch.keep(places.groupBy("node_id").agg(F.min("leaf").alias("first"), F.count("*").alias("n")).where("n > 1"))
    repeated = not again.isEmpty()
    if repeated:  # all rows of a node_id have its first place
        firsts = places.join(again, "node_id").select("leaf", "first")
        found = found.join(firsts, "leaf", "left").groupBy("pack", F.coalesce("first", "leaf").alias("leaf")).agg(F.collect_list("asks").alias("all"))
        found = found.select("pack", "leaf", F.aggregate("all", F.lit(b""), lambda a, x: F.concat(a, x)).alias("asks"))
        places = places.join(firsts.where("leaf <> first"), "leaf", "left_anti")

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("node_id"), pa.array([v.tobytes() for v in unit(batch.column("embedding"))], pa.binary())], names=["node_id", "vector"])

    own = _usable(leaves, "node_id", model.width).mapInArrow(units, f"node_id {kinds[1]}, vector binary")
    vectors = own.join(places.hint("merge"), "node_id").select("leaf", "vector")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, own, norms = None, None, None
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def best() -> Iterator[pa.RecordBatch]:
            """The k best of each query, and what is as good as the last of them, since node_ids decide between those."""
            if held:
                query, leaf, score = (np.concatenate([h[i] for h in held]) for i in range(3))
                order = np.lexsort((-score, query))
                query, leaf, score = query[order], leaf[order], score[order]
                begin = np.searchsorted(query, np.arange(len(own) + 1))
                kept = np.flatnonzero(score >= score[np.minimum(begin[:-1] + k, begin[1:])[query] - 1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), pack)), pa.array(query[kept]), pa.array(leaf[kept]), pa.array(score[kept])], names=["pack", "query", "leaf", "score"])
                held.clear()

        for batch in batches:
            leaf, asks, vectors = batch.column("leaf").to_numpy(), batch.column("asks"), batch.column("vector")
            packs = np.flatnonzero(leaf < 0).tolist()
            for i, j in zip([0, *packs], [*packs, len(leaf)], strict=True):
                if i < len(leaf) and leaf[i] < 0:
                    yield from best()
                    pack, own = batch.column("pack")[i].as_py(), np.frombuffer(vectors[i].as_buffer(), np.float32).reshape(-1, model.width).astype(np.float64)
                    norms = np.linalg.norm(own, axis=1)
                    i += 1
                for a in range(i, j, AT_ONCE):
                    n = min(AT_ONCE, j - a)
                    theirs = np.frombuffer(b"".join(vectors.slice(a, n).to_pylist()), np.float32).reshape(n, -1).astype(np.float64)
                    lengths = np.linalg.norm(theirs, axis=1)
                    at = np.repeat(np.arange(n), pc.binary_length(asks.slice(a, n)).to_numpy() // 4)
                    query = np.frombuffer(b"".join(asks.slice(a, n).to_pylist()), np.int32)
                    if repeated:
                        at, query = (x.astype(np.int32) for x in np.divmod(np.unique(at * len(own) + query), len(own)))
                    for b in range(0, len(at), 1 << 14):
                        q, t = query[b : b + (1 << 14)], at[b : b + (1 << 14)]
                        held.append((q, leaf[a + t], np.round((theirs[t] * own[q]).sum(1) / np.maximum(lengths[t] * norms[q], 1e-12), 6)))
        yield from best()

    mine = with_pack(packed.select("pack", F.lit(-1).cast("bigint").alias("leaf"), F.lit(b"").alias("asks"), F.col("vectors").alias("vector")), found.join(vectors, "leaf").select("pack", "leaf", "asks", "vector"), "leaf")
    scored = mine.mapInArrow(exact, "pack bigint, query int, leaf bigint, score double").join(places.hint("merge"), "leaf")
    chosen = top_k(scored, k, ["pack", "query"], F.desc("score"), F.col("node_id"))
    names = packed.select("pack", F.posexplode("queries").alias("query", "query_id"))
    return chosen.join(names.hint("merge"), ["pack", "query"]).select("query_id", "node_id", "score", "rank")
