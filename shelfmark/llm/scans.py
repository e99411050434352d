"""Prefix sums over a whole sorted table, and ranks of a linked list, as Spark jobs in which no task and no driver holds a group.

`scan`: rows are sorted by range; every task runs over its rows with a carry of constant size; what is carried from one task's rows into
the next one's follows from one row a task.

`list_ranks`: links inside blocks of bounded size are followed first; what is left is a shorter list of pieces, from which
rounds take out every element whose hash is larger than those of both its neighbours (a third of them), until LAST are left and can be walked through. Then
the rounds are gone back, and each element taken out gets its place from the one before it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Elements of a block whose links one task follows together; elements that are walked through at the end, at most.
BLOCK, LAST = 1 << 12, 256


def _power(base: int, exponent: np.ndarray) -> np.ndarray:
    """base ** exponent in 64 bits."""
    out, square = np.ones(len(exponent), dtype=np.uint64), np.array([base], dtype=np.uint64)
    left = exponent.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * square, out)
        square = square * square
        left = left >> np.uint64(1)
    return out


def _folded(values: np.ndarray, base: int, place: np.ndarray, start: np.ndarray) -> np.ndarray:
    """h[i] = h[i - 1] * base + values[i] inside each group; start: the row at which a row's group begins."""
    if base == 0:
        return values
    inverse, n = np.uint64(pow(base, -1, 1 << 64)), len(values)
    down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, inverse, dtype=np.uint64))), dtype=np.uint64)
    total = np.cumsum(values * down, dtype=np.uint64)
    before = np.where(start > 0, total[start - 1], np.uint64(0))
    return (total - before) * _power(base, np.arange(n))


def _local(names: Sequence[str], bases: Sequence[int], group: str | None):
    """Adds part, first (is it in the task's first group?), at (the row's number in the task), place (in its group so far), and the folded values of each column before and with the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, leader, last = TaskContext.get().partitionId(), 0, None, None
        place, carry = 0, [np.uint64(0)] * len(names)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(group).to_numpy(zero_copy_only=False) if group else np.zeros(n, dtype=np.int64)
            if not seen:
                leader = last = keys[0]
                place, carry = 0, [np.uint64(0)] * len(names)
            edge = np.concatenate(([keys[0] != last], keys[1:] != keys[:-1]))
            start = np.maximum.accumulate(np.where(edge, np.arange(n), 0))
            goes_on = np.maximum.accumulate(edge) == 0
            places = np.arange(n) - start + 1 + np.where(goes_on, place, 0)
            columns = []
            for k, (name, base) in enumerate(zip(names, bases, strict=True)):
                values = batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                with_row = _folded(values, base, places, start)
                if base:
                    with_row = with_row + np.where(goes_on, carry[k] * _power(base, np.arange(1, n + 1)), np.uint64(0))
                earlier = np.concatenate(([np.uint64(0) if edge[0] else carry[k]], np.where(edge[1:], np.uint64(0), with_row[:-1])))
                carry[k] = with_row[-1]
                columns += [earlier.view(np.int64), with_row.view(np.int64)]
            place, last = int(places[-1]), keys[-1]
            extra = [np.full(n, part, dtype=np.int64), keys == leader, np.arange(seen, seen + n), places.astype(np.int64), *columns]
            seen += n
            yield pa.RecordBatch.from_arrays(batch.columns + [pa.array(x) for x in extra], names=batch.schema.names + _added(names))

    return run


def _added(names: Sequence[str]) -> list[str]:
    return ["part", "first", "at", "place"] + [f"{n}_{side}" for n in names for side in ("before", "with")]


def _carried(names: Sequence[str], bases: Sequence[int], carries: dict[int, tuple[int, list[int]]]):
    """Adds to the rows of each task's first group what earlier tasks found in that group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            parts, first = (columns[c].to_numpy(zero_copy_only=False) for c in ("part", "first"))
            place = columns["place"].to_numpy(zero_copy_only=False).copy()
            found = {c: columns[c].to_numpy(zero_copy_only=False).view(np.uint64).copy() for c in _added(names)[4:]}
            for p in np.unique(parts):
                if p not in carries:
                    continue
                rows = np.flatnonzero((parts == p) & first)
                own = place[rows]
                for name, base, value in zip(names, bases, carries[p][1], strict=True):
                    found[f"{name}_before"][rows] += np.uint64(value) * _power(base, own - 1)
                    found[f"{name}_with"][rows] += np.uint64(value) * _power(base, own)
                place[rows] += carries[p][0]
            columns |= {c: pa.array(x.view(np.int64)) for c, x in found.items()} | {"place": pa.array(place)}
            keep = [c for c in columns if c not in ("part", "first", "at")]
            yield pa.RecordBatch.from_arrays([columns[c] for c in keep], names=keep)

    return run


def scan(df: DataFrame, order: Sequence[str | Column], sums: dict[str, int], scratch: Scratch, group: str | None = None) -> DataFrame:
    """df in the given order with, for each row, `place` (1, 2, ... in its group) and, for each column c of `sums`, c_before and c_with.

    c_with[i] = c_with[i - 1] * base + c[i] in 64 bits inside a group, c_before[i] = c_with[i - 1] (0 for the first row); sums gives each column's base. Base 1 makes prefix
    sums, an odd base hashes of what came so far, base 0 the value before. The columns of sums are integers without nulls. order begins with the group's column, which has
    no nulls. A group may have any number of rows: what passes through the driver is one row for each task.
    """
    names, bases = list(sums), list(sums.values())
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    more = "place bigint, " + ", ".join(f"{n}_{side} bigint" for n in names for side in ("before", "with"))
    local = df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_local(names, bases, group), f"{kinds}, part bigint, first boolean, at bigint, {more}")
    local = scratch.keep(local)
    key = F.col(group) if group else F.lit(0)
    ends = local.groupBy("part").agg(F.max_by(F.struct(key.alias("key"), "first", "place", *[f"{n}_with" for n in names]), "at").alias("end"), F.min_by(key, "at").alias("leader")).orderBy("part").collect()  # a row a task
    carries: dict[int, tuple[int, list[int]]] = {}
    last, place, values = None, 0, [0] * len(names)
    for row in ends:
        end = row["end"]
        here = [end[f"{n}_with"] % (1 << 64) for n in names]
        goes_on = last is not None and row["leader"] == last
        if goes_on:
            carries[row["part"]] = (place, list(values))
        if goes_on and end["first"]:
            values = [(v * pow(b, end["place"], 1 << 64) + h) % (1 << 64) for v, b, h in zip(values, bases, here, strict=True)]
            place += end["place"]
        else:
            values, place = here, end["place"]
        last = end["key"]
    return local.mapInArrow(_carried(names, bases, carries), f"{kinds}, {more}")


def _followed(rows: pd.DataFrame) -> pd.DataFrame:
    """The links inside a block followed: each element's head (the first of its piece), its place behind the head, and for a piece's last element where the list goes on."""
    ids, links = rows["id"].to_numpy(), rows["next"].to_numpy(dtype=np.float64, na_value=np.nan)
    order = np.argsort(ids)
    ids, following = ids[order], np.where(np.isnan(links), -1, rows["next"].fillna(-1).to_numpy(dtype=np.int64))[order]
    at = np.minimum(np.searchsorted(ids, following), len(ids) - 1)
    inside = ids[at] == following
    head, far = np.arange(len(ids)), np.zeros(len(ids), dtype=np.int64)
    head[at[inside]] = np.flatnonzero(inside)
    far[at[inside]] = 1
    while True:
        further = head[head]
        if (further == head).all():
            break
        far, head = far + far[head], further
    return pd.DataFrame({"id": ids, "head": ids[head], "far": far, "ends": ~inside, "next": pd.array(following, dtype="Int64").copy()})


def list_ranks(links: DataFrame, scratch: Scratch, block: int = BLOCK, last: int = LAST) -> DataFrame:
    """(id, rank): the place (0, 1, ...) of each element of one linked list, given as (id, next) of whole numbers from 0 on, next null at the end.

    Elements whose numbers are near should often follow each other: that makes the list of pieces short, and nothing but the time depends on it. An empty list gives no rows.
    """
    kind = "id bigint, head bigint, far bigint, ends boolean, next bigint"
    inside = scratch.keep(links.groupBy(F.floor(F.col("id") / block).alias("block")).applyInPandas(_followed, kind))
    ended = F.when(F.col("next") >= 0, F.col("next"))
    pieces = scratch.keep(inside.where("ends").select(F.col("head").alias("id"), ended.alias("next"), (F.col("far") + 1).alias("length")))
    out = []  # of each round: elements taken out, the one before each, and how far it is
    for turn in count():
        n = pieces.count()
        if n <= last:
            break
        chance = lambda c, turn=turn: F.xxhash64(F.lit(turn), c)
        peaks = pieces.where(F.col("next").isNull() | (chance("id") > chance("next"))).select(F.col("id").alias("next"), F.col("next").alias("after"), F.col("length").alias("more"))
        climbing = F.when(chance("id") < chance("next"), F.col("next"))
        joined = pieces.select("id", F.col("next").alias("following"), "length", climbing.alias("next")).join(peaks, "next", "left")
        joined = scratch.keep(joined.select("id", "following", "length", F.col("more").isNotNull().alias("takes"), "after", "more"))
        taken = joined.where("takes").select(F.col("following").alias("id"), F.col("id").alias("before"), F.col("length").alias("behind"))
        out.append(taken)
        stay = joined.join(taken.select("id"), "id", "left_anti")
        pieces = scratch.keep(stay.select("id", F.when(F.col("takes"), F.col("after")).otherwise(F.col("following")).alias("next"), (F.col("length") + F.coalesce("more", F.lit(0))).alias("length")))
    left = {r["id"]: (r["next"], r["length"]) for r in pieces.collect()}  # LAST rows at most
    heads = left.keys() - {following for following, _ in left.values()}
    here, far, places = next(iter(heads), None), 0, []
    while here is not None:
        places.append((here, far))
        here, far = left[here][0], far + left[here][1]
    ranks = links.sparkSession.createDataFrame(places, "id bigint, rank bigint")
    for taken in reversed(out):
        placed = taken.join(ranks.select(F.col("id").alias("before"), "rank"), "before").select("id", (F.col("rank") + F.col("behind")).alias("rank"))
        ranks = scratch.keep(ranks.union(placed))
    return inside.select("id", "head", "far").join(ranks.withColumnRenamed("id", "head"), "head").select("id", (F.col("rank") + F.col("far")).alias("rank"))
