"""A live view of the query log: totals, most frequent queries, those without result, and different queries, from sketches of bounded size in a stream's state.

The log is dealt by day and by a hash of the query, so that a query lies in one part of a day. A part's sketch has at most CAPACITY queries (and as many without result): when there are more, all lose
the count of the largest one that has to go, so that a count is never too high, and too low by `error` at most, which is at most the part's rows / CAPACITY. A day with fewer queries a part is exact. Sketches are merged by
adding them up. Different queries are counted by the KEPT smallest hashes (exactly up to so many a part, else with a standard error of 1 / sqrt(KEPT)).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import capture_queries

#: Parts of a day, queries of a part's sketch, hashes kept for counting different ones.
PARTS, CAPACITY, KEPT = 16, 512, 256

_ITEM = "array<struct<query:string,n:bigint,seen:bigint,hits:bigint>>"
_FIELDS = f"total bigint, zero bigint, latency_sum double, latency_n bigint, hashes array<bigint>, items {_ITEM}, error bigint, zero_items {_ITEM}, zero_error bigint"
_NEW = (0, 0, 0.0, 0, [], [], 0, [], 0)


def merged(items: list[tuple], rows: pd.DataFrame, error: int, capacity: int) -> tuple[list[tuple], int]:
    """A sketch [(query, n, seen, hits)] with rows (query, n, hits) added, and its error."""
    held = {q: [n, seen, hits] for q, n, seen, hits in items}
    for q, n, hits in zip(rows["query"], rows["n"], rows["hits"], strict=True):
        old = held.setdefault(q, [0, 0, 0])
        old[0] += int(n)
        old[1] += int(n)
        old[2] += int(hits)
    if len(held) > capacity:
        least = sorted((v[0] for v in held.values()), reverse=True)[capacity]
        held = {q: [v[0] - least, v[1], v[2]] for q, v in held.items() if v[0] > least}
        error += least
    return [(q, *v) for q, v in sorted(held.items())], error


def _update(capacity: int, kept: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()  # the day is over, and its last sketch has been written
            return
        total, zero, latency, timed, hashes, items, error, zeros, zero_error = state.get if state.exists else _NEW
        items, zeros, hashes = [tuple(x) for x in items], [tuple(x) for x in zeros], set(hashes)
        for rows in batches:
            none = rows["result_count"] == 0
            total, zero = total + len(rows), zero + int(none.sum())
            latency, timed = latency + float(rows["latency_ms"].sum()), timed + int(rows["latency_ms"].notna().sum())
            hashes = set(sorted(hashes | set(rows["hash"].tolist()))[:kept])
            count = lambda x: x.groupby("query").agg(n=("hash", "size"), hits=("result_count", "sum")).reset_index()
            items, error = merged(items, count(rows), error, capacity)
            zeros, zero_error = merged(zeros, count(rows[none]), zero_error, capacity)
        now = (total, zero, latency, timed, sorted(hashes), items, error, zeros, zero_error)
        state.update(now)
        state.setTimeoutTimestamp(max(int(pd.Timestamp(key[0]).timestamp() * 1000) + 86_400_000, state.getCurrentWatermarkMs() + 1))
        names = [f.split()[0] for f in _FIELDS.split(", ")]
        yield pd.DataFrame([dict(zip(["day", "part", *names], [*key, *now], strict=True))])

    return run


def query_sketches_stream(log: DataFrame, late: str = "25 hours", parts: int = PARTS, capacity: int = CAPACITY, kept: int = KEPT) -> DataFrame:
    """A stream of (day, part, sketch): each row takes the place of the one before of its day and part.

    log: a stream of (created_at TIMESTAMP, query, result_count, latency_ms[, ...]). Queries are trimmed and cut, blank ones dropped. late: how long after its end
    a day takes rows, counted from the end of the newest row's day; later ones are left out, and the day's state goes. A null result_count is no result at all: it counts as one that isn't 0, with 0 hits.
    """
    day = F.date_trunc("day", "created_at")
    rows = capture_queries(log).withColumn("until", day + F.make_dt_interval(days=F.lit(1))).withWatermark("until", late)
    hash_ = F.xxhash64("query")
    rows = rows.select("until", day.alias("day"), F.pmod(hash_, F.lit(parts)).cast("int").alias("part"), "query", hash_.alias("hash"), F.coalesce(F.col("result_count"), F.lit(-1)).cast("bigint").alias("result_count"), F.col("latency_ms").cast("double").alias("latency_ms"))
    rows = rows.groupBy("day", "part")
    return rows.applyInPandasWithState(_update(capacity, kept), f"day timestamp, part int, {_FIELDS}", _FIELDS, "update", "EventTimeTimeout")


def keep_sketches(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch: each batch's sketches in a folder of its own under path; a batch that is written again takes its own place."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def last_sketches(written: DataFrame) -> DataFrame:
    """The last sketch of each day and part, from what `keep_sketches` wrote (read with the column `batch`)."""
    names = [c for c in written.columns if c not in {"day", "part", "batch"}]
    return written.groupBy("day", "part").agg(F.max_by(F.struct(*names), "batch").alias("last")).select("day", "part", "last.*")


def live_kpis(sketches: DataFrame) -> DataFrame:
    """One row, as `query_kpis` has it, with the number of different queries: exact totals of the given days."""
    out = sketches.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "zero", "latency_sum", "latency_n")])
    rate = F.when(F.col("total") > 0, F.round(F.col("zero") / F.col("total"), 4)).otherwise(0.0)
    mean = F.when(F.col("latency_n") > 0, F.round(F.col("latency_sum") / F.col("latency_n"))).otherwise(0)
    return out.select("total", "zero", rate.alias("zero_rate"), mean.cast("long").alias("avg_latency_ms"))


def live_distinct(sketches: DataFrame, kept: int = KEPT) -> DataFrame:
    """(queries): how many different ones, by the smallest hashes of each part over all days."""
    smallest = F.slice(F.array_sort(F.collect_set("hash")), 1, kept)
    # a part has `kept` hashes a day at most
    parts = sketches.select("part", F.explode("hashes").alias("hash")).groupBy("part").agg(smallest.alias("all"))
    share = (F.element_at("all", -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return parts.agg(F.coalesce(F.round(F.sum(F.when(F.size("all") < kept, F.size("all").cast("double")).otherwise((kept - 1) / share))), F.lit(0.0)).cast("long").alias("queries"))


def _items(sketches: DataFrame, column: str, error: str) -> DataFrame:
    wrong = sketches.groupBy("part").agg(F.sum(error).alias("error"))
    found = sketches.select("part", F.inline(column)).groupBy("part", "query").agg(*[F.sum(c).alias(c) for c in ("n", "seen", "hits")])
    return found.join(wrong, "part")


def live_top_queries(sketches: DataFrame, k: int) -> DataFrame:
    """(query, n, avg_hits, error): as `top_queries`; the true count is n at least and n + error at most. A query that isn't listed has at most the error of its part, if the last one listed has more."""
    return _items(sketches, "items", "error").select("query", "n", F.round(F.col("hits") / F.col("seen"), 1).alias("avg_hits"), "error").orderBy(F.desc("n"), "query").limit(k)


def live_zero_queries(sketches: DataFrame, k: int) -> DataFrame:
    """(query, n, error): as `zero_queries`, with the same bound."""
    return _items(sketches, "zero_items", "zero_error").select("query", "n", "error").orderBy(F.desc("n"), "query").limit(k)
