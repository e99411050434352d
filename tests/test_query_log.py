import datetime as dt
import random
from collections import Counter

import pandas as pd

from shelfmark.operators import stats
from shelfmark.streaming import query_log as Q

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "created_at timestamp, query string, result_count int, latency_ms double"


def run(spark, folder, batches, **options):
    """The last sketches after the batches, each a file of its own, and what was left out as late."""
    (folder / "in").mkdir()
    stream = Q.query_sketches_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "in")), **options)
    query = None
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        if query is None:
            query = stream.writeStream.outputMode("update").foreachBatch(Q.keep_sketches(str(folder / "out"))).option("checkpointLocation", str(folder / "c")).start()
        query.processAllAvailable()
    kept = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    query.stop()
    return Q.last_sketches(spark.read.parquet(str(folder / "out"))), kept


def log(n, queries, seed, day=0):
    rng = random.Random(seed)
    return [(T0 + dt.timedelta(days=day, seconds=rng.randrange(86_000)), rng.choice(["  ", ""]) + f"q{min(int(rng.paretovariate(0.7)), queries)} ", rng.randrange(3), rng.choice([None, 5.0, 11.0])) for _ in range(n)]


def test_the_view_equals_its_batch_twin(spark, tmp_path):
    batches = [log(300, 40, 1), log(200, 40, 2), [(T0, "  ", 0, 1.0), (T0, None, 0, 1.0)]]
    sketches, _ = run(spark, tmp_path, batches)
    table = Q.capture_queries(spark.createDataFrame(sum(batches, []), SCHEMA))
    assert Q.live_kpis(sketches).collect() == stats.query_kpis(table, "2024-01-31 00:00:00", 60).collect()
    rows = lambda df, *c: [tuple(r[x] for x in c) for r in df.collect()]
    assert rows(Q.live_top_queries(sketches, 9), "query", "n", "avg_hits") == rows(stats.top_queries(table, 9), "query", "n", "avg_hits")
    assert rows(Q.live_zero_queries(sketches, 9), "query", "n", "error") == [(*r, 0) for r in rows(stats.zero_queries(table, 9), "query", "n")]
    assert Q.live_distinct(sketches).first()[0] == table.select("query").distinct().count()


def test_small_sketches_stay_within_their_bound(spark, tmp_path):
    batches = [log(800, 10**6, k) for k in range(3)]
    sketches, _ = run(spark, tmp_path, batches, parts=2, capacity=12, kept=64)
    true = Counter(q.strip() for rows in batches for _, q, _, _ in rows)
    found = Q.live_top_queries(sketches, 1000).collect()
    assert len(found) <= 24 and all(r.n <= true[r["query"]] <= r.n + r.error for r in found)
    errors = {r.part: r.error for r in sketches.groupBy("part").agg({"error": "sum"}).withColumnRenamed("sum(error)", "error").collect()}
    assert all(e <= 2400 / 12 for e in errors.values())
    listed = {r["query"] for r in found}
    assert all(n <= max(errors.values()) for q, n in true.items() if q not in listed)
    assert abs(Q.live_distinct(sketches, 64).first()[0] - len(true)) < 0.4 * len(true)


def test_late_rows_and_old_days(spark, tmp_path):
    day = lambda n, q: [(T0 + dt.timedelta(days=n, hours=1), q, 1, 1.0)]
    sketches, kept = run(spark, tmp_path, [day(0, "a"), day(5, "b"), day(6, "c"), day(0, "late"), day(7, "d")])
    assert {r["query"] for r in Q.live_top_queries(sketches, 9).collect()} == {"a", "b", "c", "d"}
    assert kept <= 3  # the states of days that are over are gone


def test_merging_is_bounded_and_commutes():
    a, b = (pd.DataFrame({"query": list(q), "n": n, "hits": n}) for q, n in (("abcd", [9, 7, 2, 1]), ("aefb", [1, 5, 1, 1])))
    one, e1 = Q.merged(*Q.merged([], a, 0, 3)[:1], b, Q.merged([], a, 0, 3)[1], 3)
    two, e2 = Q.merged(*Q.merged([], b, 0, 3)[:1], a, Q.merged([], b, 0, 3)[1], 3)
    for items, error in ((one, e1), (two, e2)):
        assert len(items) <= 3 and all(n <= {"a": 10, "b": 8, "e": 5}[q] <= n + error for q, n, _, _ in items)


def test_an_empty_view(spark, tmp_path):
    sketches, _ = run(spark, tmp_path, [log(1, 1, 1), log(1, 1, 2)])
    none = sketches.limit(0)
    assert Q.live_kpis(none).collect() == [(0, 0, 0.0, 0)] and Q.live_distinct(none).first()[0] == 0 and Q.live_top_queries(none, 3).count() == 0
