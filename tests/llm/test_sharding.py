import zlib
from collections import Counter

from shelfmark.llm import sharding as S


def test_places_are_whole_and_even(spark):
    rows = [(i, None if i % 50 == 0 else f"text é {i % 7}", "x") for i in range(1003)] + [(None, "no id", "x")] * 3 + [(5, "same", "x")] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    out = S.assign_shards(docs).collect()
    assert len(out) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(8))
    for shard, n in sizes.items():
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(n))
    assert {r.law for r in out} == {"rows"} and {r.grown_shard for r in out} == {None}


def test_order_is_random_but_the_same_each_time(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "cast(id AS string) AS text").coalesce(3)
    a, b = ({r.doc_id: (r.shard, r.slot) for r in S.assign_shards(docs).collect()} for _ in range(2))
    assert a == b
    order = sorted(a, key=lambda k: (a[k][1], a[k][0]))
    assert sum(x < y for x, y in zip(order, order[1:], strict=False)) in range(900, 1100)


def test_buckets_follow_bytes_and_whole_records_are_written(spark, tmp_path):
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat('x', cast(id AS int)) AS text", "id AS slot")
    S.write_shards(docs, str(tmp_path / "out"), shards=4, bucket_bytes=1000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 300 and back.select("record.doc_id").distinct().count() == 300
    assert sorted(r["count"] for r in back.groupBy("shard").count().collect()) == [75] * 4


def test_empty_table(spark):
    assert S.assign_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_places_are_those_of_whole_documents_in_the_written_shards(spark):
    docs = spark.range(200).selectExpr("id AS doc_id", "repeat('long text ', cast(id AS int)) AS text", "concat('s', id) AS source")
    out = S.assign_shards(docs, shards=4, bucket_bytes=1000)
    files = out.inputFiles()
    assert files and all("/shard=" in f for f in files)
    folder = files[0].rsplit("/", 2)[0]
    written = spark.read.parquet(folder).select("record.*", "shard", "slot").collect()
    assert sorted((r.doc_id, r.text, r.source) for r in written) == sorted(map(tuple, docs.collect()))
    assert {(r.doc_id, r.shard, r.slot) for r in written} == {(r.doc_id, r.shard, r.slot) for r in out.collect()}


def test_columns_without_order_and_very_long_texts(spark):
    rows = [(i, "x" * (2_000_000 if i == 7 else i), {"k": i}, [{"a": [i]}]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot map<string,int>, shard array<struct<a:array<int>>>")
    out = S.assign_shards(docs).collect()
    assert sorted(r.doc_id for r in out) == list(range(40)) and sorted((r.shard, r.slot) for r in out) == [(s, k) for s in range(8) for k in range(5)]
    assert next(r["size"] for r in out if r.doc_id == 7) == 2_000_001
