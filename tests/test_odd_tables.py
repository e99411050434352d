"""Queries against their SQL on tables of odd rows, and steps whose time must stay in proportion to a text."""

import datetime as dt
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.operators import chunking as K
from shelfmark.operators import retrieval as R
from shelfmark.operators.keyword_index import build_index
from shelfmark.queries import ORACLES, QUERIES
from shelfmark.streaming import jobs as J
from shelfmark.streaming import progress as P


def both(spark, folder, name, **tables):
    """The rows of a query and of its SQL over tables (rows, schema)."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    found = QUERIES[name](spark, str(folder)).select(*columns)
    return sorted(map(tuple, found.collect()), key=str), sorted(result.fetchall(), key=str)


def test_titles_with_cut_references(spark, tmp_path):
    heads = ["The&amp;&amp;&amp", "A &quot;b&quot; &quot", "x &ampy; &amp;lt; &lt; z", "&amp;quot;", "1 & 2"]
    pages = [(i, f"<html><body><ul><li>m</li></ul><h1>{h}</h1><p>text</p></body></html>") for i, h in enumerate(heads)]
    found, expected = both(spark, tmp_path, "a4_html_titles", pages=(pages, "page_id long, html string"))
    assert found == expected and len(found) == len(heads)


def test_structure_of_one_long_line_and_of_marks_without_partner(spark, tmp_path):
    """A line of a million characters without a bar took the square of its length."""
    texts = ["ab " * 333_333, "x | y\n" + "ab " * 100_000 + "\n p|q \n\n|", "| " + " " * 100_000 + "z", "\n\n|a|\nb\n"]
    docs = ([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found, expected = both(spark, tmp_path, "k1_split_structure", documents=docs)
    assert found == expected
    marks = [("a", "[TABLE_START]" * 50_000 + "t"), ("b", "x[TABLE_END]" * 50_000), ("c", "[TABLE_START] 1" + " " * 100_000 + "2 [TABLE_END]"), ("d", "[TABLE_START]" * 20_000 + "y[TABLE_END] [TABLE_START]z"), ("e", None), ("f", " \n")]
    rows = {r.file_id: (r.text, r.is_table) for r in K.split_structure(spark.createDataFrame(marks, "file_id string, text string")).where("seg < 2 OR is_table").orderBy("file_id", "seg").collect()}
    assert rows["a"] == (marks[0][1], False) and rows["b"] == (marks[1][1], False) and rows["c"] == ("1" + " " * 100_000 + "2", True)
    assert rows["d"] == ("[TABLE_START]" * 19_999 + "y", True) and not {"e", "f"} & set(rows)


def test_text_functions_equal_their_definition(spark):
    """Each function against the plain patterns, over texts of blanks, marks, ideographs and noise."""
    rng = random.Random(4)
    parts = ["a", " ", "\n", "　", " ", "\x1c", "​", "会议", "語", "打賞支持本欄目", "由志願者提供", "感謝觀看這", "订阅", "作词曲", "词 · 作曲 编曲 甲", "请订阅我的频道", "字幕由 x Amara y", "你好吗你好吗你好吗", "```", "\n```py\n", "#", "→", "x" * 41, "😀"]
    rows = ["".join(rng.choices(parts, k=rng.randrange(9))) for _ in range(600)] + ["", None, " " * 200_000 + "a" + " " * 200_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    t, cjk = F.col("t"), r"\x{4e00}-\x{9fff}"
    blanks = r"[\s\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{001c}-\x{001f}]"
    n = F.length(F.regexp_replace(t, f"[^{cjk}]", ""))
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(t, F.lit("")), r"[\x{200b}\x{200c}\x{200d}\x{feff}]", ""), rf"^{blanks}++|(?<!{blanks}){blanks}++$", "")
    body = F.regexp_replace(F.regexp_replace(bare, T.FENCE, ""), T.STRUCTURE, "")
    noise, text = F.lit(0), t
    for pattern in T.NOISE:
        noise, text = noise + F.regexp_count(text, F.lit(pattern)), F.regexp_replace(text, pattern, "")
    plain = {
        "tokens": F.floor(F.lit(1.5) * n + F.lit(0.3) * (F.length(t) - n)).cast("int"), "low": (F.length(bare) == 0) | (F.length(body) == 0) | (bare.rlike(T.FENCE) & (F.length(body) < 40)),
        "ratio": F.when(n == 0, 0.0).otherwise(F.length(F.regexp_replace(t, f"[^{T.SIMPLIFIED}]", "")) / n), "clean": F.regexp_replace(text, T.REPEATED, "$1"), "least": noise, "strip": F.length(bare),
    }
    cleaned = T.clean_transcript(t)
    ours = {"tokens": T.estimate_tokens(t), "low": T.is_low_value(t), "ratio": T.simplified_ratio(t), "clean": cleaned["text"], "least": F.when(text == cleaned["text"], cleaned["n"]).otherwise(noise), "strip": F.length(T.strip(F.regexp_replace(F.coalesce(t, F.lit("")), r"[\x{200b}\x{200c}\x{200d}\x{feff}]", "")))}
    out = df.select("i", *[c.alias(f"p_{k}") for k, c in plain.items()], *[c.alias(f"o_{k}") for k, c in ours.items()]).collect()
    assert [(r.i, k, rows[r.i][:60] if rows[r.i] else None, r[f"p_{k}"], r[f"o_{k}"]) for r in out for k in plain if r[f"p_{k}"] != r[f"o_{k}"]] == []
    assert sum(r.o_least or 0 for r in out) > 100 and len({r.o_low for r in out}) == 2


def test_many_jobs_share_few_states(spark, tmp_path):
    """Each job had a state and a call of its own."""
    schema = "job_id string, ts timestamp, event_id long, status string, stage string, done_files int, total_files int"
    rows = [(f"j{i % 700}", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i * 7 % 500), i, ["running", "failed", "succeeded"][i * 5 % 3], ["parse", "embed"][i % 2], i % 9, 9) for i in range(2000)]
    for k in range(2):
        spark.createDataFrame(rows[k::2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = P.progress_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), buckets=5)
    query = stream.writeStream.outputMode("update").foreachBatch(P.keep_progress(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) == 5
    found, table = P.last_progress(spark.read.parquet(str(tmp_path / "out"))), spark.createDataFrame(rows, schema)
    for live, batch in ((P.live_stage_durations(found), J.stage_durations(table)), (P.live_states(found), J.job_state(table))):
        assert sorted(map(tuple, live.collect())) == sorted(map(tuple, batch.select(*live.columns).collect()))


def test_neighbours_by_buckets_make_no_row_for_a_pair(spark):
    """Candidates were joined by bucket, several rows for each pair; the lists are those of all pairs that share a bucket."""
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(300, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(300, None)]
    df = spark.createDataFrame(rows, "node_id long, embedding array<double>")
    found = R.dense_topk_ann(df.where("node_id % 20 = 0").withColumnRenamed("node_id", "query_id"), df, 9, tables=5, bits=4, seed=1)
    assert "explode" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    signs = (unit @ np.random.default_rng(1).normal(size=(16, 20)) > 0).reshape(300, 5, 4)
    for q in range(0, 300, 20):
        near = [(-round(float(unit[q] @ unit[i]), 9), i) for i in range(300) if (signs[q] == signs[i]).all(axis=1).any()]
        assert [(r.node_id, r.rank) for r in found.where(F.col("query_id") == q).orderBy("rank").collect()] == [(i, n + 1) for n, (_, i) in enumerate(sorted(near)[:9])]


def test_slices_of_long_leaves_are_small(spark, tmp_path):
    """A task holds a slice in Python: it had up to two million tokens."""
    leaves = spark.createDataFrame([(i, "a b c d " * 5_000) for i in range(60)], "node_id long, text string").coalesce(1)
    rows = build_index(leaves, str(tmp_path / "index")).postings.where("term IS NULL").collect()
    assert sum(r.n for r in rows) == 60 and max(r.n for r in rows) * 20_000 <= 1 << 19


def test_texts_without_letters_have_no_cosine(spark, tmp_path):
    """Their cosine is NaN in SQL, which leads the dense list and shifts the others' ranks."""
    words = [f"{w} {v} {x}" for w in ("alpha", "beta", "gamma") for v in ("ohm", "tau") for x in ("kilo", "milli", "pico", "nano", "mega", "giga")]
    docs = ([(i, t) for i, t in enumerate(["4 5 6", "", "12", *words, *words, "éé ñ"])], "doc_id long, text string")
    asked = ([(0, "alpha ohm kilo 4"), (1, "7 12 6"), (2, "tau nano tau nano")], "item_id long, text string")
    found, expected = both(spark, tmp_path, "r1_query", documents=docs, benchmark=asked)
    assert found == expected and len(found) == 30


def test_equal_cosines_are_equal_numbers(spark):
    """Vectors of the same product and length, far apart in a block, tie; ties go by node_id."""
    base = np.random.default_rng(3).integers(0, 400, 26)
    leaves = spark.createDataFrame([(i, np.roll(base, i).astype(float).tolist()) for i in range(900)], "node_id long, embedding array<double>")
    queries = spark.createDataFrame([(0, [1.0] * 26), (1, [0.0] * 26)], "query_id long, embedding array<double>")
    rows = R.dense_topk(queries, leaves, 20).orderBy("query_id", "rank").collect()
    assert [r.node_id for r in rows] == [*range(20), *range(20)] and len({r.score for r in rows}) == 2
    assert all(np.isnan(r.score) for r in R.dense_topk(queries.where("query_id = 1"), leaves, 3, undefined_first=True).collect())
