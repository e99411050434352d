"""Intake, filters, lookups, joins and updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import ranking as R
from shelfmark.operators import stats as S
from shelfmark.operators import tables as T
from shelfmark.sources.corpus import Corpus

from .registry import query

_EXT = r"lower(regexp_extract(file_name, '\.([^./]+)$', 1))"


@query(f"SELECT file_id, CASE WHEN file_size > 20000 THEN 'big' WHEN {_EXT} IN ('mp3') THEN 'extension' END IS NULL AS accepted FROM files", "files")
def a1_intake(c: Corpus) -> DataFrame:
    big = c.files.withColumn("file_size", F.when(F.col("file_size") > 20000, F.lit(1 << 40)).otherwise(F.greatest("file_size", F.lit(1))))
    ok, rejected = T.intake(big, T.PLAIN + T.STRUCTURED)
    return ok.select("file_id", F.lit(True).alias("accepted")).unionByName(rejected.select("file_id", F.lit(False).alias("accepted")))


@query(f"SELECT file_id, CASE WHEN {_EXT} = 'txt' THEN 'plain' WHEN {_EXT} IN ('html', 'md', 'pdf') THEN 'structured' ELSE 'audio' END AS route FROM files", "files")
def a3_route(c: Corpus) -> DataFrame:
    return T.route(c.files).select("file_id", "route")


@query("SELECT item_id, text FROM benchmark WHERE length(trim(text)) >= 2 AND item_id % 7 <> 0 UNION ALL SELECT item_id, NULL FROM benchmark WHERE item_id < 0")
def a7_read_qa(c: Corpus) -> DataFrame:
    from shelfmark.sources.files import with_question

    return with_question(c.benchmark.withColumn("text", F.when(F.col("item_id") % 7 != 0, F.col("text"))), "text").select("item_id", "text")


@query("SELECT file_id, file_name FROM files WHERE folder_id = 'de' AND mime_type = 'text/html'", "files")
def b1_filter_eq(c: Corpus) -> DataFrame:
    return T.filter_eq(c.files, folder_id="de", mime_type="text/html").select("file_id", "file_name")


@query("SELECT folder_id, name FROM folders WHERE user_token = 'owner-e'", "folders")
def b2_owned_by(c: Corpus) -> DataFrame:
    return T.owned_by(c.folders, "owner-e").select("folder_id", "name")


@query("""SELECT status, count(*) AS n FROM job_events WHERE folder_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) GROUP BY status""", "job_events")
def b3_jobs_for_owner(c: Corpus) -> DataFrame:
    """Jobs of the folders that an owner has, by status."""
    folders = c.customer.select(F.col("c_custkey").alias("folder_id"), "c_nationkey")
    return T.jobs_for_owner(c.job_events, folders, F.col("c_nationkey") < 12).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT file_id FROM files WHERE len(list_filter(tags, lambda t: contains(lower(t), 'rc1'))) > 0 AND contains(lower(mime_type), 'html')", "files")
def b4_search_files(c: Corpus) -> DataFrame:
    return T.search_files(c.files, tag="RC1", mime="HTML").select("file_id")


@query("SELECT file_id FROM file_index WHERE coalesce(CASE WHEN CAST(file_id AS BIGINT) % 3 = 0 THEN NULL WHEN CAST(file_id AS BIGINT) % 3 = 1 THEN 'leaf' ELSE 'parent' END, 'leaf') = 'leaf'", "file_index")
def b7_only_leaves(c: Corpus) -> DataFrame:
    from shelfmark.operators.retrieval import only_leaves

    n = F.col("file_id").cast("bigint") % 3
    return only_leaves(c.file_index.withColumn("node_role", F.when(n == 1, "leaf").when(n == 2, "parent"))).select("file_id")


@query("SELECT event_id FROM events WHERE value >= 100")
def b8_cutoff(c: Corpus) -> DataFrame:
    from shelfmark.operators.retrieval import apply_cutoff

    return apply_cutoff(c.events.withColumnRenamed("value", "score"), 100).select("event_id")


@query("SELECT event_id, length(trim(query)) >= 2 AS valid FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN ' x ' ELSE query END AS query FROM query_log)", "query_log")
def b9_validate_queries(c: Corpus) -> DataFrame:
    ok, bad = T.validate_queries(c.query_log.withColumn("query", F.when(F.col("event_id") % 5 == 0, " x ").otherwise(F.col("query"))))
    return ok.select("event_id", F.lit(True).alias("valid")).unionByName(bad.select("event_id", F.lit(False).alias("valid")))


@query("""SELECT item_id, coalesce(k, 10) AS top_k, coalesce(c, 0.0::DOUBLE) AS cutoff, 12 AS sparse_top_k, coalesce(k, 10) BETWEEN 1 AND 20 AND coalesce(c, 0) BETWEEN 0 AND 1 AS valid
    FROM (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN CAST(item_id AS INT) END AS k, CASE WHEN item_id % 3 = 0 THEN item_id / 20.0::DOUBLE END AS c FROM benchmark)""")  # fmt: skip
def b10_resolve_params(c: Corpus) -> DataFrame:
    q = c.benchmark.select("item_id", F.when(F.col("item_id") % 2 == 0, F.col("item_id").cast("int")).alias("top_k"), F.when(F.col("item_id") % 3 == 0, F.col("item_id") / 20.0).alias("cutoff"), F.lit(None).cast("int").alias("sparse_top_k"))
    return T.resolve_params(q)


@query("SELECT folder_id FROM folders WHERE contains(lower(name || ' ' || description), 'in f')", "folders")
def b14_search_folders(c: Corpus) -> DataFrame:
    return T.search_folders(c.folders, "IN F").select("folder_id")


@query("SELECT folder_id, count(*) FILTER (WHERE index_status = 'indexed') AS indexed FROM file_index GROUP BY folder_id HAVING count(*) FILTER (WHERE index_status = 'indexed') > 0", "file_index")
def b15_queryable_folders(c: Corpus) -> DataFrame:
    return S.folder_stats(c.folders, c.file_index).where("indexed > 0").select("folder_id", "indexed")


@query("SELECT f.file_id, uploaded_at, index_status, chunk_count, coalesce(index_status = 'indexed', false) AS is_indexed FROM files f LEFT JOIN file_index i USING (file_id)", "files", "file_index")
def c1_files_with_status(c: Corpus) -> DataFrame:
    return T.files_with_status(c.files, c.file_index).orderBy(F.desc("uploaded_at"), "file_id").select("file_id", "uploaded_at", "index_status", "chunk_count", "is_indexed")


@query("SELECT f.file_id, file_name, index_status FROM files f LEFT JOIN file_index i USING (file_id) WHERE f.file_id = '28'", "files", "file_index")
def c2_file_detail(c: Corpus) -> DataFrame:
    return T.files_with_status(c.files.where("file_id = '28'"), c.file_index).select("file_id", "file_name", "index_status")


@query(
    """SELECT f.folder_id, name, coalesce(indexed, 0) AS indexed, coalesce(failed, 0) AS failed, CAST(coalesce(chunks, 0) AS BIGINT) AS chunks, last_indexed FROM folders f LEFT JOIN (SELECT folder_id, count(*) FILTER (WHERE index_status = 'indexed') AS indexed,
    count(*) FILTER (WHERE index_status = 'failed') AS failed, sum(chunk_count) AS chunks, max(indexed_at) AS last_indexed FROM file_index GROUP BY folder_id) USING (folder_id)""",
    "folders", "file_index",
)
def c3_folder_stats(c: Corpus) -> DataFrame:
    return S.folder_stats(c.folders, c.file_index).select("folder_id", "name", "indexed", "failed", "chunks", "last_indexed")


@query("SELECT event_id, j.folder_id, c_name AS folder_name, status FROM job_events j LEFT JOIN customer ON j.folder_id = c_custkey ORDER BY ts DESC, event_id LIMIT 20", "job_events")
def c4_recent_jobs(c: Corpus) -> DataFrame:
    names = c.customer.select(F.col("c_custkey").alias("folder_id"), F.col("c_name").alias("folder_name"))
    recent = c.job_events.orderBy(F.desc("ts"), "event_id").limit(20)
    return recent.join(names, "folder_id", "left").select("event_id", "folder_id", "folder_name", "status")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT item_id * 3 FROM benchmark)")
def c5_lookup(c: Corpus) -> DataFrame:
    ids = c.benchmark.select((F.col("item_id") * 3).alias("id"))
    return T.lookup(c.documents, "doc_id", ids.union(ids)).select("doc_id", "lang")


@query("SELECT i.file_id, CASE WHEN CAST(i.file_id AS BIGINT) % 2 = 0 THEN file_name ELSE 'Unknown' END AS file_name, index_status FROM file_index i JOIN files f USING (file_id)", "files", "file_index")
def c6_indexed_files(c: Corpus) -> DataFrame:
    return T.indexed_files(c.file_index, c.files.where(F.col("file_id").cast("bigint") % 2 == 0)).select("file_id", "file_name", "index_status")


@query("SELECT file_id FROM files f WHERE NOT EXISTS (SELECT 1 FROM file_index i WHERE i.file_id = f.file_id AND i.content_hash = f.content_hash AND index_status = 'indexed')", "files", "file_index")
def c7_needs_index(c: Corpus) -> DataFrame:
    return T.needs_index(c.files, c.file_index).select("file_id")


@query("SELECT file_id FROM files WHERE folder_id = 'fr' AND file_id IN (SELECT CAST(item_id * 5 AS VARCHAR) FROM benchmark)", "files")
def c8_subset(c: Corpus) -> DataFrame:
    ids = c.benchmark.select((F.col("item_id") * 5).cast("string").alias("id"))
    return T.lookup(T.filter_eq(c.files, folder_id="fr"), "file_id", ids).select("file_id")


@query(
    """WITH hits AS (SELECT conv_id, turn FROM conversations WHERE role = 'user'),
    rows_ AS (SELECT h.conv_id, h.turn AS hit, c.turn, c.text FROM hits h JOIN conversations c ON c.conv_id = h.conv_id AND c.turn BETWEEN greatest(h.turn - 1, 0) AND h.turn + 1)
    SELECT conv_id, hit, min(turn) AS first_turn, max(turn) AS last_turn, sha256(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM rows_ GROUP BY conv_id, hit"""
)
def c9_neighbor_windows(c: Corpus) -> DataFrame:
    from shelfmark.operators.retrieval import neighbor_windows

    turns = c.conversations.select(F.col("conv_id").alias("file_id"), F.col("turn").alias("chunk_index"), "text", "role")
    out = neighbor_windows(turns.where("role = 'user'").select("file_id", "chunk_index"), turns.drop("role"), 1)
    return out.select(F.col("file_id").alias("conv_id"), F.col("chunk_index").alias("hit"), F.col("first_index").alias("first_turn"), F.col("last_index").alias("last_turn"), F.sha2("text", 256).alias("digest"))


@query("SELECT item_id FROM benchmark WHERE item_id IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)")
def c11_alive_gold(c: Corpus) -> DataFrame:
    from shelfmark.operators.evaluation import alive_gold

    items = c.benchmark.select("item_id", F.col("item_id").alias("gold_node_id"))
    return alive_gold(items, c.documents.where("doc_id % 3 != 0").select(F.col("doc_id").alias("node_id"))).select("item_id")


@query("SELECT o_orderkey AS node_id, o_totalprice AS price FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def c12_parents_of(c: Corpus) -> DataFrame:
    hits = c.lineitem.where("l_quantity > 45").select(F.col("l_orderkey").alias("parent_node_id"))
    return T.parents_of(hits, c.orders.select(F.col("o_orderkey").alias("node_id"), F.col("o_totalprice").alias("price")))


@query(
    """WITH u AS (SELECT CAST(doc_id AS VARCHAR) AS file_id, CASE WHEN doc_id % 3 = 0 THEN 'failed' ELSE 'indexed' END AS index_status, 7 AS chunk_count, 'boom' AS error FROM documents WHERE doc_id % 2 = 0)
    SELECT coalesce(a.file_id, b.file_id) AS file_id, coalesce(b.index_status, a.index_status) AS index_status, CASE WHEN b.index_status = 'indexed' THEN b.chunk_count ELSE coalesce(a.chunk_count, 0) END AS chunk_count,
    CASE WHEN b.index_status = 'indexed' THEN NULL WHEN b.file_id IS NOT NULL THEN b.error ELSE a.error END AS error, a.folder_id, CASE WHEN b.index_status = 'indexed' THEN 'new' ELSE a.content_hash END AS content_hash,
    a.embedding_model, CASE WHEN b.index_status = 'indexed' THEN TIMESTAMP '2024-01-31' ELSE a.indexed_at END AS indexed_at FROM file_index a FULL JOIN u b ON a.file_id = b.file_id""",
    "file_index",
)
def a11_upsert_index(c: Corpus) -> DataFrame:
    updates = c.documents.where("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("file_id"), F.when(F.col("doc_id") % 3 == 0, "failed").otherwise("indexed").alias("index_status"), F.lit(7).alias("chunk_count"), F.lit("boom").alias("error"), F.lit("new").alias("content_hash"), F.to_timestamp_ntz(F.lit("2024-01-31 00:00:00")).alias("indexed_at"))
    return T.upsert_index(c.file_index, updates)


@query("SELECT job_id, arg_max(status, (ts, event_id)) AS status, max(ts) AS ts FROM job_events GROUP BY job_id", "job_events")
def a12_upsert_jobs(c: Corpus) -> DataFrame:
    return T.latest(c.job_events.select("job_id", "event_id", "ts", "status"), "job_id", "ts").select("job_id", "status", "ts")


@query("SELECT folder_id, CASE WHEN folder_id = 'de' THEN 'Neu' ELSE name END AS name, CASE WHEN folder_id = 'fr' THEN 'x' ELSE description END AS description FROM folders", "folders")
def a14_patch_rows(c: Corpus) -> DataFrame:
    patches = c.folders.where("folder_id IN ('de', 'fr')").select("folder_id", F.when(F.col("folder_id") == "de", "Neu").alias("name"), F.when(F.col("folder_id") == "fr", "x").alias("description"))
    return T.patch_rows(c.folders.select("folder_id", "name", "description"), patches, "folder_id")[0]


@query("SELECT 'files' AS table_name, count(*) AS n FROM files WHERE folder_id <> 'de' UNION ALL SELECT 'file_index', count(*) FROM file_index WHERE folder_id <> 'de' UNION ALL SELECT 'folders', count(*) FROM folders WHERE folder_id <> 'de'", "files", "file_index", "folders")
def a15_delete_folder(c: Corpus) -> DataFrame:
    ids = c.folders.where("folder_id = 'de'").select("folder_id")
    return S.table_counts(T.delete_folders({"files": c.files, "file_index": c.file_index, "folders": c.folders}, ids))


@query(
    """WITH j AS (SELECT CAST(item_id AS VARCHAR) AS cur, [CAST(item_id + 1 AS VARCHAR), CAST(item_id + 2 AS VARCHAR)] AS scope FROM benchmark WHERE item_id % 4 = 0)
    SELECT f.file_id, CASE WHEN index_status IN ('indexed', 'failed') THEN index_status WHEN f.file_id IN (SELECT cur FROM j) THEN 'indexing' WHEN f.file_id IN (SELECT unnest(scope) FROM j) THEN 'queued' ELSE 'not_indexed' END AS status
    FROM files f LEFT JOIN file_index i USING (file_id)""",
    "files", "file_index",
)
def s19_file_status(c: Corpus) -> DataFrame:
    n = F.col("item_id")
    jobs = c.benchmark.select(F.when(n % 4 == 0, "running").otherwise("succeeded").alias("status"), n.cast("string").alias("current_file_id"), F.array((n + 1).cast("string"), (n + 2).cast("string")).alias("scope_file_ids"))
    return T.file_status(c.files, c.file_index, jobs)


@query("SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 5")
def w1_top_k(c: Corpus) -> DataFrame:
    return R.top_k(c.documents.select("doc_id", "source", "n_chars"), 5, ["source"], F.desc("n_chars"), F.col("doc_id")).select("doc_id", "rank")


@query("SELECT conv_id, turn FROM conversations WHERE conv_id = 3 ORDER BY turn LIMIT 4")
def w2_chunks_of_file(c: Corpus) -> DataFrame:
    turns = c.conversations.select(F.col("conv_id").cast("string").alias("file_id"), F.col("turn").alias("chunk_index"), F.col("turn").alias("node_id"), "conv_id", "turn")
    return R.chunks_of_file(turns, "3", 4).select("conv_id", "turn")


@query(
    """WITH t AS (SELECT conv_id, turn, CAST(floor(0.3::DOUBLE * length(text)) AS INT) AS tokens FROM conversations), r AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn) AS running, sum(tokens) OVER (PARTITION BY conv_id) AS whole FROM t)
    SELECT conv_id, turn, CAST(running AS BIGINT) AS running, whole > 100 AS truncated FROM r WHERE running <= 100"""
)
def w3_read_files(c: Corpus) -> DataFrame:
    from shelfmark.functions.text import estimate_tokens

    return R.read_files(c.conversations, 100, estimate_tokens(F.col("text")), "conv_id", "turn").select("conv_id", "turn", "running", "truncated")


@query(
    """WITH r AS (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents), f AS (SELECT lang, source, min(rank) AS first_rank FROM r GROUP BY ALL)
    SELECT lang, source, first_rank, row_number() OVER (PARTITION BY lang ORDER BY first_rank, source) AS rank FROM f"""
)
def w4_dedup_ranked(c: Corpus) -> DataFrame:
    ranked = R.top_k(c.documents.select("doc_id", "lang", "source", "n_chars"), 1 << 40, ["lang"], F.desc("n_chars"), F.col("doc_id"))
    return R.dedup_ranked(ranked, "lang", "source")


@query(
    """WITH r AS (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents), f AS (SELECT lang, source, min(rank) AS first_rank FROM r GROUP BY ALL)
    SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY first_rank, source) AS rank FROM f"""
)
def w4_rank_by_best(c: Corpus) -> DataFrame:
    """The same order without ranking all rows: each source's best row comes first."""
    return R.rank_by_best(c.documents, "lang", "source", -F.col("n_chars"), F.col("doc_id"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(DISTINCT trim(line)) AS lines FROM l GROUP BY doc_id")
def w5_dedup_leaves(c: Corpus) -> DataFrame:
    lines = c.documents.select(F.col("doc_id").alias("file_id"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"))
    return R.dedup_leaves(lines).groupBy(F.col("file_id").alias("doc_id")).agg(F.count("*").alias("lines"))


@query("SELECT event_id, created_at FROM query_log ORDER BY created_at DESC, event_id LIMIT 25", "query_log")
def w7_audit_timeline(c: Corpus) -> DataFrame:
    return c.query_log.select("event_id", "created_at").orderBy(F.desc("created_at"), "event_id").limit(25)


@query("SELECT doc_id FROM documents WHERE length(text) > 80 ORDER BY md5('5:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 30")
def w8_sample_chunks(c: Corpus) -> DataFrame:
    return R.sample(c.documents.where(F.length("text") > 80).select("doc_id"), 30, 5, "doc_id")
