"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.sources.corpus import Corpus

from .registry import query

_TOKENS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{M}}\p{{N}}_]+'), lambda w: w <> '')"


@query(r"SELECT doc_id, sha256(regexp_replace(text || chr(7) || chr(9), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) AS cleaned FROM documents")
def b5_clean_text(c: Corpus) -> DataFrame:
    return c.documents.select("doc_id", F.sha2(T.clean_text(F.concat("text", F.lit("\x07\t"))), 256).alias("cleaned"))


@query(
    r"""WITH lines AS (SELECT doc_id, unnest(string_split(replace(text, '. ', chr(10) || '```' || chr(10) || '```' || chr(10)), chr(10))) AS line FROM documents),
    bare AS (SELECT doc_id, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM lines),
    judged AS (SELECT doc_id, length(bare) = 0 OR length(regexp_replace(bare, '[ \t\r\n`#|>*_~\-→▪●·•]+', '', 'g')) = 0 AS low FROM bare)
    SELECT doc_id, count(*) AS chunks, count(*) FILTER (WHERE low) AS low_value FROM judged GROUP BY doc_id"""
)
def b6_low_value(c: Corpus) -> DataFrame:
    lines = c.documents.select("doc_id", F.explode(F.split(F.replace("text", F.lit(". "), F.lit("\n```\n```\n")), "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if(T.is_low_value(F.col("line"))).alias("low_value"))


@query(r"SELECT file_id, regexp_matches(file_name, '^[\p{L}\p{N}_\-. ]+$') AND NOT contains(file_name, '..') AS safe_name, regexp_matches(replace(file_name, '/', ' '), '^[\p{L}\p{N}_\-. ]+$') AS safe_flat FROM files", "files")
def b11_safe_name(c: Corpus) -> DataFrame:
    return c.files.select("file_id", T.is_safe_name(F.col("file_name")).alias("safe_name"), T.is_safe_name(F.replace("file_name", F.lit("/"), F.lit(" "))).alias("safe_flat"))


@query("SELECT file_id, CASE WHEN length(content_hash) > 8 THEN left(content_hash, 8) || '...' ELSE content_hash END AS masked FROM files", "files")
def b12_mask_token(c: Corpus) -> DataFrame:
    return c.files.select("file_id", T.mask_token(F.col("content_hash")).alias("masked"))


@query("SELECT file_id, CASE WHEN length(error) > 300 THEN left(error, 300) || '…' ELSE error END AS error FROM file_index", "file_index")
def b13_brief_error(c: Corpus) -> DataFrame:
    return c.file_index.select("file_id", T.brief_error(F.col("error")).alias("error"))


@query("SELECT file_id, round(file_size / 1024.0::DOUBLE, 1) AS size_kb FROM files", "files")
def b13_size_kb(c: Corpus) -> DataFrame:
    return c.files.select("file_id", T.size_kb(F.col("file_size")).alias("size_kb"))


@query(
    r"""WITH n AS (SELECT doc_id, length(text) AS chars, length(regexp_replace(text, '[^\x{4e00}-\x{9fff}]', '', 'g')) AS cjk FROM documents)
    SELECT doc_id, CAST(floor(1.5::DOUBLE * cjk + 0.3::DOUBLE * (chars - cjk)) AS INT) AS tokens FROM n"""
)
def s1_estimate_tokens(c: Corpus) -> DataFrame:
    return c.documents.select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query(
    r"""SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '[\x{4e00}-\x{9fff}]') THEN 'CJK' END, CASE WHEN regexp_matches(text, '[\x{0400}-\x{04ff}]') THEN 'Cyrillic' END,
    CASE WHEN regexp_matches(text, '[A-Za-z\x{00c0}-\x{00d6}\x{00d8}-\x{00f6}\x{00f8}-\x{024f}]') THEN 'Latin' END], lambda x: x IS NOT NULL), ',') AS scripts FROM documents"""
)
def s2_detect_scripts(c: Corpus) -> DataFrame:
    return c.documents.select("doc_id", F.concat_ws(",", T.detect_scripts(F.col("text"))).alias("scripts"))


@query(
    r"""SELECT doc_id, regexp_matches(tail, '[\x{4e00}-\x{9fff}]') AS mismatch FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '公司' || text ELSE text END AS tail FROM documents)"""
)
def s3_script_mismatch(c: Corpus) -> DataFrame:
    mixed = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("公司"), F.col("text"))).otherwise(F.col("text"))
    return c.documents.select("doc_id", T.script_mismatch(mixed, F.col("source")).alias("mismatch"))


@query(
    """WITH p AS (SELECT file_id, file_name, text, CASE WHEN CAST(file_id AS BIGINT) % 4 = 0 THEN NULL WHEN CAST(file_id AS BIGINT) % 4 = 1 THEN '  ' ELSE left(text, 400) END AS prefix FROM files),
    q AS (SELECT *, trim(prefix, ' ' || chr(10)) AS bare FROM p)
    SELECT file_id, sha256(CASE WHEN prefix IS NULL OR length(bare) = 0 THEN file_name ELSE left(bare, 150) END || chr(10) || chr(10) || text) AS digest FROM q""",
    "files",
)
def s4_contextualize(c: Corpus) -> DataFrame:
    n = F.col("file_id").cast("bigint") % 4
    prefix = F.when(n == 0, F.lit(None).cast("string")).when(n == 1, F.lit("  ")).otherwise(F.left("text", F.lit(400)))
    return c.files.select("file_id", F.sha2(T.contextualize(F.col("text"), prefix, F.col("file_name")), 256).alias("digest"))


@query("SELECT doc_id, sha256(CASE WHEN length(text) > 5000 THEN left(text, 5000) || chr(10) || '[truncated]' ELSE text END) AS digest FROM documents")
def s5_clip_document(c: Corpus) -> DataFrame:
    return c.documents.select("doc_id", F.sha2(T.clip_document(F.col("text"), 5000), 256).alias("digest"))


@query(f"SELECT doc_id, len({_TOKENS.format('text')}) AS tokens, sha256(array_to_string({_TOKENS.format('text')}, ' ')) AS digest FROM documents")
def s6_tokenize(c: Corpus) -> DataFrame:
    tokens = T.tokenize(F.col("text"))
    return c.documents.select("doc_id", F.size(tokens).cast("bigint").alias("tokens"), F.sha2(F.concat_ws(" ", tokens), 256).alias("digest"))


@query(f"SELECT item_id, array_to_string(list_sort(list_distinct({_TOKENS.format('text')})), ' ') AS lexemes FROM benchmark")
def s7_or_query(c: Corpus) -> DataFrame:
    return c.benchmark.select("item_id", F.concat_ws(" ", F.array_sort(T.or_query(F.col("text")))).alias("lexemes"))


@query("SELECT item_id, 'query: ' || text AS prefixed, replace('Judge: {text} / {text}', '{text}', text) AS templated FROM benchmark")
def s8_prefix_template(c: Corpus) -> DataFrame:
    return c.benchmark.select("item_id", T.with_prefix(F.col("text"), "query").alias("prefixed"), T.apply_template(F.lit("Judge: {text} / {text}"), F.col("text")).alias("templated"))


@query("SELECT item_id, sha256(text || '|' || CAST(item_id % 5 + 1 AS VARCHAR) || '|' || CASE WHEN item_id % 2 = 0 THEN '12' ELSE 'default' END) AS fingerprint FROM benchmark")
def s9_fingerprint(c: Corpus) -> DataFrame:
    return c.benchmark.select("item_id", T.fingerprint(F.col("text"), F.col("item_id") % 5 + 1, F.when(F.col("item_id") % 2 == 0, 12)).alias("fingerprint"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'key-' || CAST(doc_id AS VARCHAR) ELSE sha256('opaque-' || CAST(doc_id AS VARCHAR)) END AS owner FROM documents""")
def s10_owner_key(c: Corpus) -> DataFrame:
    claims = F.concat(F.lit('{"sub":"u","jti":"key-'), F.col("doc_id").cast("string"), F.lit('"}'))
    encoded = F.translate(F.rtrim(F.base64(claims.cast("binary")), F.lit("=")), "+/", "-_")
    token = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("e30."), encoded, F.lit(".s"))).otherwise(F.concat(F.lit("opaque-"), F.col("doc_id").cast("string")))
    return c.documents.select("doc_id", T.owner_key(token).alias("owner"))


@query(r"SELECT doc_id, sha256(text) AS digest, CAST(1 + (doc_id % 2) AS INT) AS removed FROM documents")
def s11_clean_transcript(c: Corpus) -> DataFrame:
    noisy = F.concat(F.lit("打賞支持本欄目"), F.col("text"), F.when(F.col("doc_id") % 2 == 1, F.lit("由志願者提供")).otherwise(F.lit("")))
    cleaned = T.clean_transcript(noisy)
    return c.documents.select("doc_id", F.sha2(cleaned["text"], 256).alias("digest"), cleaned["n"].alias("removed"))


# Letters outside ASCII in the given texts; SQL's edit distance counts bytes, so that it gets a byte for each of them.
_ACCENTED = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"


def bare_sql(text: str) -> str:
    """A text without what the error rate leaves out, a byte for each character."""
    to = " || ".join(f"chr({k})" for k in [*range(1, 9), *range(14, 32), *range(128 - 1, 128)][: len(_ACCENTED)])
    return rf"translate(regexp_replace({text}, '[\s,.:;!?\x22\x27()\-]+', '', 'g'), '{_ACCENTED}', {to})"


@query(
    rf"""WITH h AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS follows FROM conversations), p AS (SELECT conv_id, turn, {bare_sql("text")} AS a, {bare_sql("follows")} AS b FROM h WHERE follows IS NOT NULL)
    SELECT conv_id, turn, round(CASE WHEN length(a) = 0 THEN CASE WHEN length(b) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END ELSE levenshtein(a, b)::DOUBLE / length(a) END, 6) AS cer FROM p"""
)
def s12_cer(c: Corpus) -> DataFrame:
    """Each whole turn of a conversation against the next one."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = c.conversations.withColumn("follows", F.lead("text").over(w)).where("follows IS NOT NULL")
    return pairs.select("conv_id", "turn", F.round(T.cer(F.col("text"), F.col("follows")), 6).alias("cer"))


@query("SELECT doc_id, round(CASE doc_id % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END, 6) AS ratio FROM documents")
def s13_simplified_ratio(c: Corpus) -> DataFrame:
    head = F.element_at(F.array(F.lit("國語"), F.lit("语言"), F.lit("会议")), (F.col("doc_id") % 3 + 1).cast("int"))
    return c.documents.select("doc_id", F.round(T.simplified_ratio(F.concat(head, "text")), 6).alias("ratio"))


@query(
    """SELECT doc_id, CASE WHEN quality = 1 THEN '[true, true, true, true]' ELSE '[true, false, true, false]' END AS grades, CASE WHEN toxic = 1 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS faithfulness FROM labels"""
)
def s14_parse_grades(c: Corpus) -> DataFrame:
    answer = F.when(F.col("quality") == 1, "no array").otherwise("Here: [true, false, true] ok")
    scores = F.concat(F.lit('x {"faithfulness": '), F.when(F.col("toxic") == 1, "1.7").otherwise("0.25"), F.lit(', "relevance": 0.5} y'))
    grades = F.concat(F.lit("["), F.concat_ws(", ", T.parse_grades(answer, F.lit(4)).cast("array<string>")), F.lit("]"))
    return c.labels.select("doc_id", grades.alias("grades"), T.parse_scores(scores)["faithfulness"].alias("faithfulness"))


@query("SELECT item_id, text || ' [' || CAST(item_id AS VARCHAR) || '] and [2]' AS cited FROM benchmark")
def s15_citations(c: Corpus) -> DataFrame:
    raw = F.concat("text", F.lit(" 【 "), F.col("item_id").cast("string"), F.lit("†L1-L5】 and 【2†x】"))
    return c.benchmark.select("item_id", T.normalize_citations(raw).alias("cited"))


@query("SELECT file_id, CASE WHEN starts_with(file_name, 'src1/') THEN 'archive/' || substr(file_name, 6) ELSE file_name END AS path FROM files", "files")
def s18_rename_folder(c: Corpus) -> DataFrame:
    return c.files.select("file_id", T.rename_prefix(F.col("file_name"), "src1", "archive").alias("path"))


@query("SELECT event_id, CASE WHEN result_count = 0 THEN 'no_results' WHEN result_count < 5 THEN 'below_top_k' ELSE 'normal' END AS hint FROM query_log", "query_log")
def s20_next_hint(c: Corpus) -> DataFrame:
    return c.query_log.select("event_id", T.next_hint(F.col("result_count"), F.lit(5)).alias("hint"))
