import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from shelfmark.llm import common as C
from shelfmark.llm import quality as Q
from shelfmark.llm.quality import keep_good, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(grams)
    covered = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 3)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), again, len(covered)


CASES = [None, "", " \n\t ", "one", "é ü \x1c x", "a b c " * 40, "line one\nline one\n\nline two\r\nline one", "x# y* z$ <a> |", " ".join(f"w{i}" for i in range(80)), "w " * 30_000, "\n".join(f"row {i % 3} of many" for i in range(60))]


def test_base_measures_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(CASES)] + [(None, "no id", 2), (3, "one", 1), (3, "one", 1)], "doc_id long, text string, n_words int")
    rows = quality(docs).collect()
    assert len(rows) == len(CASES) + 3
    for row in rows:
        if row.doc_id is not None:
            words, chars, symbols, lines, repeated = brute(CASES[row.doc_id])
            assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (words, chars, symbols, lines, repeated)
            assert row.base_failed == (words < 50 or 100 * repeated > 50 * words)
            assert not (row.base_failed and row.kept)


def test_clean_stay_and_repetitive_go(spark):
    clean = " ".join(f"word{i * i % 997}" for i in range(300))
    lines = "\n".join(["the same line again and again"] * 20 + [f"other words number {i} here" for i in range(20)])
    docs = spark.createDataFrame([(1, clean, "x"), (2, lines, "x"), (3, clean.replace(" ", "### "), "x")], "doc_id long, text string, extra string")
    kept = keep_good(docs)
    assert kept.columns == docs.columns
    assert [r.doc_id for r in kept.collect()] == [1]
    assert {r.doc_id for r in quality(docs).where("kept").collect()} == {1}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert quality(docs).count() == 0 and keep_good(docs).count() == 0


def test_query_matches_brute_force(spark):
    from shelfmark.llm.queries import op3_quality_rules

    folder = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in op3_quality_rules(spark, folder).collect()}
    for doc in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.col("text")).collect():
        r = rows[doc.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(doc.text)


def test_words_of_repeated_patterns_have_different_hashes():
    """Two words that a polynomial modulo a power of two confuses: a Thue-Morse word over two letters and its mirror."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    assert C.hash_bytes(word.encode()) != C.hash_bytes(word.translate(str.maketrans("ab", "ba")).encode())
    rng = np.random.default_rng(3)
    words = list({bytes(rng.integers(97, 100, rng.integers(1, 200)).astype(np.uint8)) for _ in range(5000)})
    assert len(set(C.Words([b" ".join(words)]).hashes().tolist())) == len(words)
    assert [C.hash_bytes(w) for w in words[:50]] == C.Words(words[:50]).hashes().tolist()


def test_lines_are_measured_in_characters():
    m = Q.measure(["é é\né é\nabc abc abc".encode()])
    assert m["dup_line_chars"][0] == 3 / 17
