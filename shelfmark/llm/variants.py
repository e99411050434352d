"""Spelling variants by reduced-alphabet generation.

Letters are hashed to a few symbols. Every reduced word gets its full neighbourhood of one edit (deletions, replacements, insertions and itself)
over the small alphabet, as codes; a join with the codes of the reduced words that occur finds those that are near, and
the words behind them are compared as they stand. Two words one edit apart are always one reduced edit apart or the same reduced word, so
nothing is lost, whatever the letters are hashed to.

The alphabet is the smallest of SYMBOLS with which the words of a reduced word are few: the sum of their squared numbers, which bounds what is compared inside
them, stays in proportion to the words. The largest alphabet gives each letter a symbol of its own, where a reduced word has one word.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix

#: The letters of a word: a to z after lower-casing, and those of the second half of Latin-1 (with its two signs).
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))
RUN = "[A-Za-zÀ-ÿ]+"
#: Sizes of the reduced alphabet; the last has a symbol for each letter.
SYMBOLS = (4, 8, 16, 32, len(LETTERS))
#: Words of one reduced word: the sum of their squared numbers over the number of words, and the largest number, at most.
MOST_SQUARES, MOST_ALIKE = 4, 256
#: One occurrence in so many loses a letter.
SPOILT = 199
#: Letters and occurrences of a word at least; a form has so many times the occurrences.
LEAST_LETTERS, LEAST_COUNT, TIMES = 6, 5, 5

_BASE = np.uint64(0x9E3779B97F4A7C15)
_FIRST = 33  # symbols are printable characters of ASCII from here on


def alphabet(symbols: int) -> str:
    """The symbol of each of LETTERS, in their order."""
    if symbols >= len(LETTERS):
        return "".join(chr(_FIRST + i) for i in range(len(LETTERS)))
    codes = mix(np.arange(len(LETTERS), dtype=np.uint64) + np.uint64(0xC0FFEE)) % np.uint64(symbols)
    return "".join(chr(_FIRST + int(c)) for c in codes)


def words(docs: DataFrame) -> DataFrame:
    """(word, n): the runs of letters, lower-cased and some of them spoilt, with their occurrences; only words that are long and frequent enough."""
    run = F.col("run")
    lower = F.when(F.octet_length(run) == F.char_length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(doc.alias("doc"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    found = runs.where(F.char_length(run) >= LEAST_LETTERS).select("doc", lower.alias("run"))
    hashed = found.select("run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    spoilt = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length("run")))
    kept = hashed.select(F.when(F.col("h") % SPOILT == 0, spoilt).otherwise(run).alias("word")).where(F.char_length("word") >= LEAST_LETTERS)
    return kept.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _reduced(symbols: int) -> Column:
    return F.translate("word", LETTERS, alphabet(symbols))


def choose(vocabulary: DataFrame) -> int:
    """The smallest alphabet that leaves few words to a reduced word."""
    for symbols in SYMBOLS[:-1]:
        sizes = vocabulary.groupBy(_reduced(symbols)).agg(F.count("*").alias("k")).agg(F.coalesce(F.sum(F.col("k") * F.col("k")), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.max("k"), F.lit(0)))
        squares, total, largest = sizes.first()
        if squares <= MOST_SQUARES * total and largest <= MOST_ALIKE:
            return symbols
    return SYMBOLS[-1]


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the batch and their reduced words as a matrix, for each length."""
    texts = [t.encode() for t in batch.column("reduced").to_pylist()]
    sizes = np.array([len(t) for t in texts])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, np.frombuffer(b"".join(texts[i] for i in rows), dtype=np.uint8).reshape(len(rows), size)


def _value(symbol: np.ndarray) -> np.ndarray:
    return mix(symbol.astype(np.uint64) + np.uint64(0x5EED))


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, _BASE, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _code(total: np.ndarray, size: int) -> np.ndarray:
    return mix(total + np.array([size], dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def neighbourhood(m: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the reduced words in m (one a row), and the codes of all words one edit from them: (own code, row, code), each different word once."""
    k, size = m.shape
    values, choices, power = _value(m), _value(np.arange(_FIRST, _FIRST + symbols)), _powers(size + 1)
    before = np.zeros((k, size + 1), dtype=np.uint64)
    for i in range(size):
        before[:, i + 1] = before[:, i] * _BASE + values[:, i]
    after = np.zeros((k, size + 1), dtype=np.uint64)
    for i in range(size - 1, -1, -1):
        after[:, i] = after[:, i + 1] + values[:, i] * power[size - 1 - i]
    own = _code(before[:, size], size)
    rows, codes = [], []

    def add(row: np.ndarray, total: np.ndarray, n: int) -> None:
        rows.append(row), codes.append(_code(total, n))

    for i in range(size):
        # deletions: of equal neighbours only the first, since the others give the same word
        row = np.arange(k) if i == 0 else np.flatnonzero(m[:, i] != m[:, i - 1])
        add(row, before[row, i] * power[size - 1 - i] + after[row, i + 1], size - 1)
        for c in range(symbols):
            row = np.flatnonzero(m[:, i] != c + _FIRST)
            add(row, before[row, i] * power[size - i] + choices[c : c + 1] * power[size - 1 - i] + after[row, i + 1], size)
    for i in range(size + 1):
        # insertions: a symbol goes behind no equal one
        for c in range(symbols):
            row = np.arange(k) if i == 0 else np.flatnonzero(m[:, i - 1] != c + _FIRST)
            add(row, before[row, i] * power[size - i + 1] + choices[c : c + 1] * power[size - i] + after[row, i], size + 1)
    return own, np.concatenate(rows), np.concatenate(codes)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        code = np.zeros(batch.num_rows, dtype=np.uint64)
        for rows, m in _by_length(batch):
            total = np.zeros(len(rows), dtype=np.uint64)
            for i in range(m.shape[1]):
                total = total * _BASE + _value(m[:, i])
            code[rows] = _code(total, m.shape[1])
        yield pa.RecordBatch.from_arrays([batch.column("reduced"), pa.array(code.view(np.int64))], names=["reduced", "code"])


def _nearby(symbols: int):
    """(code, near): each reduced word's code beside the codes of its neighbourhood that are not smaller; the smaller ones are found from the other side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, m in _by_length(batch):
                step = max(1, (1 << 21) // (m.shape[1] * symbols * 2 + 2))
                for i in range(0, len(rows), step):
                    own, row, code = neighbourhood(m[i : i + step], symbols)
                    keep = code > own[row]
                    left, right = np.concatenate((own, own[row[keep]])), np.concatenate((own, code[keep]))
                    yield pa.RecordBatch.from_arrays([pa.array(left.view(np.int64)), pa.array(right.view(np.int64))], names=["code", "near"])

    return run


def near_words(vocabulary: DataFrame, scratch: Scratch, symbols: int | None = None) -> DataFrame:
    """(word, near, near_n) for every two different words of the vocabulary (word, n) that one inserted, deleted or replaced code point separates; both ways."""
    symbols = symbols or choose(vocabulary)
    placed = scratch.keep(vocabulary.select("word", "n", _reduced(symbols).alias("reduced")))
    codes = scratch.keep(placed.select("reduced").distinct().mapInArrow(_coded, "reduced string, code bigint"))
    known = codes.select(F.col("code").alias("near"))
    pairs = codes.select("reduced").mapInArrow(_nearby(symbols), "code bigint, near bigint").join(known, "near").select("code", "near").distinct()  # of codes that two words share
    coded = scratch.keep(placed.join(codes, "reduced").select("code", "word", "n"))
    left = coded.select("code", F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = coded.select(F.col("code").alias("near"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    once = (F.col("code") != F.col("near")) | (F.col("a") < F.col("b"))
    found = pairs.join(left, "code").join(right, "near").where(once & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))))
    return found.select(both.alias("x")).select("x.*")


def variants(docs: DataFrame, symbols: int | None = None) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word.

    Null and empty texts have no words; a null doc_id counts as an empty one. Repeated rows count again. Of near words with the largest n the
    form is the smallest in code-point order. A very long text or run is never cut: a run's neighbourhood grows with its length.
    Other columns are left out; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "variants")
    vocabulary = scratch.keep(words(docs))
    near = near_words(vocabulary, scratch, symbols)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    form_n = -F.col("best.m")
    enough = form_n >= TIMES * F.col("n")
    named = vocabulary.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, form_n).alias("form_n")
    )
    named = scratch.keep(named)
    roots = named.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in count():  # a form has TIMES its word's count, so that a path is as long as the count's logarithm, and each turn doubles what it covers
        roots = scratch.keep(roots)
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = roots.join(further, "root")
        if longer.isEmpty():
            break
        roots = roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
