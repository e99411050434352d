"""Quality rules by repetition coverage: how many characters lie inside repeated n-grams and repeated lines.

Every batch of texts is turned into arrays of word hashes; a rolling hash is made for several n-gram lengths at once,
and a sort finds the windows that occur again in the same text. Characters covered by such windows, or by lines that
occurred before, are set against all characters of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, as_bytes, mix, small_batches, steps, windows

#: Largest share of a text's word characters inside n-grams (n: share) that occur twice or more.
COVERAGE = {2: 0.60, 3: 0.50, 5: 0.35, 7: 0.32, 10: 0.30}
#: Largest share of a text's line characters in lines equal to an earlier one.
LINES = 0.30
#: Largest number of symbols for each word.
SYMBOLS = 0.30
#: The base rules: words at least, and percent of words in repeated 3-word windows at most.
LEAST_WORDS, MOST_REPEATED = 50, 50

#: Bytes of UTF-8 that begin no character.
_CONTINUES = bytes(range(0x80, 0xC0))
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True

MEASURES = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("dup_line_chars", pa.float64())] + [(f"dup_{n}gram_chars", pa.float64()) for n in COVERAGE]
_DDL = ", ".join(f"{name} {'bigint' if kind == pa.int64() else 'double'}" for name, kind in MEASURES)


def _covered(words: Words, hashes: np.ndarray, n: int) -> np.ndarray:
    """For each word: is it inside an n-word window that occurs twice or more in its text?"""
    grams, at = windows(hashes, words.text, n)
    keys = mix(grams + words.text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    same = np.diff(keys[order]) == 0
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.bincount(at[twice], minlength=len(hashes) + n + 1)
    edge -= np.bincount(at[twice] + n, minlength=len(hashes) + n + 1)
    return np.cumsum(edge)[: len(hashes)] > 0


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """All measures of each text, by name."""
    words = Words(texts)
    hashes, k = words.hashes(), len(texts)
    char = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))
    chars = char[words.end] - char[words.start]
    symbol = np.concatenate(([0], np.cumsum(_SYMBOL[words.data])))
    at = np.minimum(words.offset, len(words.data))
    out = {"n_words": words.count, "word_chars": np.bincount(words.text, chars, k), "n_symbols": symbol[at[1:]] - symbol[at[:-1]]}
    repeated, repeated_chars = np.zeros(k, dtype=np.int64), np.zeros(k)
    for i, text in enumerate(texts):
        seen: set[bytes] = set()
        total = again = 0
        for line in text.split(b"\n"):
            if line and not line.isspace():
                size = len(line) if line.isascii() else len(line.translate(None, _CONTINUES))
                total += size
                if line in seen:
                    repeated[i] += 1
                    again += size
                else:
                    seen.add(line)
        repeated_chars[i] = again / total if total else 0
    out |= {"n_dup_lines": repeated, "dup_line_chars": repeated_chars}
    for n in COVERAGE:
        covered = _covered(words, hashes, n)
        if n == 3:
            out["n_repeat_words"] = np.bincount(words.text[covered], minlength=k)
        out[f"dup_{n}gram_chars"] = np.bincount(words.text[covered], chars[covered], k) / np.maximum(out["word_chars"], 1)
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or b"" for t in as_bytes(batch.column("text"))]
        for i, j in steps(texts):
            found = measure(texts[i:j])
            kept = [batch.column(c).slice(i, j - i) for c in range(batch.num_columns) if batch.schema.names[c] != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(found[n].astype(np.int64) if t == pa.int64() else found[n], t) for n, t in MEASURES], names=names + [n for n, _ in MEASURES])


def _verdict(m: dict) -> tuple:
    """Do the base rules fail, and is the text poor otherwise? From measures by name, as numpy arrays or columns."""
    failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"])
    poor = (m["dup_line_chars"] > LINES) | (m["n_symbols"] > SYMBOLS * m["n_words"])
    for n, most in COVERAGE.items():
        poor = poor | (m[f"dup_{n}gram_chars"] > most)
    return failed, poor


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed and kept for each document.

    A null text has no words, as an empty one: base_failed. Null and repeated doc_ids are ordinary rows; other columns
    are left out. kept is false if the base rules fail, or more of the text is repeated, or more symbols stand
    in it, than COVERAGE, LINES and SYMBOLS allow.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_measured, f"doc_id {kind}, {_DDL}")
    failed, poor = _verdict({n: F.col(n) for n, _ in MEASURES})
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~poor)


def _passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or b"" for t in as_bytes(batch.column("text"))]
        keep: list[np.ndarray] = []
        for i, j in steps(texts):
            failed, poor = _verdict(measure(texts[i:j]))
            keep.append(~(failed | poor))
        yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, dtype=bool)))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that `quality` keeps, with all their columns whatever their names; one pass without a join.

    Null texts go, as empty ones do; null and repeated doc_ids are ordinary rows; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_passing, docs.schema)
