"""Helpers that several operators share: durable intermediate tables, bounded Arrow batches, words and their hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from shelfmark.sources.durable import checkpoint_folder, durable
from shelfmark.sources.files import delete

__all__ = ["Scratch", "Words", "as_bytes", "checkpoint_folder", "durable", "hash_bytes", "hash_words", "logistic", "mix", "small_batches", "steps", "windows"]

#: Rows of an Arrow batch; documents are up to some MB each, so batches stay small.
BATCH_ROWS = 256
#: Bytes of text that one vectorised step takes together; a longer text is a step of its own.
STEP_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class Scratch:
    """Tables of a loop as Parquet in the shared checkpoint folder: their sizes are known, so that Spark sends small ones to all tasks by itself."""

    def __init__(self, spark: SparkSession, name: str = "scratch") -> None:
        self.spark, self.count = spark, 0
        self.path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.path}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Deletes the tables."""
        delete(self.spark, self.path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows from now on, so that a Python worker never holds thousands of long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of each text of an Arrow column; None for null."""
    return column.cast(pa.large_binary()).to_pylist()


def steps(texts: list[bytes], most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of texts that together have at most `most` bytes, or one text that is longer."""
    i, size = 0, 0
    for j, text in enumerate(texts):
        if j > i and size + len(text) > most:
            yield i, j
            i, size = j, 0
        size += len(text)
    if texts:
        yield i, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A number for each byte at each of the first places of a word; the same for further places comes from `_at_place`.
_PLACES = 64


def _at_place(place: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return mix((place.astype(np.uint64) * np.uint64(256) + byte.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


_TABLE = _at_place(*(x.ravel() for x in np.meshgrid(np.arange(_PLACES), np.arange(256), indexing="ij")))


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of several texts, as arrays over all of them.

    data: bytes of all texts, joined by spaces; start, end: each word's place in data; text: the text's index;
    first: index of each text's first word, and one more entry for the end. Arrays over all bytes take up to some ten numbers of
    8 bytes for each byte, of STEP_BYTES at a time (`steps`) or of one longer text.
    """

    def __init__(self, texts: list[bytes], lower: bool = False) -> None:
        joined = b" ".join(texts)
        self.raw = joined.translate(_LOWER) if lower else joined
        self.data = np.frombuffer(self.raw, dtype=np.uint8)
        edge = np.diff(np.concatenate(([True], _SPACE[self.data], [True])).astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.offset = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)))
        self.first = np.searchsorted(self.start, self.offset)
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(texts)), self.count)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: the sum of a scattered number for each byte and its place in the word, scattered again with the length.

        No algebra ties the numbers of different places, so that words made of repeated patterns don't fall together as they do in polynomials.
        """
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        size = self.end - self.start
        first = np.concatenate(([0], np.cumsum(size)))
        byte = self.data[~_SPACE[self.data]]
        place = np.arange(len(byte), dtype=np.int32) - np.repeat(first[:-1].astype(np.int32), size)
        far = np.flatnonzero(place >= _PLACES)
        numbers = _TABLE.take((np.minimum(place, _PLACES - 1) << 8) + byte)
        if len(far):
            numbers[far] = _at_place(place[far], byte[far])
        sums = np.zeros(len(byte) + 1, dtype=np.uint64)
        np.cumsum(numbers, out=sums[1:])
        return mix(sums[first[1:]] - sums[first[:-1]] + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_bytes(word: bytes) -> int:
    """The hash that Words.hashes gives to a word."""
    return int(Words([word]).hashes()[0])


def hash_words(words: Iterable[str]) -> np.ndarray:
    """Hashes of single words, as Words.hashes gives them; each must have no white space."""
    encoded = [w.encode() for w in words]
    return Words(encoded).hashes() if encoded else np.zeros(0, dtype=np.uint64)


def windows(hashes: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each window of n words inside one text, and the index of its first word."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    k = len(hashes) - n + 1
    total = np.zeros(k, dtype=np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    for i in range(n):
        total = total * factor + hashes[i : i + k]
    at = np.flatnonzero(text[:k] == text[n - 1 :])
    return mix(total[at]), at


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton's method with a small ridge: mean and scale of each column of x, and the weights (the constant first)."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.concatenate((np.ones((len(x), 1)), (x - mean) / scale), axis=1)
    w = np.zeros(a.shape[1])
    ridge = np.diag([1e-6] + [0.1] * (len(w) - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w = w + np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge + 1e-9 * np.eye(len(w)), a.T @ (y - p) - ridge @ w)
    return mean, scale, w
