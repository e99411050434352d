"""Quality by compression: zstandard dictionaries of good and of bad text, and the difference that they make to a text's size.

A dictionary is trained on pieces of labelled texts of each class. Every text is cut into pieces of PIECE bytes, all of them, and
each piece is compressed with either dictionary by itself, so that a long text cannot become its own dictionary. The two sums
of sizes give (bad - good) / (bad + good), which a logistic curve, fitted on labelled texts that neither dictionary
has seen, turns into the probability of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, durable, logistic, small_batches

#: Bytes of a piece of text; bytes of a dictionary at most; compression level.
PIECE, DICTIONARY, LEVEL = 1024, 64 << 10, 3
#: Labelled documents that a model is fitted on, at most, and pieces that a dictionary is trained on, at most.
MOST_LABELLED, MOST_PIECES = 20_000, 6_000
#: A document is predicted to be good from this score on.
THRESHOLD = 0.7


@dataclass
class Model:
    """Dictionaries of bad and good text (none where a class has no text), and the curve over the difference of sizes."""

    bad: bytes
    good: bytes
    mean: float
    scale: float
    weights: tuple[float, float]

    def scores(self, difference: np.ndarray) -> np.ndarray:
        x = (difference - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + self.weights[1] * x, -30, 30)))


def held_out() -> Column:
    """Is a row kept for judging? Its crc32 of doc_id as text leaves 2 when divided by 4; a row without doc_id is never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True))


def dictionary(pieces: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary trained on the pieces; where they are too few for training, the pieces themselves."""
    try:
        return zstandard.train_dictionary(size, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-size:]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(content)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)


def differences(texts: list[bytes], bad: bytes, good: bytes) -> np.ndarray:
    """(bad - good) / (bad + good) over the compressed sizes of each text's pieces; 0 for an empty text."""
    by_bad, by_good = _compressor(bad), _compressor(good)
    out = np.zeros(len(texts))
    for i, text in enumerate(texts):
        view = memoryview(text)
        a = b = 0
        for at in range(0, len(text), PIECE):
            a += len(by_bad.compress(view[at : at + PIECE]))
            b += len(by_good.compress(view[at : at + PIECE]))
        out[i] = (a - b) / (a + b) if a + b else 0.0
    return out


def _with_difference(bad: bytes, good: bytes, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = differences([t or b"" for t in as_bytes(batch.column("text"))], bad, good)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column(column), pa.array(found, pa.float64())], names=["doc_id", column, "difference"])

    return run


def _labelled(labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, quality, taught): at most `most` labelled ids by a hash; those not taught from are for the curve. Of an id with two labels the larger counts."""
    usable = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out())
    ids = usable.groupBy("doc_id").agg((F.max("quality") > 0).cast("int").alias("quality"))
    some = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return durable(some.withColumn("taught", F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(2)) == 0))


def _pieces(texts: DataFrame, ids: DataFrame, quality: int, most: int) -> list[bytes]:
    """At most `most` pieces of the class's texts, by a hash of id and place; of a repeated doc_id its longest text's."""
    taught = F.broadcast(ids.where(F.col("taught") & (F.col("quality") == quality)).select("doc_id"))
    long = texts.select("doc_id", F.octet_length("text").alias("size")).join(taught, "doc_id").groupBy("doc_id").agg(F.max("size").alias("size")).where("size > 0")
    places = long.select("doc_id", F.explode(F.sequence(F.lit(0), ((F.col("size") - 1) / PIECE).cast("int"))).alias("place"))
    chosen = durable(places.orderBy(F.xxhash64("doc_id", "place"), "doc_id", "place").limit(most))
    bytes_ = F.substring(F.col("text").cast("binary"), F.col("place") * PIECE + 1, F.lit(PIECE))
    cut = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "place", bytes_.alias("piece")).groupBy("doc_id", "place").agg(F.max("piece").alias("piece"))
    return [bytes(r["piece"]) for r in cut.where(F.octet_length("piece") > 0).orderBy("doc_id", "place").collect()]  # MOST_PIECES pieces of PIECE bytes at most


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, pieces: int = MOST_PIECES) -> Model:
    """Dictionaries from one half of at most `most` labelled rows that are not held out (at most `pieces` pieces a class), the curve from the other half.

    Without labels, or with those of one class only, every text gets the smoothed share of good labels.
    """
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    ids = _labelled(labels, most)
    bad, good = (dictionary(found) if (found := _pieces(texts, ids, q, pieces)) else b"" for q in (0, 1))
    rows = texts.join(F.broadcast(ids.where("NOT taught").select("doc_id", "quality")), "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = None
    if bad and good:
        found = rows.mapInArrow(_with_difference(bad, good, "quality"), f"doc_id {kind}, quality int, difference double")
        sample = found.groupBy("doc_id").agg(F.max("quality").alias("y"), F.max("difference").alias("x")).orderBy("doc_id").toPandas()
    if sample is None or sample["y"].nunique() < 2:
        n, ones = ids.agg(F.count("*"), F.coalesce(F.sum("quality"), F.lit(0))).first()
        return Model(b"", b"", 0.0, 1.0, (float(np.log((ones + 1) / (n - ones + 1))), 0.0))
    mean, scale, weights = logistic(sample[["x"]].to_numpy(dtype=np.float64), sample["y"].to_numpy(dtype=np.float64))
    return Model(bad, good, float(mean[0]), float(scale[0]), (float(weights[0]), float(weights[1])))


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of each document.

    A null text counts as empty; empty texts have no difference and get the curve's value there. Texts are taken as their bytes, so that broken UTF-8 is
    as good as any. A very long text is compressed piece by piece and needs no memory beside itself. Null and repeated doc_ids are ordinary
    rows; equal texts get equal scores; other columns are left out; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in as_bytes(batch.column("text"))]
            found = differences(texts, model.bad, model.good) if model.good else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(found), pa.float64())], names=["doc_id", "score"])

    out = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(scored, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
