"""Indexing a corpus: what has changed is chunked, embedded, written and recorded."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.text import estimate_tokens, tokenize
from shelfmark.operators.chunking import build_hierarchy, leaf_budget, split_failures, structured_chunks, with_context
from shelfmark.operators.tables import needs_index, upsert_index
from shelfmark.sources.chunk_store import commit, read_batch, write_batch
from shelfmark.sources.durable import Scratch, durable

EMBED_BATCH = 50
DIMENSIONS = 64
DEFAULT_FOLDER = "default"


def _cell(word: str) -> int:
    """Twice the place of a word in a vector, and one more if it adds one there instead of taking one."""
    h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
    return 2 * (h % DIMENSIONS) + (h >> 63)


#: Cells of words that a task has seen; it is emptied when it is full.
_cells: dict[str, int] = {}
MOST_CELLS = 1 << 17


def hashing_embedder(texts: list[str]) -> list[list[float]]:
    """A deterministic stand-in for a model: signed counts of hashed words, of unit length."""
    each = [text.lower().split() for text in texts]
    words = [word for text in each for word in text]
    cells = list(map(_cells.get, words))
    for i in [i for i, cell in enumerate(cells) if cell is None]:
        cell = _cells.get(words[i])
        if cell is None:
            if len(_cells) >= MOST_CELLS:
                _cells.clear()
            cell = _cells[words[i]] = _cell(words[i])
        cells[i] = cell
    found = np.array(cells, dtype=np.int64)
    at = np.repeat(np.arange(len(texts)), [len(text) for text in each]) * DIMENSIONS + found // 2
    whole = np.bincount(at, found % 2 * 2.0 - 1, len(texts) * DIMENSIONS).reshape(-1, DIMENSIONS)
    return (whole / np.maximum(1e-12, np.sqrt((whole * whole).sum(1, keepdims=True)))).tolist()


def embed_with(embedder: Callable[[list[str]], list[list[float]]] = hashing_embedder, batch: int = EMBED_BATCH) -> Callable[[Column], Column]:
    """A column function that embeds texts batch by batch. Fewer vectors than texts are an error; a transient failure is tried again three times."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import time

        for texts in arrays:
            out: list[pa.Array] = []
            values = [t or "" for t in texts.to_pylist()]
            for i in range(0, len(values), batch):
                part = values[i : i + batch]
                for wait in (1, 2, 4, None):
                    try:
                        vectors = embedder(part)
                        break
                    except (ConnectionError, TimeoutError):
                        if wait is None:
                            raise
                        time.sleep(wait)
                if len(vectors) != len(part):
                    raise ValueError(f"{len(vectors)} vectors for {len(part)} texts")
                out.append(pa.array(vectors, pa.list_(pa.float32())))
            yield pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.float32()))

    run.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, T.ArrayType(T.FloatType()))


def latest_files(files: DataFrame) -> DataFrame:
    """One row a file_id: of repeated ones the last by uploaded_at (where there is such a column), content_hash and text. Only looks at texts where a file_id is repeated."""
    repeated = files.groupBy("file_id").count().where("count > 1").select("file_id")
    if repeated.isEmpty():
        return files
    order = F.struct(*[c for c in ("uploaded_at", "content_hash", "text") if c in files.columns])
    last = files.groupBy("file_id").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in files.columns]), order).alias("row"))
    return last.select("row.*")


def index_corpus(
    files: DataFrame, index: DataFrame, leaf_tokens: int = 256, parent_tokens: int = 2048, force: bool = False, embed: Callable[[Column], Column] | None = None,
    prefix: Callable[[Column], Column] | None = None, segment: Callable[[Column], Column] | None = None, model: str | None = None, now: Column | None = None, path: str | None = None,
) -> dict[str, DataFrame]:
    """leaves, parents and index after indexing the changed files (file_id, content_hash, text[, file_name, folder_id, uploaded_at]); a file without chunks is recorded as failed, and fails alone.

    Texts are split at tables, cut and merged to the budget, and written once; leaves and parents follow from what was written. With `prefix` (a writer of context prefixes) a leaf's text begins
    with its prefix, or the file's name where that fails, and has less room of its own. segment: another segmenter, whose null falls back to the text's own tokens. Of a file_id that is
    repeated the last row counts (`latest_files`).

    path: a table of chunks, where the changed files' leaves and parents (`node_role`) take the place of all they had, in whatever folder, in one commit; a file that has become
    empty loses its chunks, and its chunk_count is 0. Files without folder_id lie in the folder `default`. Without path the leaves are written to the checkpoint folder. Indexing again what the index
    has changes nothing.
    """
    spark = files.sparkSession
    changed = needs_index(latest_files(files), index, force)
    extra = [c for c in ("folder_id", "file_name") if c in files.columns]
    cut = Scratch(spark, "chunks").keep(structured_chunks(changed.select("file_id", "text"), leaf_budget(leaf_tokens, prefix is not None)))
    leaves, parents = build_hierarchy(cut, parent_tokens)
    if extra:
        leaves = leaves.join(changed.select("file_id", *extra), "file_id")
    if prefix is not None:
        leaves = with_context(leaves, prefix(F.col("text")), F.col("file_name") if "file_name" in extra else F.col("file_id")).withColumn("n_tokens", estimate_tokens(F.col("text")))
    own = tokenize(F.col("text"))
    leaves = leaves.withColumn("tokens", own if segment is None else F.coalesce(segment(F.col("text")), own))
    if embed is not None:
        leaves = leaves.withColumn("embedding", embed(F.col("text")))
    if path is not None:
        place = F.coalesce(F.col("folder_id").cast("string"), F.lit(DEFAULT_FOLDER)) if "folder_id" in extra else F.lit(DEFAULT_FOLDER)
        above = parents.join(changed.select("file_id", "folder_id"), "file_id") if "folder_id" in extra else parents
        both = leaves.withColumns({"folder_id": place, "node_role": F.lit("leaf")}).unionByName(above.withColumns({"folder_id": place, "node_role": F.lit("parent")}), allowMissingColumns=True)
        batch = write_batch(both, path)
        written = read_batch(spark, path, batch, both.schema)
        commit(changed, written, path, batch)
        leaves, parents = (written.where(F.col("node_role") == role).select(df.columns) for role, df in (("leaf", leaves), ("parent", parents)))
    else:
        leaves = durable(leaves)
    kept = [c for c in ("folder_id", "content_hash") if c in files.columns]
    fields = [c.alias(name) for c, name in ((F.lit(model), "embedding_model"), (now, "indexed_at")) if c is not None and (name != "embedding_model" or model is not None)]
    counts = leaves.groupBy("file_id").agg(F.count("*").cast("int").alias("chunk_count"))
    done = counts.join(changed.select("file_id", *kept), "file_id").select("file_id", *kept, F.lit("indexed").alias("index_status"), "chunk_count", F.lit(None).cast("string").alias("error"), *fields)
    lost = split_failures(changed, leaves)
    failed = lost.join(changed.select("file_id", *kept), "file_id").select("file_id", *kept, F.lit("failed").alias("index_status"), F.lit(0).alias("chunk_count"), "error", *fields)
    fresh = upsert_index(index, done.unionByName(failed))
    if path is not None:
        gone = F.col("_gone").isNotNull()
        fresh = fresh.join(lost.select("file_id", F.lit(True).alias("_gone")), "file_id", "left").withColumn("chunk_count", F.when(gone, 0).otherwise(F.col("chunk_count"))).select(fresh.columns)
    return {"leaves": leaves, "parents": parents, "index": fresh}


def rebuild_tokens(chunks: DataFrame, file_id: str | None = None) -> DataFrame:
    """Chunks with their tokens made anew, for one file or for all; embeddings stay."""
    fresh = tokenize(F.col("text"))
    return chunks.withColumn("tokens", fresh if file_id is None else F.when(F.col("file_id") == file_id, fresh).otherwise(F.col("tokens")))
