"""The life of a table of chunks: files that change, become empty, move, are repeated, and runs that are killed."""

import pytest
from pyspark.sql import functions as F

from shelfmark.plans import index as I
from shelfmark.sources import chunk_store as S
from shelfmark.streaming import jobs as J

FILES = "file_id string, folder_id string, content_hash string, text string"
INDEX = "file_id string, folder_id string, index_status string, content_hash string, chunk_count int, error string"


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], INDEX)


def run(spark, rows, index, path, **options):
    # the index is kept apart from the plan that made it, as a table would be
    out = I.index_corpus(spark.createDataFrame(rows, FILES), index, path=str(path), **options)
    return spark.createDataFrame(out["index"].select("file_id", "folder_id", "index_status", "content_hash", "chunk_count", "error").collect(), INDEX)


def status(index):
    return {r.file_id: (r.folder_id, r.index_status, r.content_hash, r.chunk_count) for r in index.collect()}


def texts(spark, path, role="leaf", folder=None):
    return sorted((r.file_id, r.folder_id, r.text) for r in S.read_chunks(spark, str(path), folder).where(F.col("node_role") == role).collect())


def test_an_emptied_file_fails_and_loses_its_chunks(spark, empty, tmp_path):
    index = run(spark, [("f1", "a", "h1", "One sentence."), ("f2", "a", "h1", "Another.")], empty, tmp_path)
    index = run(spark, [("f1", "a", "h2", " \n"), ("f2", "a", "h1", "Another.")], index, tmp_path)
    assert status(index) == {"f1": ("a", "failed", "h1", 0), "f2": ("a", "indexed", "h1", 1)}
    assert texts(spark, tmp_path) == [("f2", "a", "Another.")] and texts(spark, tmp_path, "parent") == [("f2", "a", "Another.")]
    index = run(spark, [("f1", "a", "h2", "Back again.")], index, tmp_path)  # a failed file is tried anew
    assert status(index)["f1"] == ("a", "indexed", "h2", 1)


def test_a_moved_file_lies_in_one_folder(spark, empty, tmp_path):
    index = run(spark, [("f1", "a", "h1", "Old place."), ("f3", "007", "h", "Stays.")], empty, tmp_path)
    index = run(spark, [("f1", "b", "h2", "New place.")], index, tmp_path)
    assert texts(spark, tmp_path) == [("f1", "b", "New place."), ("f3", "007", "Stays.")]
    assert texts(spark, tmp_path, folder="a") == [] and texts(spark, tmp_path, folder="007") == [("f3", "007", "Stays.")]
    assert status(index)["f1"] == ("b", "indexed", "h2", 1)


def test_of_a_repeated_file_the_last_counts(spark, empty, tmp_path):
    index = run(spark, [("f1", "a", "h1", "First text."), ("f1", "a", "h2", "Second text."), ("g", "a", "h", "Other.")], empty, tmp_path)
    assert status(index) == {"f1": ("a", "indexed", "h2", 1), "g": ("a", "indexed", "h", 1)}
    assert texts(spark, tmp_path) == [("f1", "a", "Second text."), ("g", "a", "Other.")]


def test_files_without_folder(spark, empty, tmp_path):
    files = spark.createDataFrame([("f", "h", "A text.")], "file_id string, content_hash string, text string")
    out = I.index_corpus(files, empty, path=str(tmp_path))
    assert out["leaves"].count() == out["parents"].count() == 1
    assert texts(spark, tmp_path) == [("f", I.DEFAULT_FOLDER, "A text.")]


def test_leaves_and_parents_are_committed_together(spark, empty, tmp_path, monkeypatch):
    index = run(spark, [("f1", "a", "h1", "Old.")], empty, tmp_path)
    monkeypatch.setattr(I, "commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):  # killed between the rows and their commit
        run(spark, [("f1", "a", "h2", "New.")], index, tmp_path)
    assert texts(spark, tmp_path) == texts(spark, tmp_path, "parent") == [("f1", "a", "Old.")]
    monkeypatch.undo()
    (tmp_path / "commits" / "1").mkdir()  # killed while the commit was written
    assert texts(spark, tmp_path) == [("f1", "a", "Old.")]
    index = run(spark, [("f1", "a", "h2", "New.")], index, tmp_path)
    assert texts(spark, tmp_path) == texts(spark, tmp_path, "parent") == [("f1", "a", "New.")]


def test_compaction_keeps_what_is_there(spark, empty, tmp_path):
    index = empty
    for k in range(3):
        index = run(spark, [("f1", "a", f"h{k}", f"Text {k}."), (f"g{k}", "b", "h", "Same.")], index, tmp_path)
    index = run(spark, [("g0", "b", "x", "")], index, tmp_path)
    before = texts(spark, tmp_path)
    S.compact(spark, str(tmp_path))
    assert texts(spark, tmp_path) == before == [("f1", "a", "Text 2."), ("g1", "b", "Same."), ("g2", "b", "Same.")]
    assert len(list((tmp_path / "data").glob("batch=*"))) == len([p for p in (tmp_path / "commits").iterdir() if p.is_dir()]) == 1
    run(spark, [("f1", "a", "h9", " ")], index, tmp_path)
    assert [t for t in texts(spark, tmp_path) if t[0] == "f1"] == []


def test_nothing_but_empty_files(spark, empty, tmp_path):
    index = run(spark, [("f1", "a", "h1", " ")], empty, tmp_path)
    assert status(index) == {"f1": ("a", "failed", None, 0)} and S.read_chunks(spark, str(tmp_path)).count() == 0


def test_tokens_are_counted_with_the_prefix(spark, empty, tmp_path):
    files = spark.createDataFrame([("f", "a", "h", "A text.")], FILES)
    bare = I.index_corpus(files, empty)["leaves"].first()
    long = I.index_corpus(files, empty, prefix=lambda t: F.lit("what this is about " * 5))["leaves"].first()
    assert long.n_tokens > bare.n_tokens


def test_a_half_written_version_does_not_stop_the_stream(spark, empty, tmp_path):
    schema = f"{FILES}, file_name string"
    spark.createDataFrame([("f", "en", "h1", "One.", "f.txt")], schema).write.parquet(str(tmp_path / "in"))
    (tmp_path / "index" / "v=0").mkdir(parents=True)
    (tmp_path / "index" / "v=0" / "part-0.parquet").write_bytes(b"half")
    J.auto_index_corpus(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "index"), str(tmp_path / "chunks"), str(tmp_path / "c"), empty).awaitTermination()
    assert status(spark.read.parquet(str(tmp_path / "index/v=0"))) == {"f": ("en", "indexed", "h1", 1)}


def test_the_embedder_gives_signed_counts_of_hashed_words(monkeypatch):
    """Each word is hashed once while it is kept; vectors are those of a plain count, also when words are forgotten."""
    import hashlib

    import numpy as np

    from shelfmark.plans import index as I

    texts = ["", " ", "a A b", *[" ".join(f"W{i * k % 31}" for k in range(i)) for i in range(1, 60)]]
    expected = []
    for text in texts:
        v = np.zeros(I.DIMENSIONS)
        for word in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            v[h % I.DIMENSIONS] += 1 if h >> 63 else -1
        expected.append((v / max(1e-12, float(np.linalg.norm(v)))).tolist())
    hashed, plain = [], hashlib.blake2b
    monkeypatch.setattr(hashlib, "blake2b", lambda word, **k: hashed.append(word) or plain(word, **k))
    I._cells.clear()
    assert I.hashing_embedder(texts) == expected and len(hashed) == len(set(hashed)) == 33
    monkeypatch.setattr(I, "MOST_CELLS", 5)
    assert I.hashing_embedder(texts) == expected
