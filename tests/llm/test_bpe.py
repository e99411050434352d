import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from shelfmark.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as file:
        ranks = bpe.read_ranks(file.read())
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.Coder(ranks)


def test_pieces_and_merges_match_the_library(reference):
    encoding, coder = reference
    rng = random.Random(5)
    letters = list("abstmdrvel'' ''  \n\t.,!?019ÀéД漢  \x1c\x85 ½²😀'llreve\r")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    texts += ["", "x" * 5000, "'" * 50, "ab " * 3000, " " * 1000, "'re", "'r", "'v 've", "it's'll 's", "é" * 300 + "\n\n", "don't 've\n'd"]
    for text, pieces in zip(texts, bpe.split([t.encode() for t in texts]), strict=True):
        ids = coder.encode(pieces)
        assert list(memoryview(ids).cast("I")) == encoding.encode_ordinary(text), repr(text)
        assert coder.decode(ids) == text.encode()
        assert b"".join(pieces) == text.encode()


def test_cache_generations(reference, monkeypatch):
    encoding, _ = reference
    monkeypatch.setattr(bpe, "CACHE_PIECES", 10)
    with open(PATH, "rb") as file:
        coder = bpe.Coder(bpe.read_ranks(file.read()))
    text = " ".join(f"word{i % 37} xyzzy{i}" for i in range(400))
    assert list(memoryview(coder.encode(bpe.split([text.encode()])[0])).cast("I")) == encoding.encode_ordinary(text)


def test_table(spark, reference):
    encoding, _ = reference
    texts = {1: None, 2: "", 3: "Hello there's some text\n\n  and more", 4: "x" * 100_000, 5: "naïve 漢字 😀"}
    docs = spark.createDataFrame([(k, t, 0) for k, t in texts.items()] + [(None, "a", 0), (3, texts[3], 0)], "doc_id long, text string, n_tokens int")
    rows = bpe.round_trip(docs, PATH).collect()
    assert len(rows) == 7
    for r in rows:
        text = (texts[r.doc_id] if r.doc_id else "a") or ""
        ids = encoding.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0
    row = bpe.encode(docs.where("doc_id = 3").limit(1), PATH, offsets=True).first()
    assert list(memoryview(bytes(row.ends)).cast("I"))[-1] == len(texts[3].encode())
