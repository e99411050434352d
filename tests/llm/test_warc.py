import gzip
import hashlib
from collections import Counter
from pathlib import Path

import pytest

from shelfmark.llm import warc

BIG = "x\r\n" * 50_000 + "\r\ny\r"
ROWS = [
    (1, "u\r\nv", BIG), (2, None, BIG), (3, "a", None), (4, "b", "short"), (5, "b", "short"), (None, "b", BIG), (6, "u", "é" * 70_000 + "\r\n"), (7, "u", "\r\n" * 100),
    (8, "u", "HTTP\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nabc" * 10), (9, "u", ""), (10, "u", "z" * 65_536), (11, "u", "z" * 65_537), (1, "u", BIG),
]


def expected(rows):
    first = {}
    for i, _, h in rows:
        body = (h or "").encode()
        if len(body) >= 100 and i is not None:
            first[body] = min(first.get(body, i), i)
    out = Counter()
    for i, _, h in rows:
        body = (h or "").encode()
        again = body in first and first[body] != i
        out[i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[body] if again else None] += 1
    return out


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, "t") for r in ROWS], "page_id long, url string, html string, record_type string")
    out = warc.round_trip(pages)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out.collect()) == expected(ROWS)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_chunks_are_bounded_and_carry_digests(spark):
    pages = spark.createDataFrame([ROWS[0]], "page_id long, url string, html string")
    rows = warc.record_table(pages).orderBy("chunk_no").collect()
    assert len(rows) == 3 and max(len(r.data) for r in rows) <= warc.CHUNK
    running = hashlib.sha256()
    for r in rows:
        running.update(r.data)
        assert r.digest_so_far == running.hexdigest()
    assert rows[-1].digest_so_far == rows[0].payload_digest


def test_archive_follows_the_format(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://x/", "y" * 70_000)], "page_id long, url string, html string").coalesce(1)
    warc.write(pages, str(tmp_path / "w"))
    data = gzip.decompress(next(Path(tmp_path / "w").glob("*.gz")).read_bytes())
    at, kinds, length = 0, [], 0
    while at < len(data):
        head, _, _ = data[at:].partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        n = int(fields[b"Content-Length"])
        kinds.append(fields[b"WARC-Type"])
        length += n
        at += len(head) + 4 + n
        assert data[at : at + 4] == b"\r\n\r\n"
        at += 4
    assert kinds == [b"response", b"continuation"]
    assert int(fields[b"WARC-Segment-Total-Length"]) == length


def test_ids_of_any_type_and_damage(spark, tmp_path):
    body = "some words of a page " * 20
    pages = spark.createDataFrame([("a b>/é", "u", body), (None, "u", body), ("", "u", "x"), ("b", "u", body)], "page_id string, url string, html string").coalesce(1)
    found = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    assert found == Counter([("a b>/é", "response", None), (None, "revisit", "a b>/é"), ("", "response", None), ("b", "revisit", "a b>/é")])
    warc.write(pages.where("page_id = 'b'"), str(tmp_path / "w"))
    data = gzip.decompress(next(Path(tmp_path / "w").glob("*.gz")).read_bytes())
    assert b"WARC-Block-Digest: sha256:" in data and b"X-Payload-Digest-So-Far: sha256:" in data
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.warc.gz").write_bytes(gzip.compress(data.replace(b"some words of", b"same words of", 1)))
    with pytest.raises(Exception, match="damaged record"):
        warc.read(spark, str(tmp_path / "bad"), "string").collect()
