"""WARC archives through a chunked record table.

A payload becomes rows of record identifier and chunk number, each with a part of bounded size and the digest of the payload
so far; no step builds a record as a whole. Each row is written as a WARC record of its own: the first chunk as
`response`, the others as `continuation` records of the same segmented record. Payloads that occurred before are
`revisit` records. Every record carries the digest of its block, and each segment also the payload's digest so far, so that a
damaged chunk is told where it stands. Spark's text writer writes the archives, since records end with two line breaks, and its reader
streams them back line by line; the digests are taken again while the lines go by and held against those written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, durable, small_batches

#: Bytes of a chunk; bytes of chunks that are handed on together.
CHUNK, TOGETHER = 64 << 10, 4 << 20
#: Equal payloads of this many bytes are written once.
LEAST_BYTES = 100
#: Digests that are sent to all tasks at most (about 100 bytes each); beyond, payloads are joined to them.
MOST_BROADCAST = 500_000
#: Archives have a fixed date, so that the same pages give the same bytes.
DATE = "2024-01-01T00:00:00Z"
_END = "\r\n"


def payload(pages: DataFrame) -> DataFrame:
    """page_id, url and payload (binary; empty for null), its size and digest."""
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    return pages.select("page_id", F.col("url").cast("string").alias("url"), body.alias("payload")).select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "refers_to", "chunk_no", "digest_so_far", "data"]
    for batch in batches:
        column = batch.column("payload")
        rows: list[int] = []
        numbers: list[int] = []
        digests: list[str] = []
        data: list[memoryview] = []
        size = 0

        def out() -> pa.RecordBatch:
            at = pa.array(rows, pa.int32())
            arrays = [batch.column(n).take(at) for n in names[:5]] + [pa.array(numbers, pa.int64()), pa.array(digests, pa.string()), pa.array(data, pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for i in range(batch.num_rows):
            view = memoryview(column[i].as_buffer())
            revisit = batch.column("is_revisit")[i].as_py()
            running = hashlib.sha256()
            for k, start in enumerate(range(0, 1 if revisit else max(1, len(view)), CHUNK)):
                part = view[start : start + CHUNK] if not revisit else view[:0]
                running.update(part)
                rows.append(i), numbers.append(k), digests.append(running.hexdigest()), data.append(bytes(part))
                size += len(part)
                if size >= TOGETHER:
                    yield out()
                    rows, numbers, digests, data, size = [], [], [], [], 0
        if rows:
            yield out()


def record_table(pages: DataFrame) -> DataFrame:
    """A row for each chunk: page_id, url, payload_bytes, payload_digest, refers_to, is_revisit, chunk_no, digest_so_far, data.

    Of equal payloads of LEAST_BYTES or more, that with the smallest page_id is written; the others refer to it and have one chunk without data. Rows
    that repeat that page_id are written as well. Rows of a payload follow each other.
    """
    small_batches(pages.sparkSession)
    bodies = payload(pages)
    # only digests and ids are grouped; payloads move if the digests that occur again are too many for a broadcast
    firsts = bodies.select("page_id", "payload_bytes", "payload_digest").where(F.col("payload_bytes") >= LEAST_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL").select("payload_digest", "refers_to")
    firsts = durable(firsts)
    if firsts.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        firsts = F.broadcast(firsts)
    joined = bodies.join(firsts, "payload_digest", "left")
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    kind = pages.schema["page_id"].dataType.simpleString()
    marked = joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(revisit, F.col("refers_to")).alias("refers_to"), revisit.alias("is_revisit"))
    return marked.mapInArrow(_chunked, f"page_id {kind}, url string, payload_bytes bigint, payload_digest string, refers_to {kind}, chunk_no bigint, digest_so_far string, data binary")


def _written_id(column: str) -> Column:
    """An id as part of a URN: `id-` and its text, encoded as in a URL; `none` for null."""
    return F.coalesce(F.concat(F.lit("id-"), F.url_encode(F.col(column).cast("string"))), F.lit("none"))


def _record() -> Column:
    """A chunk's row as a WARC record, without the two line breaks at its end."""

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(_END))

    urn = F.concat(F.lit("<urn:page:"), _written_id("page_id"))
    first = F.col("chunk_no") == 0
    revisit = F.col("refers_to").isNotNull()
    last = (F.col("chunk_no") + 1) * CHUNK >= F.col("payload_bytes")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(_END + _END))
    block = F.when(first, F.concat(http.cast("binary"), F.col("data"))).otherwise(F.col("data"))
    url = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    none = F.lit("")
    head = F.concat(
        F.lit(f"WARC/1.1{_END}"),
        line("WARC-Type", F.when(~first, F.lit("continuation")).when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(urn, F.when(first, F.lit(">")).otherwise(F.concat(F.lit(":"), (F.col("chunk_no") + 1).cast("string"), F.lit(">"))))),
        line("WARC-Date", F.lit(DATE)),
        F.when(first, F.coalesce(line("WARC-Target-URI", url), none)).otherwise(line("WARC-Segment-Origin-ID", F.concat(urn, F.lit(">")))),
        F.when(first, line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest")))).otherwise(none),
        F.coalesce(F.when(first & revisit, F.concat(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), _written_id("refers_to"), F.lit(">"))), F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{_END}"))), none),
        F.when(~first | ~last & ~revisit, line("WARC-Segment-Number", (F.col("chunk_no") + 1).cast("string"))).otherwise(none),
        F.when(~first & last, line("WARC-Segment-Total-Length", (F.octet_length(http) + F.col("payload_bytes")).cast("string"))).otherwise(none),
        F.when(first, F.lit(f"Content-Type: application/http; msgtype=response{_END}")).otherwise(none),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2(block, 256))),
        F.when(revisit, none).otherwise(line("X-Payload-Digest-So-Far", F.concat(F.lit("sha256:"), F.col("digest_so_far")))),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(_END),
    )
    return F.concat(head.cast("binary"), block)


def write(pages: DataFrame, path: str) -> None:
    """Writes archives (one for each task, compressed) into the folder path. A null url is left out; line breaks in one are percent-encoded."""
    records = record_table(pages).select(_record().cast("string").alias("value"))
    records.write.option("lineSep", _END + _END).option("compression", "gzip").text(path)


class _Reader:
    """Follows the lines of archives; gives a row when a record and its continuations have ended."""

    def __init__(self) -> None:
        self.head: dict[bytes, bytes] | None = None
        self.left = -1  # bytes of the block to come; -1: between records
        self.http = False
        self.page: tuple[bytes, dict[bytes, bytes]] | None = None
        self.size, self.digest, self.announced = 0, hashlib.sha256(), b""
        self.block, self.expected = hashlib.sha256(), (b"", b"")  # of the record that is read

    def check(self) -> None:
        """At a block's end: are its digest and the payload's so far those that the record has?"""
        block, so_far = self.expected
        if block and block != b"sha256:" + self.block.hexdigest().encode() or so_far and so_far != b"sha256:" + self.digest.hexdigest().encode():
            raise ValueError(f"a damaged record of {self.page[0].decode()}")

    def finished(self) -> tuple | None:
        if self.page is None:
            return None
        identity, head = self.page
        self.page = None
        refers = head.get(b"warc-refers-to", b"")[len("<urn:page:") : -1]
        if head[b"warc-type"] == b"revisit":
            return identity, int(self.announced), head[b"warc-payload-digest"].removeprefix(b"sha256:").decode(), "revisit", refers
        return identity, self.size, self.digest.hexdigest(), "response", b""

    def line(self, line: bytes) -> tuple | None:
        row = None
        if self.left >= 0:
            self._block(line)
        elif self.head is None:
            if line.startswith(b"WARC/"):
                self.head = {}
        elif line:
            name, _, value = line.partition(b": ")
            self.head[name.lower()] = value
        else:
            head, self.head = self.head, None
            self.left = int(head[b"content-length"])
            self.block, self.expected = hashlib.sha256(), (head.get(b"warc-block-digest", b""), head.get(b"x-payload-digest-so-far", b""))
            if head[b"warc-type"] != b"continuation":
                row = self.finished()
                self.page = (head[b"warc-record-id"][len("<urn:page:") : -1], head)
                self.size, self.digest, self.announced, self.http = 0, hashlib.sha256(), b"0", True
        return row

    def _block(self, line: bytes) -> None:
        """One line of a block; the line break after it belongs to the block unless that ends with the line."""
        more = len(line) < self.left
        self.block.update(line + b"\r\n" if more else line)
        if self.http:
            if line.lower().startswith(b"content-length: "):
                self.announced = line[16:]
            self.http = line != b""
        else:
            self.digest.update(line)
            self.size += len(line)
            if more:
                self.digest.update(b"\r\n")
                self.size += 2
        self.left -= len(line) + 2 * more
        if not more:
            self.left = -1
            self.check()
        elif self.left == 0 and not self.http:
            pass  # the block ends with a line break: an empty rest follows


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = _Reader()

    def out(rows: list[tuple]) -> pa.RecordBatch:
        ids, sizes, digests, kinds, refers = zip(*rows, strict=True)
        name = lambda values: pa.array([unquote_plus(v[3:].decode()) if v.startswith(b"id-") else None for v in values], pa.string())
        return pa.RecordBatch.from_arrays([name(ids), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(kinds, pa.string()), name(refers)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    for batch in batches:
        rows = [row for line in batch.column("value").to_pylist() if (row := reader.line(line)) is not None]
        if rows:
            yield out(rows)
    if (row := reader.finished()) is not None:
        yield out([row])


def read(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record in the archives of the folder path; digests are taken from the bytes read.

    A record whose bytes don't have the digests that it was written with is an error.
    """
    small_batches(spark)
    lines = spark.read.option("lineSep", _END).text(path).select(F.col("value").cast("binary").alias("value"))
    rows = lines.mapInArrow(_lines, "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string")
    return rows.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages' archives in the shared checkpoint folder and reads them back; the archives stay there.

    A null html is an empty payload; a null page_id is read back as null and never referred to; repeated page_ids
    give a record for each row. An empty table gives no record.
    """
    path = Scratch(pages.sparkSession, "warc").path
    write(pages, path)
    return read(pages.sparkSession, path, pages.schema["page_id"].dataType.simpleString())
