"""Benchmark decontamination by template canonicalisation.

Numbers, names and units in documents and benchmark items become typed placeholders; runs of one placeholder count
as one. Windows of five such tokens are joined by hash. A document leaks an item if most of the item's windows occur in
it; the values in the slots then tell an exact copy from a question with other parameters: each value of the item
must stand for one value of the document throughout.

An item without any such window (few words, mostly placeholders, a script without spaces) has a path of its own: its whole
text, as lower-case words, or characters where the script has no spaces, must stand in the document in one run.

The join runs in Spark, whatever the benchmark's size. Documents only send windows that a bitmap of fixed size (built from
all windows of the benchmark) lets through, so that the shuffle has the size of the matches. A document that has a share of
an item's windows has one at least of the rarest of them, a few more than the rest of that share; only these are joined by hash alone. What
they find, pairs of a document and an item, is then joined by document and hash, so that a stem which many items and
documents share makes no pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, Words, as_bytes, durable, hash_words, mix, small_batches, steps

WINDOW = 5
#: Share of an item's windows that a leaking document has.
COVERAGE = 0.8
#: log2 of the bitmap's bits: 8 MB for any benchmark.
BITS = 26

# Units and spelled-out numbers that become placeholders.
UNITS = "mm cm m km mg g kg t ml l s sec second seconds min minute minutes h hour hours day days week weeks month months year years mile miles foot feet inch inches yard yards pound pounds ounce ounces dollar dollars cent cents euro euros percent degree degrees metre metres meter meters liter liters litre litres gram grams kilogram kilograms kilometer kilometers kilometre kilometres usd eur gbp".split()
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()

_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0x1111111111111111, 0x2222222222222222, 0x3333333333333333))
_UNIT_HASH, _NUMBER_HASH = np.sort(hash_words(UNITS)), np.sort(hash_words(NUMBERS))
#: Bytes that are neither letters nor digits of ASCII, nor parts of other characters, separate tokens.
_PLAIN = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".?!:;\n\"(")] = True


#: Punctuation outside ASCII, and characters of scripts without spaces (Thai to Khmer, kana, Chinese, Hangul, wide forms, beyond the basic plane).
_MARK = re.compile(rb"\xe2[\x80\x81][\x80-\xbf]|\xe3\x80[\x80-\xbf]")
_CHARACTER = re.compile(rb"(?:\xe0[\xb8-\xbb]|\xe1[\x80-\x82\x9e\x9f]|[\xe3-\xed\xef][\x80-\xbf]|\xf0[\x80-\xbf]{2})[\x80-\xbf]")


def _within(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


class Templates:
    """Canonical tokens of several texts: token and value (hashes), slot (is it a placeholder?), text."""

    def __init__(self, texts: list[bytes]) -> None:
        original = np.frombuffer(b" ".join(texts), dtype=np.uint8)
        words = Words([t.translate(_PLAIN) for t in texts], lower=True)
        value, token = words.hashes(), words.hashes()
        digits = np.concatenate(([0], np.cumsum(_DIGIT[words.data])))
        stops = np.concatenate(([0], np.cumsum(_STOP[original])))
        before = np.concatenate(([0], words.end[:-1])) if len(words.end) else words.end
        begins = (stops[words.start] > stops[before]) | np.concatenate(([True], words.text[1:] != words.text[:-1]))[: len(words.text)]
        head = original[words.start] if len(words.start) else original
        second = original[np.minimum(words.start + 1, len(original) - 1)] if len(words.start) else original
        capital = (head >= 65) & (head <= 90) | (head == 0xC3) & (second >= 0x80) & (second <= 0x9E)
        number = (digits[words.end] > digits[words.start]) | _within(token, _NUMBER_HASH)
        unit = ~number & _within(token, _UNIT_HASH)
        name = capital & ~begins & ~number & ~unit
        token[number], token[unit], token[name] = _NUMBER, _UNIT, _NAME
        slot = number | unit | name
        # a run of one placeholder is one token, whose value is that of all its words
        follows = np.zeros(len(token), dtype=bool)
        follows[1:] = slot[1:] & (token[1:] == token[:-1]) & (words.text[1:] == words.text[:-1])
        keep = np.flatnonzero(~follows)
        if len(keep):
            rank = np.arange(len(token), dtype=np.uint64)
            value = np.add.reduceat(mix(value + np.where(follows, rank - rank[keep][np.cumsum(~follows) - 1], np.uint64(0))), keep)
        self.token, self.value, self.slot, self.text, self.capital = token[keep], value, slot[keep], words.text[keep], capital[keep]
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first token of each window of WINDOW tokens with at least two words that are no placeholders; a shorter text has none (see `_short_leaks`)."""
        n = len(self.token)
        k = max(0, n - WINDOW + 1)
        total, plain = np.zeros(k, dtype=np.uint64), np.zeros(k, dtype=np.int64)
        for i in range(WINDOW if k else 0):
            total = mix(total + self.token[i : i + k])
            plain += ~self.slot[i : i + k]
        at = np.flatnonzero((self.text[:k] == self.text[WINDOW - 1 :][:k]) & (plain >= 2))
        return total[at], at

    def opening_names(self) -> None:
        """Makes a text's first word a name if it has a capital: so it looks where the text stands inside a sentence."""
        first = self.first[:-1][self.first[:-1] < self.first[1:]]
        first = first[self.capital[first] & ~self.slot[first]]
        self.token[first], self.slot[first], self.value[first] = _NAME, True, 0  # its value is not compared


def _emits(df: DataFrame, identity: str) -> str:
    return f"hash bigint, id {df.schema[identity].dataType.simpleString()}, pos int, slots array<bigint>"


def _join(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """A join by columns in which null equals null."""
    named = right.select(*[F.col(c).alias(f"_{c}" if c in names else c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names])
    return left.join(named, same, how).drop(*[f"_{n}" for n in names])


def _emitted(identity: str, shared):
    """Windows of each text; with a bitmap only those that it lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = None if shared is None else np.frombuffer(shared.value, dtype=np.uint8)
        for batch in batches:
            texts = [t or b"" for t in as_bytes(batch.column("text"))]
            ids = batch.column(identity)
            for i, j in steps(texts):
                found = Templates(texts[i:j])
                hashes, at = found.windows()
                if bitmap is None:
                    found.opening_names()
                    others, places = found.windows()
                    opening = places == found.first[found.text[places]]
                    hashes, at = np.concatenate((hashes, others[opening])), np.concatenate((at, places[opening]))
                if bitmap is not None:
                    place = hashes >> np.uint64(64 - BITS)
                    ok = np.flatnonzero(bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
                    hashes, at = hashes[ok], at[ok]
                texts_of = found.text[at]
                grid = at[:, None] + np.arange(WINDOW)
                values = np.where(found.slot[grid], found.value[grid], np.uint64(0)) if len(at) else np.zeros((0, WINDOW), dtype=np.uint64)
                slots = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * WINDOW, pa.int32()), pa.array(values.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), ids.slice(i, j - i).take(pa.array(texts_of)), pa.array(at - found.first[texts_of], pa.int32()), slots],
                    names=["hash", "id", "pos", "slots"],
                )

    return run


def _bitmap(windows: DataFrame) -> bytes:
    """2**BITS bits, one for the leading bits of each window's hash; 2**BITS / 64 rows of two numbers come to the driver at most (16 MB)."""
    place = F.shiftrightunsigned("hash", 64 - BITS)
    rows = windows.groupBy((place / 64).cast("long").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int"))).alias("bits")).toArrow()
    words = np.zeros((1 << BITS) // 64, dtype=np.int64)
    words[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return words.tobytes()


def _units(texts: list[bytes]) -> Words:
    """Lower-case words and numbers; each character of a script without spaces is one of its own."""
    return Words([_CHARACTER.sub(rb" \g<0> ", _MARK.sub(b" ", t.translate(_PLAIN))) for t in texts], lower=True)


def _runs(words: Words, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(size, hashes of the runs of that many units from each place on) for the sizes 1, 2, 4 ... `most`; runs over the end of a text are among them."""
    size, hashes = 1, words.hashes()
    while size <= most and len(hashes):
        yield size, mix(hashes + np.uint64(size))
        hashes = mix(mix(hashes[:-size]) + hashes[size:])
        size *= 2


def _short_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two runs of a power of two units that together cover each text without windows: from its first unit on, and up to its last."""
    for batch in batches:
        texts = [t or b"" for t in as_bytes(batch.column("text"))]
        ids = batch.column("item_id")
        for i, j in steps(texts):
            found = Templates(texts[i:j])
            windows = np.bincount(found.text[found.windows()[1]], minlength=j - i)
            words = _units(texts[i:j])
            short = np.flatnonzero((windows == 0) & (words.count > 0))
            size = 1 << np.floor(np.log2(np.maximum(words.count, 1))).astype(np.int64)
            for each, hashes in _runs(words, int(size[short].max(initial=0))):
                mine = short[size[short] == each]
                offset = np.concatenate((np.zeros(len(mine), dtype=np.int64), words.count[mine] - each))
                part = np.repeat([1, 2], len(mine))
                mine = np.concatenate((mine, mine))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[words.first[mine] + offset].view(np.int64)), ids.slice(i, j - i).take(pa.array(mine)), pa.array(offset, pa.int32()), pa.array(part, pa.int32()), pa.array(np.full(len(mine), each), pa.int32()), batch.column("row").slice(i, j - i).take(pa.array(mine))],
                    names=["hash", "id", "offset", "part", "size", "item_row"],
                )


def _short_runs(shared, sizes: set[int]):
    """Runs of each document that the bitmap lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(shared.value, dtype=np.uint8)
        for batch in batches:
            texts = [t or b"" for t in as_bytes(batch.column("text"))]
            ids = batch.column("doc_id")
            for i, j in steps(texts):
                words = _units(texts[i:j])
                for size, hashes in _runs(words, max(sizes)):
                    if size not in sizes:
                        continue
                    place = hashes >> np.uint64(64 - BITS)
                    inside = words.text[: len(hashes)] == words.text[size - 1 :]
                    at = np.flatnonzero(inside & (bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool))
                    text = words.text[at]
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[at].view(np.int64)), ids.slice(i, j - i).take(pa.array(text)), batch.column("row").slice(i, j - i).take(pa.array(text)), pa.array(at - words.first[text], pa.int32())], names=["hash", "id", "row", "pos"])

    return run


def _short_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame | None:
    """(doc_id, item_id) where a document has the whole text of an item without windows; None where there is no such item."""
    row = F.monotonically_increasing_id()  # runs of two texts of one id are kept apart
    items = durable(benchmark.withColumn("row", row).mapInArrow(_short_items, f"hash bigint, id {benchmark.schema['item_id'].dataType.simpleString()}, offset int, part int, size int, item_row bigint"))
    sizes = {r["size"] for r in items.select("size").distinct().collect()}
    if not sizes:
        return None
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(items))
    sent = docs.withColumn("row", row).mapInArrow(_short_runs(shared, sizes), f"hash bigint, id {docs.schema['doc_id'].dataType.simpleString()}, row bigint, pos int")
    here = items.select("hash", F.col("id").alias("item_id"), "offset", "part", "item_row")
    whole = sent.withColumnRenamed("id", "doc_id").join(here, "hash").groupBy("doc_id", "item_id", "item_row", "row", (F.col("pos") - F.col("offset")).alias("start")).agg(F.bit_or("part").alias("parts")).where("parts = 3")
    return whole.select("doc_id", "item_id").distinct()


def _candidates(sent: DataFrame, items: DataFrame, coverage: float) -> DataFrame:
    """(doc_id, item_id): documents with a window of an item's rarest. A document without any of n - ceil(coverage * n) + 1 of an item's n windows has too few of them."""
    often = sent.groupBy("hash").agg(F.count("*").alias("often"))
    places = items.select("id", "pos", "hash").distinct().join(often, "hash", "left").groupBy("id", "pos").agg(F.sum(F.coalesce("often", F.lit(0))).alias("often"), F.collect_set("hash").alias("hashes"))
    item = Window.partitionBy("id")
    ranked = places.withColumns({"rank": F.row_number().over(item.orderBy("often", "pos")), "n": F.count("*").over(item)})
    rare = ranked.where(F.col("rank") <= F.col("n") - F.ceil(coverage * F.col("n")) + 1).where("often > 0").select(F.col("id").alias("item_id"), F.explode("hashes").alias("hash")).distinct()
    return sent.select("hash", "doc_id").distinct().join(rare, "hash").select("doc_id", "item_id").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """A row for each document and item that it leaks: doc_id, item_id, windows, matched, coverage, slots, changed, kind.

    windows, matched: the item's windows, and those in the document. slots: distinct values of the item in slots that
    were compared; changed: those that the document has otherwise. kind: exact, or reparameterised where slots changed
    consistently. A document in which one value of the item stands for several is a leak only if it has a share of
    windows of `coverage` without the inconsistent ones. An item's text without regular windows counts as one window, which a
    document has if it holds the whole text: kind exact, without slots. Null texts and those without a letter or digit leak nothing; rows that repeat a doc_id or item_id count together; a null id is an id like any other. Ids can have any type; other columns are left out;
    an empty table on either side gives an empty one. A very long text is read whole, as one step of its task. Where as many windows agree at several shifts of a repeated text, the smallest shift counts.
    """
    small_batches(docs.sparkSession)
    text = F.col("text").cast("string").alias("text")
    items = durable(benchmark.select("item_id", text).mapInArrow(_emitted("item_id", None), _emits(benchmark, "item_id")))
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(items))
    sent = Scratch(docs.sparkSession, "windows").keep(docs.select("doc_id", text).mapInArrow(_emitted("doc_id", shared), _emits(docs, "doc_id")).withColumnRenamed("id", "doc_id"))
    here = items.select("hash", F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"))
    asked_for = _join(here, durable(_candidates(sent, items, coverage)), ["item_id"])
    hits = _join(sent, asked_for, ["doc_id", "hash"]).groupBy("doc_id", "item_id", "item_pos", (F.col("pos") - F.col("item_pos")).alias("shift"), "slots", "item_slots").agg(F.lit(1).alias("one"))
    hits = durable(hits)
    size = items.groupBy(F.col("id").alias("item_id")).agg(F.count_distinct("pos").alias("windows"))
    share = hits.groupBy("doc_id", "item_id").agg(F.count_distinct("item_pos").alias("matched"))
    near = _join(share, size, ["item_id"]).where(F.col("matched") >= coverage * F.col("windows")).select("doc_id", "item_id", "windows", "matched")
    # the shift at which most windows agree tells which of the document's slots belong to the item's
    shifts = hits.groupBy("doc_id", "item_id", "shift").agg(F.count_distinct("item_pos").alias("n"))
    best = shifts.groupBy("doc_id", "item_id").agg(F.max_by("shift", F.struct("n", -F.col("shift"))).alias("shift"))
    aligned = _join(hits, best, ["doc_id", "item_id", "shift"], "left_semi")
    pairs = aligned.select("doc_id", "item_id", "item_pos", F.explode(F.arrays_zip("item_slots", "slots")).alias("p")).where("p.item_slots != 0")
    pairs = pairs.select("doc_id", "item_id", "item_pos", F.col("p.item_slots").alias("asked"), F.col("p.slots").alias("found"))
    asked = ["doc_id", "item_id", "asked"]
    values = pairs.groupBy(*asked).agg((F.min("found") != F.max("found")).alias("mixed"), (F.max((F.col("found") != F.col("asked")).cast("int"))).alias("other"))
    slots = values.groupBy("doc_id", "item_id").agg(F.count("*").alias("slots"), F.sum("other").alias("changed"), F.count_if("mixed").alias("mixed"))
    broken = _join(pairs, values.where("mixed").select(*asked), asked, "left_semi").groupBy("doc_id", "item_id").agg(F.count_distinct("item_pos").alias("broken"))
    out = _join(_join(near, slots, ["doc_id", "item_id"], "left"), broken, ["doc_id", "item_id"], "left")
    out = out.where(F.col("matched") - F.coalesce("broken", F.lit(0)) >= coverage * F.col("windows"))
    out = out.select("doc_id", "item_id", "windows", "matched", (F.col("matched") / F.col("windows")).alias("coverage"), F.coalesce("slots", F.lit(0)).cast("long").alias("slots"), F.coalesce("changed", F.lit(0)).cast("long").alias("changed"), F.when(F.coalesce("changed", F.lit(0)) > 0, "reparameterised").otherwise("exact").alias("kind"))
    short = _short_leaks(docs.select("doc_id", text), benchmark.select("item_id", text))
    if short is None:
        return out
    one = F.lit(1).cast("long")
    short = short.select("doc_id", "item_id", one.alias("windows"), one.alias("matched"), F.lit(1.0).alias("coverage"), F.lit(0).cast("long").alias("slots"), F.lit(0).cast("long").alias("changed"), F.lit("exact").alias("kind"))
    # an item_id can have texts of both sorts
    rest = ["windows", "matched", "coverage", "slots", "changed", "kind"]
    return out.unionByName(short).groupBy("doc_id", "item_id").agg(F.max(F.struct(*rest)).alias("r")).select("doc_id", "item_id", *[f"r.{c}" for c in rest])


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item, with all their columns whatever their names; all rows of a doc_id that leaks go, a document without doc_id stays.

    Null texts leak nothing and stay; an empty benchmark or table changes nothing.
    """
    found = leaks(docs, benchmark).select("doc_id").where("doc_id IS NOT NULL").distinct()
    return docs.join(durable(found), "doc_id", "left_anti").select(docs.columns)
