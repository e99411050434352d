"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Pieces are found without a regular expression. Each code point has a class; each class is a transition function of
a small automaton that follows the pre-tokenisation rules (contractions, an optional space before letters, numbers or
other signs, white space up to the last before a word). Functions compose associatively, so the composed functions form
a finite table, and prefix compositions over a whole batch are found block by block, all blocks at once. The states
before and after a place tell whether a piece begins there. Slices of the UTF-8 bytes then go through a cache of merged
pieces. The byte offset of each token's end is kept beside its id; decoding puts all tokens of a text in their places by those
offsets at once.
"""

from __future__ import annotations

import base64
import heapq
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, small_batches, steps

#: Classes of code points; SEP stands between two texts.
SEP, LETTER, S_T_M_D, R, V, E, L, NUMBER, OTHER, APOSTROPHE, BLANK, SPACE = range(12)
#: States: what the token so far is. AFTER: a contraction just ended; QUOTE: an apostrophe that begins a token; QUOTE_R, _V, _L: it and a letter.
BEGIN, WORD, DIGITS, SIGNS, WHITE, ONE_BLANK, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, AFTER = range(11)
SEPARATOR = 0x110000
#: Pieces of a generation of merged ones (a worker keeps two), and the longest of them in bytes.
CACHE_PIECES, CACHE_BYTES = 300_000, 64
_BLOCK = 128


def _next(state: int, kind: int) -> int:
    if kind == SEP:
        return BEGIN
    if kind in (BLANK, SPACE):
        return ONE_BLANK if kind == BLANK else WHITE
    if kind == NUMBER:
        return DIGITS
    if kind in (OTHER, APOSTROPHE):
        return QUOTE if kind == APOSTROPHE and state not in (SIGNS, QUOTE, ONE_BLANK) else SIGNS
    if state == QUOTE:
        return {S_T_M_D: AFTER, R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}.get(kind, WORD)
    if kind == E and state in (QUOTE_R, QUOTE_V) or kind == L and state == QUOTE_L:
        return AFTER
    return WORD


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class of each code point; the function of each class; compositions of functions; their values."""
    classes = np.full(SEPARATOR + 1, OTHER, dtype=np.uint8)
    for c in range(SEPARATOR):
        major = unicodedata.category(chr(c))[0]
        if major == "L":
            classes[c] = LETTER
        elif major == "N":
            classes[c] = NUMBER
        elif major == "Z":
            classes[c] = SPACE
    classes[[*range(0x09, 0x0E), 0x85]] = SPACE
    classes[ord(" ")], classes[ord("'")], classes[SEPARATOR] = BLANK, APOSTROPHE, SEP
    for letters, kind in (("stmd", S_T_M_D), ("r", R), ("v", V), ("e", E), ("l", L)):
        classes[[ord(x) for x in letters]] = kind
    functions = [tuple(range(11))]
    index = {functions[0]: 0}
    single = []
    for kind in range(12):
        f = tuple(_next(s, kind) for s in range(11))
        if f not in index:
            index[f] = len(functions)
            functions.append(f)
        single.append(index[f])
    basis = [functions[i] for i in single]
    for f in functions:  # grows while it is read
        for g in basis:
            h = tuple(g[x] for x in f)
            if h not in index:
                index[h] = len(functions)
                functions.append(h)
    values = np.array(functions, dtype=np.uint8)
    compose = np.array([[index[tuple(g[x] for x in f)] for g in functions] for f in functions], dtype=np.uint16)
    return classes, np.array(single, dtype=np.uint16), compose, values


def _states(kinds: np.ndarray) -> np.ndarray:
    """The automaton's state after each place, by a blocked scan over composed functions."""
    _, single, compose, values = _tables()
    m = np.uint16(len(values))
    flat = compose.ravel()
    functions = single[kinds]

    def scan(f: np.ndarray) -> np.ndarray:
        """Inclusive prefix compositions."""
        if len(f) <= 1:
            return f
        blocks = -(-len(f) // _BLOCK)
        columns = np.zeros(blocks * _BLOCK, dtype=np.uint16)
        columns[: len(f)] = f
        columns = np.ascontiguousarray(columns.reshape(blocks, _BLOCK).T)
        for j in range(1, _BLOCK):
            columns[j] = flat.take(columns[j - 1] * m + columns[j])
        if blocks > 1:
            before = np.zeros(blocks, dtype=np.uint16)
            before[1:] = scan(columns[-1])[:-1]
            columns = flat.take((before * m)[None, :] + columns)
        return columns.T.ravel()[: len(f)]

    return values[scan(functions), BEGIN]


@lru_cache(1)
def _begins() -> np.ndarray:
    """By state before (times 12) and class: 1 if a piece begins there, 0 if not, 2 if what follows decides."""
    table = np.ones((11, 12), dtype=np.uint8)
    letters = [LETTER, S_T_M_D, R, V, E, L]
    for before in (WORD, ONE_BLANK, QUOTE_R, QUOTE_V, QUOTE_L):
        table[before, letters] = 0
    table[QUOTE, S_T_M_D] = 0
    table[QUOTE, [R, V, L]] = 2
    table[[DIGITS, ONE_BLANK], NUMBER] = 0
    table[[SIGNS, QUOTE, ONE_BLANK], OTHER] = table[[SIGNS, QUOTE, ONE_BLANK], APOSTROPHE] = 0
    table[np.ix_([WHITE, ONE_BLANK], [BLANK, SPACE])] = 2
    return table.ravel()


def _boundaries(kinds: np.ndarray) -> np.ndarray:
    """For each place: does a piece begin there?"""
    state = _states(kinds)
    key = kinds.copy()
    key[1:] += state[:-1] * np.uint8(12)
    begins = _begins()[key]
    open_ = np.flatnonzero(begins == 2)
    if len(open_):
        # white space after white space begins a piece if it is the last before something; an apostrophe and r, v or l belong together if the contraction is complete
        last = open_ + 1 == len(kinds)
        follows = np.minimum(open_ + 1, len(kinds) - 1)
        white = kinds[open_] >= BLANK
        solid = ~last & (kinds[follows] != SEP) & (kinds[follows] < BLANK)
        begins[open_] = np.where(white, solid, last | (state[follows] != AFTER))
    return begins.astype(bool)


def split(texts: list[bytes]) -> list[list[bytes]]:
    """The pieces of each text, whose bytes are valid UTF-8."""
    classes = _tables()[0]
    codes = np.frombuffer(SEPARATOR.to_bytes(4, "little").join([t.decode().encode("utf-32-le") for t in texts]), dtype="<u4")
    if not len(codes):
        return [[] for _ in texts]
    kinds = classes[codes]
    width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    width[kinds == SEP] = 1
    joined = b"\n".join(texts)
    place = np.concatenate(([0], np.cumsum(width)))
    at = place[:-1][_boundaries(kinds)]
    size = np.array([len(t) for t in texts])
    start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    low, high = np.searchsorted(at, start), np.searchsorted(at, start + size)
    edges = at.tolist()
    edges.append(len(joined))
    pieces = [joined[a:b] for a, b in zip(edges, edges[1:], strict=False)]
    return [pieces[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: a line has a token in base64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class Coder(dict):
    """From a piece to the little-endian unsigned 32-bit ids of its tokens; a missing piece is merged and, if short, kept for two generations."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks = ranks
        self.old: dict[bytes, bytes] = {}
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.sizes = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.joined = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            rank = self.ranks.get(piece)
            found = [rank] if rank is not None else self.merged(piece)
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= CACHE_BYTES:
            if len(self) >= CACHE_PIECES:  # what is in use comes back from the old generation
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def merged(self, piece: bytes) -> list[int]:
        """Pairs of neighbours are joined, the lowest rank first and of equal ranks the leftmost, until none has a rank."""
        ranks, n = self.ranks, len(piece)
        if n <= 48:
            return self.merged_short(piece)
        part = [piece[i : i + 1] for i in range(n)]
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i, 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, size = heapq.heappop(heap)
            j = right[i] if part[i] else n
            if j >= n or len(part[i]) + len(part[j]) != size:
                continue  # one of the two has changed since
            part[i], part[j] = part[i] + part[j], b""
            k = right[i] = right[j]
            if k < n:
                left[k] = i
            for a, b in ((left[i], i), (i, k)):
                if a >= 0 and b < n and (rank := ranks.get(part[a] + part[b])) is not None:
                    heapq.heappush(heap, (rank, a, len(part[a]) + len(part[b])))
        return [ranks[x] for x in part if x]

    def merged_short(self, piece: bytes) -> list[int]:
        """The same by a list of the neighbours' ranks; quicker for short pieces."""
        rank_of, none = self.ranks.get, 1 << 31
        part = [piece[i : i + 1] for i in range(len(piece))]
        rank = [rank_of(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while rank and (least := min(rank)) < none:
            i = rank.index(least)
            part[i] += part.pop(i + 1)
            del rank[i]
            if i < len(rank):
                rank[i] = rank_of(part[i] + part[i + 1], none)
            if i:
                rank[i - 1] = rank_of(part[i - 1] + part[i], none)
        return [self.ranks[x] for x in part]

    def encode(self, pieces: list[bytes]) -> bytes:
        return b"".join(map(self.__getitem__, pieces))

    def decode(self, ids: bytes, ends: bytes | None = None) -> bytes:
        """The bytes of the tokens; with ends each token stands where these say, and ends that are not those of the tokens are an error."""
        numbers = np.frombuffer(ids, dtype="<u4")
        sizes = self.sizes[numbers]
        after = np.cumsum(sizes)
        if ends is not None and not np.array_equal(after, np.frombuffer(ends, dtype="<u4")):
            raise ValueError("the offsets are not those of the tokens")
        if not len(numbers):
            return b""
        # the place of each byte in the joined tokens: where its token begins there, and how far the byte is inside it
        return self.joined[np.repeat(self.first[numbers] - (after - sizes), sizes) + np.arange(after[-1])].tobytes()

    def ends(self, ids: bytes) -> bytes:
        """Byte offset of each token's end in its text, as unsigned 32-bit integers."""
        return np.cumsum(self.sizes[np.frombuffer(ids, dtype="<u4")]).astype("<u4").tobytes()


_coders: dict[int, Coder] = {}


def _coder(shared) -> Coder:
    """This worker's coder for a broadcast rank file."""
    if shared.id not in _coders:
        _coders.clear()
        _coders[shared.id] = Coder(read_ranks(shared.value))
    return _coders[shared.id]


class _Ranks:
    """A rank file for the executors: it is read once, by the driver, and has the size of a vocabulary."""

    def __init__(self, docs: DataFrame, path: str) -> None:
        with open(path, "rb") as file:
            data = file.read()
        self.broadcast = docs.sparkSession.sparkContext.broadcast(data)
        self.id = hash(data)

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self) -> bytes:
        return self.broadcast.value


def encode(docs: DataFrame, path: str, offsets: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids of each document; with offsets also ends, the byte offset of each token's end.

    ids and ends are binary: little-endian unsigned 32-bit integers. path: a rank file on the driver. A null text
    counts as empty and has no tokens; null and repeated doc_ids are ordinary rows; other columns are left out.
    """
    small_batches(docs.sparkSession)
    ranks = _Ranks(docs, path)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks)
        for batch in batches:
            texts = [t or b"" for t in as_bytes(batch.column("text"))]
            for i, j in steps(texts):
                valid = [t if t.isascii() else t.decode(errors="replace").encode() for t in texts[i:j]]  # bytes that are no UTF-8 become replacement characters
                ids = [coder.encode(p) for p in split(valid)]
                arrays = [batch.column("doc_id").slice(i, j - i), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                names = ["doc_id", "n_tokens", "ids"]
                if offsets:
                    arrays.append(pa.array([coder.ends(x) for x in ids], pa.binary()))
                    names.append("ends")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(encoded, f"doc_id {kind}, n_tokens bigint, ids binary" + ", ends binary" * offsets)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """The columns of tokens and decoded, the bytes that the ids stand for, put in place by the offsets where there is a column ends. A null in ids gives no bytes."""
    small_batches(tokens.sparkSession)
    ranks = _Ranks(tokens, path)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks)
        for batch in batches:
            ends = batch.column("ends").to_pylist() if "ends" in batch.schema.names else [None] * batch.num_rows
            texts = [coder.decode(x or b"", e if x else None) for x, e in zip(batch.column("ids").to_pylist(), ends, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, "decoded"])

    return tokens.mapInArrow(decoded, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema) + ", decoded binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document: encoded with offsets, then decoded from ids and offsets.

    A null or empty text has no tokens; null and repeated doc_ids are ordinary rows; other columns are left out; an empty table gives an empty one.
    """
    there = decode(encode(docs, path, offsets=True), path)
    return there.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
