"""Language-model scoring with a class-factored log-bilinear model, trained in numpy by noise-contrastive estimation.

Counts of all words are taken in Spark. The model's vocabulary follows the corpus: every word has vectors of its own whose
count reaches a threshold that grows with the square root of the tokens, so that the vocabulary grows with the input; the
rest is one symbol, and a word of the rest gets its share of it by its count. Symbols are dealt by frequency into classes,
about as many as the square root of their number, of equal shares of the roots of their counts. The model predicts a token from the two before it: with the context
h = R1[b] + R2[a], P(w | a, b) = P(class | h) P(w | class, h), where a class has the score h . K[class] + its bias, and a word
h . Q[w] + bias[w]. Both factors are softmaxes over all classes and over all words of the class, so that every token's
log-probability is normalised exactly.

Training texts are dealt by a hash of what they are into buckets of about the same number of tokens, and the buckets into
rounds. In a round every bucket trains from the same parameters on all its texts, in the order of their hashes; what the
buckets changed is averaged, each word's vectors by its occurrences. So the model does not depend on how the input is split.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, as_bytes, durable, small_batches, steps

#: A word has vectors of its own if its count times this reaches the square root of all tokens; width of the vectors.
DETAIL, WIDTH = 64, 16
#: Words whose counts are sent to all tasks at least (12 bytes each), besides those of the model; rarer ones are joined in Spark.
COMMON = 1 << 18
#: Tokens of a training step, noise words of a step, and noise words that count for each token.
BATCH, NOISE, PER_TOKEN = 4096, 64, 24
RATE = 0.08
#: Rounds of averaging; tokens of a bucket at least, in all and for each word of the model (so that what buckets send stays a share of the text); buckets of a
#: round at most (beyond, buckets get larger: a task streams its bucket); changes that are summed at once.
ROUNDS, BUCKET_TOKENS, TOKENS_PER_WORD, MOST_BUCKETS, AT_ONCE = 3, 4_000_000, 80, 4096, 64
#: The hash that stands for a text's end.
END = np.uint64(0)
_CHUNK = 1024
#: Tokens that are scored together, and rows of a matrix of scores, so that it stays in a core's cache.
_SCORED, _BLOCK = 1 << 18, 1024


def held_out():
    """Is a row kept for judging? Its crc32 of doc_id as text leaves 2 when divided by 7; a row without doc_id is learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of several texts, each text's followed by END, and the index of each text's end."""
    words = Words(texts, lower=True)
    ends = words.first[1:] + np.arange(len(texts))
    out = np.full(len(words.start) + len(texts), END, dtype=np.uint64)
    inside = np.ones(len(out), dtype=bool)
    inside[ends] = False
    out[inside] = words.hashes()
    return out, ends


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and their counts in this task; handed on when there are many."""
    words, counts, size = [], [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        all_words = np.concatenate(words) if words else np.zeros(0, dtype=np.uint64)
        found, at = np.unique(all_words, return_inverse=True)
        return found, np.bincount(at, np.concatenate(counts) if counts else None, len(found)).astype(np.int64)

    def out() -> pa.RecordBatch:
        found, n = merged()
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["word", "n"])

    for batch in batches:
        texts = [t or b"" for t in as_bytes(batch.column("text"))]
        for i, j in steps(texts):
            found, n = np.unique(_tokens(texts[i:j])[0], return_counts=True)
            words.append(found), counts.append(n)
            size += len(found)
            if size > 4_000_000:
                found, n = merged()
                if len(found) > 2_000_000:
                    yield out()
                    words, counts, size = [], [], 0
                else:
                    words, counts, size = [found], [n], len(found)
    yield out()


def modelled(tokens: int) -> int:
    """The least count of a word that has vectors of its own, among so many tokens."""
    return max(1, math.ceil(math.sqrt(tokens) / DETAIL))


class Vocabulary:
    """Common words (hashes in order) with counts and symbols, and the totals over all words.

    Symbol 0 stands for the rest, symbols from 1 on for the words of the model, the most frequent first.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, tokens: int, distinct: int) -> None:
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        self.tokens, self.distinct = tokens, distinct
        ranked = np.lexsort((self.words, -self.counts))
        ranked = ranked[self.counts[ranked] >= modelled(tokens)]
        self.symbols = np.zeros(len(words), dtype=np.int32)
        self.symbols[ranked] = np.arange(1, len(ranked) + 1)
        head = self.counts[ranked].sum()
        self.other_tokens, self.other_distinct = tokens - int(head), distinct - len(ranked)
        self.mass = np.concatenate(([max(self.other_tokens, 1)], self.counts[ranked])).astype(np.float64)
        self.prior = self.mass / self.mass.sum()
        end = np.searchsorted(self.words, END)
        self.end = int(self.symbols[end]) if end < len(self.words) and self.words[end] == END else 0

    def find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each token among the common words, and whether it is one."""
        if not len(self.words):
            return np.zeros(len(tokens), dtype=np.int64), np.zeros(len(tokens), dtype=bool)
        at = np.minimum(np.searchsorted(self.words, tokens), len(self.words) - 1)
        return at, self.words[at] == tokens


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): the hash of each token in the texts, the end of a text included, and how often it occurs."""
    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_counted, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """All words of the model, and those with the highest counts, COMMON at most, chosen by a limit that follows from a table of counts; ties are in or out together."""
    grade = F.floor(F.log2("n") * 16)
    table = counts.groupBy(grade.alias("grade")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens"), F.min("n").alias("least")).collect()
    taken, least = 0, None
    for row in sorted(table, key=lambda r: -r["grade"]):
        if taken + row["words"] > COMMON:
            break
        taken, least = taken + row["words"], row["least"]
    tokens = sum(r["tokens"] for r in table)
    least = modelled(tokens) if least is None else min(least, modelled(tokens))
    frequent = counts.where(F.col("n") >= least).toArrow()
    return Vocabulary(frequent["word"].to_numpy().view(np.uint64), frequent["n"].to_numpy(), tokens, sum(r["words"] for r in table))


class Parameters:
    """R1, R2 (vectors of the word before and the one before that), Q and bias of the symbols, K and its bias of their classes.

    `group` is each symbol's class; a class's symbols follow one another from first[class] on. The rest is a class of its own.
    """

    def __init__(self, vocab: Vocabulary, seed: int = 7) -> None:
        size = len(vocab.prior)
        # each class has an equal share of the sum of the roots of its symbols' counts: those of frequent symbols are small, so that a token is held against few of its class
        root = np.cumsum(np.sqrt(vocab.mass[1:]))
        share = np.floor(root / root[-1] * max(1, math.isqrt(size)) * (1 - 1e-9)) if size > 1 else root
        self.group = np.concatenate(([0], 1 + np.cumsum(np.diff(share, prepend=share[:1]) > 0))).astype(np.int32)
        self.first = np.concatenate((np.flatnonzero(np.diff(self.group, prepend=-1)), [size]))
        self.class_prior = np.add.reduceat(vocab.prior, self.first[:-1])
        random = np.random.default_rng(seed)
        self.r1, self.r2, self.q = (random.normal(0, 0.1, (size, WIDTH)).astype(np.float32) for _ in range(3))
        self.k = random.normal(0, 0.1, (len(self.class_prior), WIDTH)).astype(np.float32)
        self.bias, self.class_bias = np.log(vocab.prior).astype(np.float32), np.log(self.class_prior).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.r1, self.r2, self.q, self.bias, self.k, self.class_bias)])

    def load(self, flat: np.ndarray) -> None:
        parts = [self.r1, self.r2, self.q, self.bias, self.k, self.class_bias]
        ends = np.cumsum([x.size for x in parts])
        self.r1, self.r2, self.q, self.bias, self.k, self.class_bias = (flat[end - x.size : end].reshape(x.shape).astype(np.float32, copy=True) for x, end in zip(parts, ends, strict=True))


def _contexts(vocab: Vocabulary, texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Symbols of tokens and of the two before each; a text's first tokens have its predecessor's end before them, which is an end like its own."""
    tokens, ends = _tokens(texts)
    at, known = vocab.find(tokens)
    symbols = np.where(known, vocab.symbols[at] if len(vocab.symbols) else 0, 0)
    before = np.concatenate(([vocab.end], symbols[:-1]))
    second = np.concatenate(([vocab.end], before[:-1]))
    second[ends[:-1] + 1] = vocab.end  # a text's first token; its second one has the end before it anyway
    return symbols, before, second, tokens, ends, at, known


class _Trainer:
    """Steps of noise-contrastive estimation with rates by AdaGrad."""

    def __init__(self, vocab: Vocabulary, start: np.ndarray, rate: float, seed: int) -> None:
        self.p, self.rate = Parameters(vocab), rate
        self.p.load(start)
        self.random = np.random.default_rng(seed)
        self.cumulative = [np.cumsum(x) for x in (vocab.prior, self.p.class_prior)]
        self.log_noise = [np.log(PER_TOKEN * x).astype(np.float32) for x in (vocab.prior, self.p.class_prior)]
        self.last = np.zeros(len(vocab.prior), dtype=np.int32)
        self.squares = [np.full(len(x), 1e-2, dtype=np.float32) for x in (*[vocab.prior] * 4, *[self.p.class_prior] * 2)]

    def _different(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The different ones of rows, and which of them each row is; without sorting, as the last row of its kind is found in a table."""
        number = np.arange(len(rows), dtype=np.int32)
        self.last[rows] = number
        owner = self.last[rows]
        own = owner == number
        return rows[own], (np.cumsum(own) - 1)[owner]

    def _add(self, k: int, matrix: np.ndarray, at: np.ndarray, which: np.ndarray, gradient: np.ndarray) -> None:
        """A step of the rows `at` of matrix by the sums of their gradients; `which` of them each gradient belongs to."""
        if gradient.ndim == 2:
            cell = which[:, None] * WIDTH + np.arange(WIDTH)
            total = np.bincount(cell.ravel(), gradient.ravel(), len(at) * WIDTH).astype(np.float32).reshape(-1, WIDTH)
            self.squares[k][at] += np.einsum("ij,ij->i", total, total) / np.float32(WIDTH)
        else:
            total = np.bincount(which, gradient, len(at)).astype(np.float32)
            self.squares[k][at] += total**2
        rate = self.rate / np.sqrt(self.squares[k].take(at))
        matrix[at] += rate[:, None] * total if total.ndim == 2 else rate * total

    def _against_noise(self, k: int, vectors: np.ndarray, bias: np.ndarray, w: np.ndarray, context: np.ndarray) -> np.ndarray:
        """A step of the symbols (k 0) or the classes (k 1) w after the contexts; returns the contexts' gradient."""
        cumulative, log_noise, at = self.cumulative[k], self.log_noise[k], (2, 4)[k]
        noise = np.minimum(np.searchsorted(cumulative, self.random.random(NOISE) * cumulative[-1]), len(cumulative) - 1).astype(w.dtype)
        mine = vectors.take(w, axis=0)
        right = 1 / (1 + np.exp(np.einsum("ij,ij->i", context, mine) + bias.take(w) - log_noise.take(w)))
        others = vectors[noise]
        wrong = context @ -others.T
        wrong -= bias[noise] - log_noise[noise]
        np.exp(wrong, out=wrong)
        wrong += 1
        np.divide(np.float32(-PER_TOKEN / NOISE), wrong, out=wrong)
        mine *= right[:, None]
        mine += wrong @ others  # the contexts' gradient
        gradient = np.empty((len(w) + NOISE, WIDTH), dtype=np.float32)
        np.multiply(right[:, None], context, out=gradient[: len(w)])
        np.matmul(wrong.T, context, out=gradient[len(w) :])
        found, which = self._different(np.concatenate((w, noise)))
        self._add(at, vectors, found, which, gradient)
        self._add(at + 1, bias, found, which, np.concatenate((right, wrong.sum(axis=0))))
        return mine

    def step(self, w: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        p = self.p
        context = p.r1.take(a, axis=0)
        context += p.r2.take(b, axis=0)
        down = self._against_noise(0, p.q, p.bias, w, context)
        down += self._against_noise(1, p.k, p.class_bias, p.group.take(w), context)
        self._add(0, p.r1, *self._different(a), down)
        self._add(1, p.r2, *self._different(b), down)

    def train(self, w: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """All tokens once; a step takes tokens from all over the texts."""
        w, a, b = (x.astype(np.int32) for x in (w, a, b))
        parts = max(1, len(w) // BATCH)
        for i in range(parts):
            self.step(w[i::parts], a[i::parts], b[i::parts])


def _changed(trainer: _Trainer, start: np.ndarray, seen: np.ndarray, bucket: int) -> Iterator[pa.RecordBatch]:
    """What a bucket's training changed, weighted: a symbol's vectors by its occurrences, all else by the tokens; then those weights themselves. In parts of _CHUNK numbers."""
    each = np.repeat(seen, WIDTH)
    rest = np.full(len(start) - 3 * len(each), seen.sum())
    flat = np.concatenate(((trainer.p.flat() - start) * np.concatenate((each, each, each, rest)), seen)).astype(np.float32)
    for i in range(0, len(flat), 256 * _CHUNK):
        parts = [flat[j : j + _CHUNK] for j in range(i, min(len(flat), i + 256 * _CHUNK), _CHUNK)]
        numbers = pa.array(range(i // _CHUNK, i // _CHUNK + len(parts)), pa.int32())
        yield pa.RecordBatch.from_arrays([numbers, pa.array(np.full(len(parts), bucket), pa.int64()), pa.array(parts, pa.list_(pa.float32()))], names=["part", "bucket", "total"])


def _trained(vocab, start, rate: float):
    """Trains on each bucket of a task, one after another; rows come sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, bucket, seen = None, None, None
        for batch in batches:
            buckets = batch.column("bucket").to_numpy()
            edges = np.concatenate((np.flatnonzero(np.diff(buckets, prepend=-1)), [len(buckets)]))
            texts = [t or b"" for t in as_bytes(batch.column("text"))]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                if bucket != buckets[low]:
                    if trainer is not None:
                        yield from _changed(trainer, start.value, seen, bucket)
                    bucket = int(buckets[low])
                    trainer, seen = _Trainer(vocab.value, start.value, rate, bucket), np.zeros(len(vocab.value.prior), dtype=np.int64)
                for i, j in steps(texts[low:high]):
                    w, a, b = _contexts(vocab.value, texts[low + i : low + j])[:3]
                    trainer.train(w, a, b)
                    seen += np.bincount(w, minlength=len(seen))
        if trainer is not None:
            yield from _changed(trainer, start.value, seen, bucket)

    return run


def _summed(column: str):
    """The sum of arrays in the order of their buckets, so that it is the same each time."""
    zero = F.transform(F.col("all")[0]["total"], lambda x: F.lit(0.0))
    return F.aggregate(F.transform(F.array_sort("all"), lambda x: x["total"]), zero, lambda s, x: F.zip_with(s, x, lambda u, v: u + v)).alias(column)


def train(docs: DataFrame, vocab: Vocabulary) -> Parameters:
    """Parameters after ROUNDS rounds; each text is trained on in one of them, and none is left out.

    A row without doc_id is dealt by its place, so that many equal ones do not fill one bucket.
    """
    context = docs.sparkSession.sparkContext
    shared, parameters = context.broadcast(vocab), Parameters(vocab)
    per_round = min(MOST_BUCKETS, max(1, -(-vocab.tokens // (ROUNDS * max(BUCKET_TOKENS, TOKENS_PER_WORD * len(vocab.prior))))))
    place = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    text = F.col("text").cast("string")
    dealt = docs.select(text.alias("text"), F.xxhash64("doc_id", text, place).alias("order"))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64(F.lit(5), "order"), F.lit(ROUNDS * per_round)))
    for turn in range(ROUNDS):
        start = context.broadcast(parameters.flat())
        mine = dealt.where(F.col("bucket") % ROUNDS == turn).repartition(per_round, "bucket").sortWithinPartitions("bucket", "order")
        sums = mine.select("bucket", "text").mapInArrow(_trained(shared, start, RATE / (1 + turn)), "part int, bucket bigint, total array<float>")
        if per_round > AT_ONCE:
            at = F.floor(F.col("bucket") / (ROUNDS * AT_ONCE)).alias("at")
            sums = sums.groupBy("part", at).agg(F.collect_list(F.struct("bucket", "total")).alias("all")).select("part", F.col("at").alias("bucket"), _summed("total"))
        added = sums.groupBy("part").agg(F.collect_list(F.struct("bucket", "total")).alias("all")).select("part", _summed("total"))
        table = added.toArrow().sort_by("part")
        if table.num_rows:
            flat = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in table["total"].chunks])
            change, seen = flat[: -len(vocab.prior)], flat[-len(vocab.prior) :]
            each = np.repeat(seen, WIDTH)
            weight = np.concatenate((each, each, each, np.full(len(change) - 3 * len(each), seen.sum())))
            parameters.load(start.value + change / np.maximum(weight, 1))
        start.unpersist()
    return parameters


def _log_probability(context: np.ndarray, vectors: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """log of the share that the vector `chosen` has in the softmax of each context's products with all vectors."""
    scores = context @ vectors.T
    mine = scores[np.arange(len(chosen)), chosen].astype(np.float64)
    np.exp(scores, out=scores)
    total = scores.sum(axis=1).astype(np.float64)
    far = np.flatnonzero(~np.isfinite(total) | (total < 1e-30))  # out of the range of single precision
    out = mine - np.log(np.where(total > 0, total, 1.0))
    if len(far):
        scores = context[far].astype(np.float64) @ vectors.T.astype(np.float64)
        top = scores.max(axis=1)
        out[far] = scores[np.arange(len(far)), chosen[far]] - top - np.log(np.exp(scores - top[:, None]).sum(axis=1))
    return out


class Scorer:
    """Normalised log-probabilities (base 10) of a symbol after two symbols. A bias is one more coordinate, against a one in the context."""

    def __init__(self, p: Parameters) -> None:
        self.p = p
        self.k, self.q = (np.concatenate((vectors, bias[:, None]), axis=1) for vectors, bias in ((p.k, p.class_bias), (p.q, p.bias)))

    def _factors(self, symbols: np.ndarray, vectors: np.ndarray, bias: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """exp of the product of each class with the vector of each different symbol (its bias included, if given), and the row of each symbol."""
        seen = np.zeros(len(vectors), dtype=bool)
        seen[symbols] = True
        found = np.flatnonzero(seen)
        row = np.zeros(len(vectors), dtype=np.int32)
        row[found] = np.arange(len(found))
        out = np.empty((len(found), len(self.p.k)), dtype=np.float32)
        for i in range(0, len(found), _BLOCK):
            part = out[i : i + _BLOCK]
            np.matmul(vectors[found[i : i + _BLOCK]], self.p.k.T, out=part)
            if bias is not None:
                part += bias
            np.exp(part, out=part)
        return out, row[symbols]

    def _class(self, a: np.ndarray, b: np.ndarray, context: np.ndarray, group: np.ndarray) -> np.ndarray:
        """log of the share of each token's class.

        A context is a sum of two vectors, so that exp of its product with a class is a product of two numbers, which are made once for each different symbol.
        """
        (first, at_first), (second, at_second) = self._factors(a, self.p.r1, None), self._factors(b, self.p.r2, self.p.class_bias)
        total = np.empty(len(a), dtype=np.float32)
        some, others = np.empty((2, min(_BLOCK, len(a)), len(self.k)), dtype=np.float32)
        with np.errstate(over="ignore", invalid="ignore"):
            for i in range(0, len(a), _BLOCK):
                n = min(_BLOCK, len(a) - i)
                first.take(at_first[i : i + n], axis=0, out=some[:n], mode="clip")
                second.take(at_second[i : i + n], axis=0, out=others[:n], mode="clip")
                np.einsum("ij,ij->i", some[:n], others[:n], out=total[i : i + n])
        right = np.isfinite(total) & (total > 1e-30)
        out = np.einsum("ij,ij->i", context, self.k.take(group, axis=0)) - np.log(np.where(right, total, 1.0).astype(np.float64))
        far = np.flatnonzero(~right)  # out of the range of single precision
        for i in range(0, len(far), _BLOCK):
            at = far[i : i + _BLOCK]
            out[at] = _log_probability(context[at], self.k, group[at])
        return out

    def log10(self, w: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        p = self.p
        out = np.zeros(len(w))
        order = np.argsort(p.group[w].astype(np.uint16) if len(p.k) <= 1 << 16 else p.group[w], kind="stable")  # tokens of a class together
        for i in range(0, len(w), _SCORED):
            at = order[i : i + _SCORED]
            symbols, group = w[at], p.group[w[at]]
            context = np.ones((len(at), WIDTH + 1), dtype=np.float32)
            np.add(p.r1.take(a[at], axis=0), p.r2.take(b[at], axis=0), out=context[:, :WIDTH])
            found = self._class(a[at], b[at], context, group)
            edges = np.concatenate((np.flatnonzero(np.diff(group, prepend=-1)), [len(at)]))
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                first, last = p.first[group[begin]], p.first[group[begin] + 1]
                if last - first > 1:
                    for j in range(begin, end, _BLOCK):
                        mine = slice(j, min(j + _BLOCK, end))
                        found[mine] += _log_probability(context[mine], self.q[first:last], symbols[mine] - first)
            out[at] = found
        return out / math.log(10)


_scorers: dict[int, Scorer] = {}


class Model:
    """Counts of all words (a DataFrame), the common ones among them, and the parameters."""

    def __init__(self, counts: DataFrame, vocab: Vocabulary, parameters: Parameters) -> None:
        self.counts, self.vocab, self.parameters = counts, vocab, parameters


def fit(docs: DataFrame) -> Model:
    """The model of all rows of docs (doc_id, text). Without any row all words are unknown."""
    small_batches(docs.sparkSession)
    counts = durable(count_words(docs).where("n > 0"))
    vocab = vocabulary(counts)
    return Model(counts, vocab, train(docs, vocab))


def score(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document; the model is by default that of the rows not held out.

    A text's score follows from the text and the model alone. A null text counts as empty: its end is its one token. Null and repeated doc_ids are
    ordinary rows; other columns are left out; an empty table gives an empty one. Without any training text every token is unknown, and both scores are
    those of empty counts. A very long text takes some ten numbers of 8 bytes for each of its bytes in a task.
    """
    small_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    model = model or fit(docs.where(~held_out()))
    counts, vocab, parameters = model.counts, model.vocab, model.parameters
    shared, flat = context.broadcast(vocab), context.broadcast(parameters)
    identity = hash(parameters.flat().tobytes())

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        if identity not in _scorers:
            _scorers.clear()
            _scorers[identity] = Scorer(flat.value)
        scorer = _scorers[identity]
        gain = np.log10(v.counts + 1.0) if len(v.counts) else np.zeros(1)
        for batch in batches:
            texts = [t or b"" for t in as_bytes(batch.column("text"))]
            for i, j in steps(texts):
                w, a, b, tokens, ends, at, known = _contexts(v, texts[i:j])
                begin = np.concatenate(([0], ends[:-1] + 1))
                total = lambda x: np.add.reduceat(x, begin)  # noqa: E731, B023
                common = np.where(known, gain[at], 0.0)
                other = w == 0
                rare = np.flatnonzero(~known)
                text_of = np.searchsorted(ends, rare)
                rares = pa.ListArray.from_arrays(pa.array(np.searchsorted(text_of, np.arange(j - i + 1)), pa.int32()), pa.array(tokens[rare].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(ends + 1 - begin), pa.array(total(known.astype(np.int64))), pa.array(total(common)), pa.array(total(scorer.log10(w, a, b) + np.where(other, common, 0.0))), pa.array(total(other.astype(np.int64))), rares],
                    names=["doc_id", "n_tokens", "known", "gain", "model", "others", "rare"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(scored, f"doc_id {kind}, n_tokens bigint, known bigint, gain double, model double, others bigint, rare array<bigint>")
    rows = durable(rows.withColumn("row", F.monotonically_increasing_id()))
    # rare words: their counts come by a join; one that was never seen adds nothing, as the logarithm of 0 + 1
    rare = rows.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times")).join(counts, "word")
    found = rare.groupBy("row").agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_gain"))
    out = rows.join(found, "row", "left").withColumns({"rare_known": F.coalesce("rare_known", F.lit(0)), "rare_gain": F.coalesce("rare_gain", F.lit(0.0))})
    base_total = math.log10(vocab.tokens + vocab.distinct + 1)
    other_total = math.log10(vocab.other_tokens + vocab.other_distinct + 1)
    return out.select(
        "doc_id",
        held_out().alias("held_out"),
        "n_tokens",
        (F.col("known") + F.col("rare_known")).alias("n_known"),
        F.lit(vocab.tokens).cast("bigint").alias("train_tokens"),
        (F.col("gain") + F.col("rare_gain") - F.col("n_tokens") * base_total).alias("base_score"),
        (F.col("model") + F.col("rare_gain") - F.col("others") * other_total).alias("score"),
    )
