"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses; each word has a class (insult, threat, target, negation, reported speech, other). Five small
weighted transducers read the classes: what an insult or a threat weighs, and how a target, a negation or
reported speech near it change that. Their composition scores a clause in one walk; a document's score follows from its
clauses by a logistic model (learnt words are insults; threats are the words known beforehand, with learnt weights). Which words are insults or threats, and what each weighs, is learnt from labelled
documents together with a few words known beforehand.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, logistic, small_batches

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
# Words known beforehand, by class, in the languages of the corpus.
KNOWN = {
    INSULT: "idiot moron stupid imbecile scum loser pathetic worthless disgusting trash clown dumb fool bastard dummkopf abschaum crétin débile ordure imbécil estúpido basura",
    THREAT: "kill hurt destroy beat punch stab shoot burn attack töten schlagen tuer frapper matar golpear",
    TARGET: "you your yours he she they them him her this that these those du dich euch sie tu vous toi il elle ils usted él ella ellos",
    NEGATION: "not no never none hardly isn't aren't don't doesn't nicht kein keine nie pas jamais aucun no nunca ningún",
    REPORT: "said says say told tells claimed called calls wrote quoted reported sagte nannte dit appelle dijo llamó",
}
#: Labelled rows that the words and the model are learnt from, at most.
MOST_LABELLED = 20_000
#: A word is toxic if it is in this share of toxic rows at least, in 5 at least, with these log-odds and deviations over other rows.
LEAST_SHARE, LEAST_ROWS, LEAST_ODDS, LEAST_DEVIATIONS = 0.01, 5, 1.8, 6.0
#: What a known insult or threat weighs until labels tell.
KNOWN_WEIGHT = 2.0

_STOPS = ".!?;:"
_EDGES = "*#$%&|,\"'()[]{}<>-_~/\\=+`“”„«»’"


class Transducer:
    """Weighted automaton over word classes: step[state][class] is the next state, weight[state][class] a factor, final[state] a factor at the clause's end."""

    def __init__(self, step: list[list[int]], weight: list[list[float]], final: list[float]) -> None:
        self.step, self.weight, self.final = step, weight, final

    def __matmul__(self, other: Transducer) -> Transducer:
        """Both read the same word; factors multiply."""
        states = list(product(range(len(self.step)), range(len(other.step))))
        at = {s: i for i, s in enumerate(states)}
        classes = range(6)
        return Transducer(
            [[at[self.step[a][c], other.step[b][c]] for c in classes] for a, b in states],
            [[self.weight[a][c] * other.weight[b][c] for c in classes] for a, b in states],
            [self.final[a] * other.final[b] for a, b in states],
        )


def _grammar() -> Transducer:
    ones = [1.0] * 6
    insult = Transducer([[0] * 6], [[0, 1.0, 1.0, 0, 0, 0]], [1.0])
    # a threat without a target in the clause weighs little
    threat = Transducer([[0, 0, 1, 2, 0, 0], [1, 1, 1, 2, 1, 1], [2] * 6], [ones, ones, ones], [1.0, 0.4, 1.0])
    # an insult beside a target weighs more
    target = Transducer([[0, 0, 0, 1, 0, 0], [1] * 6], [ones, [1, 1.25, 1.25, 1, 1, 1]], [1.0, 1.1])
    # a negation holds for three words
    negation = Transducer([[0, 0, 0, 0, 1, 0], [2, 2, 2, 2, 1, 2], [3, 3, 3, 3, 1, 3], [0, 0, 0, 0, 1, 0]], [ones] + [[1, 0.5, 0.5, 1, 1, 1]] * 3, [1.0] * 4)
    # after a verb of saying, another's words weigh less
    report = Transducer([[0, 0, 0, 0, 0, 1], [1] * 6], [ones, [1, 0.7, 0.7, 1, 1, 1]], [1.0, 1.0])
    return insult @ threat @ target @ negation @ report


GRAMMAR = _grammar()


def clauses(text: str) -> list[str]:
    """A text cut at line ends and at stops, wherever these stand."""
    for c in _STOPS:
        text = text.replace(c, "\n")
    return text.split("\n")


def words_of(text: str) -> list[str]:
    """Words of a clause, or of all clauses of a text: the one tokeniser of learning and scoring."""
    for c in _STOPS:
        text = text.replace(c, " ")
    return [w for w in (x.strip(_EDGES) for x in text.split()) if w]


def features(text: str, lexicon: dict[str, tuple[int, float]]) -> list[float]:
    """Clause scores of a text: the largest, the sum, the number of scored clauses, by words, and the words' logarithm."""
    toxic = [w for w, (kind, _) in lexicon.items() if kind in (INSULT, THREAT)]
    return _features(text.lower(), lexicon, frozenset(toxic))


def _features(text: str, lexicon: dict[str, tuple[int, float]], toxic: frozenset[str]) -> list[float]:
    best = total = hits = 0.0
    n = len(text.split())
    if not toxic.isdisjoint(words_of(text)):  # else no clause has a score
        for clause in clauses(text):
            tokens = words_of(clause)
            if toxic.isdisjoint(tokens):
                continue
            state, score = 0, 0.0
            for w in tokens:
                kind, weight = lexicon.get(w, (OTHER, 0.0))
                score += weight * GRAMMAR.weight[state][kind]
                state = GRAMMAR.step[state][kind]
            score *= GRAMMAR.final[state]
            best, total, hits = max(best, score), total + score, hits + 1
    return [best, math.log1p(total), hits, 100 * total / (n + 20), math.log1p(n)]


class Model:
    """Words with class and weight, and a logistic model over the features."""

    def __init__(self, lexicon: dict[str, tuple[int, float]], mean: np.ndarray, scale: np.ndarray, weights: np.ndarray) -> None:
        self.lexicon, self.mean, self.scale, self.weights = lexicon, mean, scale, weights

    def scores(self, rows: list[list[float]]) -> np.ndarray:
        x = (np.array(rows, dtype=np.float64).reshape(-1, len(self.mean)) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -30, 30)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with the toxic and other rows of this task that have them."""
    found: tuple[Counter, Counter] = Counter(), Counter()

    def out() -> pa.RecordBatch:
        names = list(found[1].keys() | found[0].keys())
        batch = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([found[1][w] for w in names], pa.int64()), pa.array([found[0][w] for w in names], pa.int64())], names=["word", "toxic_rows", "other_rows"])
        found[0].clear(), found[1].clear()
        return batch

    for batch in batches:
        for text, toxic in zip(as_bytes(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
            found[int(toxic == 1)].update(set(words_of((text or b"").decode(errors="replace").lower())))
        if len(found[0]) + len(found[1]) > 500_000:
            yield out()
    yield out()


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """Words and model from at most `most` labelled rows (chosen by a hash of doc_id) that are not held out."""
    small_batches(docs.sparkSession)
    usable = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out())
    ids = usable.select("doc_id", "toxic").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic")
    known = {w: (kind, KNOWN_WEIGHT if kind in (INSULT, THREAT) else 0.0) for kind, words in KNOWN.items() for w in words.split()}
    totals = ids.agg(F.coalesce(F.count_if(F.col("toxic") == 1), F.lit(0)), F.count("*")).first()
    toxic, other = totals[0], totals[1] - totals[0]
    counts = rows.select("text", "toxic").mapInArrow(_counted, "word string, toxic_rows bigint, other_rows bigint").groupBy("word").agg(F.sum("toxic_rows").alias("t"), F.sum("other_rows").alias("o"))
    rate_t, rate_o, rate = (F.col("t") + 0.5) / (toxic + 1), (F.col("o") + 0.5) / (other + 1), (F.col("t") + F.col("o")) / (toxic + other + 1)
    deviations = (rate_t - rate_o) / F.sqrt(rate * (1 - rate) * (1 / (toxic + 1) + 1 / (other + 1)) + 1e-12)
    learnt = counts.where((F.col("t") >= max(LEAST_ROWS, LEAST_SHARE * toxic)) & (F.log(rate_t / rate_o) >= LEAST_ODDS) & (deviations >= LEAST_DEVIATIONS))
    for row in learnt.select("word", F.log(rate_t / rate_o).alias("odds")).orderBy(F.desc("odds"), "word").collect():  # LEAST_SHARE bounds them: a row has so many words
        kind = known.get(row["word"], (INSULT, 0))[0]
        known[row["word"]] = (THREAT if kind == THREAT else INSULT, min(float(row["odds"]), 6.0))
    if not toxic or not other:
        return Model(known, np.zeros(5), np.ones(5), np.array([-3.0, 1.0, 0, 0, 0, 0]))
    featured = rows.select("doc_id", "text", "toxic").mapInArrow(_featured(known, "toxic"), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, f array<double>, y double")
    # one row for each label: of a doc_id that occurs again, the text with the highest score
    sample = featured.groupBy("doc_id").agg(F.max("f").alias("f"), F.max("y").alias("y")).orderBy("doc_id").toPandas()
    mean, scale, weights = logistic(np.array(sample["f"].tolist()), sample["y"].to_numpy())
    return Model(known, mean, scale, weights)


def _featured(lexicon: dict[str, tuple[int, float]], label: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic = frozenset(w for w, (kind, _) in lexicon.items() if kind in (INSULT, THREAT))
        for batch in batches:
            rows = [_features((t or b"").decode(errors="replace").lower(), lexicon, toxic) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64())), batch.column(label).cast(pa.float64())], names=["doc_id", "f", "y"])

    return run


def held_out():
    """Is a row kept for judging? Its crc32 of doc_id as text is divisible by 5; a row without doc_id is never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of each document.

    A very long text is cut into clauses like any other and takes a few times its own memory; an empty table gives an empty one. A null text counts as empty; empty texts get the score of a text without scored clauses. Null and repeated doc_ids are ordinary
    rows; other columns are left out.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic = frozenset(w for w, (kind, _) in model.lexicon.items() if kind in (INSULT, THREAT))
        for batch in batches:
            rows = [_features((t or b"").decode(errors="replace").lower(), model.lexicon, toxic) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(rows), pa.float64())], names=["doc_id", "score"])

    out = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(scored, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
