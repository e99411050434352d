import math
import re
import zlib

from shelfmark.llm import toxicity as T


def test_grammar_judges_clauses():
    lexicon = {w: (k, 2.0 if k in (T.INSULT, T.THREAT) else 0.0) for k, words in T.KNOWN.items() for w in words.split()}
    best = lambda text: T.features(text, lexicon)[0]
    assert best("you are an idiot") > best("the idiot") > best("not an idiot") > 0
    assert best("he said idiot") < best("idiot")
    assert best("kill time") < best("kill you")
    assert best("a kind word") == best("") == 0
    assert T.features("fine. you idiot. fine", lexicon)[2] == 1


def test_composition_has_all_states():
    assert len(T.GRAMMAR.step) == 1 * 3 * 2 * 4 * 2
    assert all(0 <= s < len(T.GRAMMAR.step) for row in T.GRAMMAR.step for s in row)


def test_held_out_accuracy(spark):
    from shelfmark.llm.queries import op2_toxicity

    folder = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in op2_toxicity(spark, folder).collect()}
    labels = [r for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(rows[r.doc_id].held_out for r in labels)
    assert sum(rows[r.doc_id].predicted == r.toxic for r in labels) >= 0.97 * len(labels)
    toxic = [r for r in labels if r.toxic]
    assert sum(rows[r.doc_id].predicted for r in toxic) >= 0.85 * len(toxic)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "you idiot " * 20_000, "a"), (None, "scum", "a"), (2, "", "a")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    rows = T.toxicity(docs, T.fit(docs, labels)).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert T.toxicity(docs.limit(0), T.fit(docs, labels)).count() == 0


def test_clauses_are_cut_wherever_a_stop_stands():
    lexicon = {w: (k, 2.0 if k in (T.INSULT, T.THREAT) else 0.0) for k, words in T.KNOWN.items() for w in words.split()}
    for text in ("you are. idiot here", "you are.idiot here", "well;idiot:", "IDIOT!?you", "(idiot).\nyou"):
        assert T.features(text, lexicon)[0] == 2.0, text
    assert T.features("you;idiot:you", lexicon)[0] == 2.0 and T.features("you idiot", lexicon)[0] > 2.0
    assert T.words_of("you;idiot:*you*.") == ["you", "idiot", "you"]


def _plain(text, lexicon):
    """The features by the rules themselves, word by word and without any shortcut or composition."""
    scores = []
    for clause in re.split(r"[.!?;:\n]", text.lower()):
        words = [w for w in (x.strip(T._EDGES) for x in clause.split()) if w]
        kinds = [lexicon.get(w, (T.OTHER, 0.0)) for w in words]
        score, target, report, negation, threat, aimed = 0.0, False, False, 0, False, False
        for kind, weight in kinds:
            if kind in (T.INSULT, T.THREAT):
                score += weight * (1.25 if target else 1) * (0.5 if negation else 1) * (0.7 if report else 1)
            aimed |= kind == T.TARGET
            threat |= kind == T.THREAT
            target |= kind == T.TARGET
            report |= kind == T.REPORT
            negation = 3 if kind == T.NEGATION else max(0, negation - 1)
        if threat and not aimed:
            score *= 0.4
        if aimed:
            score *= 1.1
        if any(kind in (T.INSULT, T.THREAT) for kind, _ in kinds):
            scores.append(score)
    n = len(text.lower().split())
    return [max(scores, default=0.0), math.log1p(sum(scores)), len(scores), 100 * sum(scores) / (n + 20), math.log1p(n)]


def test_all_documents_against_a_plain_scorer(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = T.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = {r.doc_id: r.score for r in T.toxicity(docs, model).collect()}
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    plain = model.scores([_plain(t, model.lexicon) for _, t in texts])
    assert len(rows) == len(texts) and all(abs(rows[i] - s) < 1e-9 for (i, _), s in zip(texts, plain))
