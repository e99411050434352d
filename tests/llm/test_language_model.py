import math
import zlib
from collections import Counter

import numpy as np

from shelfmark.llm import language_model as L
from shelfmark.llm.common import hash_words

LOWER = bytes(k + 32 if 65 <= k <= 90 else k for k in range(256))


def brute(rows):
    tokens = [(i, (t or "").encode().translate(LOWER).split() + [None]) for i, t in rows]
    counts = Counter()
    for i, w in tokens:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(w)
    total, distinct = sum(counts.values()), len(counts)
    return total, [(i, len(w), sum(counts[x] > 0 for x in w), sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w)) for i, w in tokens]


def test_base_scores_match_brute_force(spark):
    rows = [(i, f"The cat {i % 5} sat on mat{i % 11} {i}") for i in range(300)] + [(900, None), (901, ""), (902, "The " * 20_000), (None, "no id")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    total, expected = brute(rows)
    found = {r.doc_id: r for r in L.score(docs).collect()}
    assert len(found) == len(rows)
    for i, n, known, base in expected:
        r = found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9) and math.isfinite(r.score)
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 7 == 2)


def test_rare_words_are_joined(spark, monkeypatch):
    monkeypatch.setattr(L, "COMMON", 4)
    rows = [(i, f"a b c word{i % 50} only{i}") for i in range(200)]
    total, expected = brute(rows)
    found = {r.doc_id: r for r in L.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, _, known, base in expected:
        assert found[i].n_known == known and math.isclose(found[i].base_score, base, rel_tol=1e-9)


def test_probabilities_are_normalised():
    rng = np.random.default_rng(1)
    words, counts = np.sort(rng.integers(1, 1 << 60, 50).astype(np.uint64)), rng.integers(1, 100, 50)
    vocab = L.Vocabulary(np.concatenate(([L.END], words)), np.concatenate(([40], counts)), int(counts.sum()) + 40, 51)
    p = L.Parameters(vocab)
    p.r1, p.q = p.r1 * 5, p.q * 5
    scorer = L.Scorer(p)
    every = np.arange(len(vocab.prior))
    for a, b in ((0, 1), (5, 7)):
        assert math.isclose(sum(10 ** scorer.log10(every, np.full(len(every), a), np.full(len(every), b))), 1, rel_tol=1e-4)


def test_beats_the_base_on_held_out_texts(spark):
    from shelfmark.llm.queries import op8_log_bilinear

    rows = [r for r in op8_log_bilinear(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_empty_table(spark):
    assert L.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_modelled_vocabulary_grows_and_words_beyond_the_old_head_have_vectors(spark):
    """6000 words of about one frequency, too many for a head of 2047: each has a symbol and vectors that are trained."""
    sizes = []
    for pairs in (300, 3000):
        rows = [(i, " ".join(f"left{j} right{j}" for j in np.random.default_rng(i).integers(0, pairs, 100))) for i in range(pairs)]
        learnt = spark.createDataFrame(rows, "doc_id long, text string")
        vocab = L.vocabulary(L.count_words(learnt))
        sizes.append(len(vocab.prior))
    assert sizes == [602, 6002]
    at, known = vocab.find(hash_words([f"{side}{j}" for side in ("left", "right") for j in range(pairs)]))
    symbols = vocab.symbols[at]
    assert known.all() and len(set(symbols)) == 2 * pairs and 0 not in symbols
    trained, new = L.train(learnt, vocab), L.Parameters(vocab)
    for mine, start in ((trained.r1, new.r1), (trained.r2, new.r2), (trained.q, new.q)):
        assert (np.abs(mine[symbols] - start[symbols]).max(axis=1) > 0.01).all()


def _plain_score(model, text):
    """log10 probability of a text by the formulas, word by word in Python's own floats."""
    v, p = model.vocab, model.parameters
    counts = {int(w): int(n) for w, n in zip(v.words, v.counts, strict=True)}
    symbol = {int(w): int(k) for w, k in zip(v.words, v.symbols, strict=True)}
    hashes = [int(hash_words([w])[0]) for w in text.encode().translate(LOWER).decode().split()] + [int(L.END)]
    a = b = v.end
    total = 0.0
    for x in hashes:
        w = symbol.get(x, 0)
        h = [float(p.r1[a][i]) + float(p.r2[b][i]) for i in range(L.WIDTH)]
        dot = lambda row, bias: sum(x * float(y) for x, y in zip(h, row, strict=True)) + float(bias)  # noqa: B023, E731
        classes = [dot(r, c) for r, c in zip(p.k, p.class_bias, strict=True)]
        members = [k for k in range(len(p.group)) if p.group[k] == p.group[w]]
        words = {k: dot(p.q[k], p.bias[k]) for k in members}
        total += classes[p.group[w]] - math.log(sum(map(math.exp, classes))) + words[w] - math.log(sum(map(math.exp, words.values())))
        if w == 0:
            total += math.log((counts.get(x, 0) + 1) / (v.other_tokens + v.other_distinct + 1))
        a, b = w, a
    return total / math.log(10)


def test_scores_match_brute_force_and_do_not_depend_on_neighbours(spark, monkeypatch):
    monkeypatch.setattr(L, "DETAIL", 2)
    rows = [(i, " ".join(f"w{(i * k) % 13}" for k in range(1, 9)) + f" rare{i}") for i in range(200)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    assert 0 < (model.vocab.symbols == 0).sum() and len(model.vocab.prior) > 5
    texts = ["w1 w2 w3", "W5 unseen w5", "", "w3", "rare7 w1"]
    alone = [L.score(spark.createDataFrame([(1, t)], "doc_id long, text string"), model).first().score for t in texts]
    for text, found in zip(texts, alone, strict=True):
        assert math.isclose(found, _plain_score(model, text), rel_tol=1e-5)
    for before in ("w7 w8", "w2 w2 w2", "other"):
        together = [(k, t) for k, t in enumerate([x for t in texts for x in (before, t)])]
        found = {r.doc_id: r.score for r in L.score(spark.createDataFrame(together, "doc_id long, text string").coalesce(1), model).collect()}
        assert all(math.isclose(found[2 * k + 1], alone[k], rel_tol=1e-6) for k in range(len(texts)))


def test_the_model_does_not_depend_on_how_the_input_is_split(spark, monkeypatch):
    monkeypatch.setattr(L, "BUCKET_TOKENS", 500)
    rows = [(i if i % 10 else -i, " ".join(f"w{(i * k) % 17}" for k in range(1, 20))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, other = (L.fit(df).parameters.flat() for df in (docs.coalesce(1), docs.repartition(9, "text")))
    assert np.array_equal(one, other) and np.abs(one - L.Parameters(L.vocabulary(L.count_words(docs))).flat()).max() > 0.01


def test_frequent_words_are_in_small_classes_and_wide_products_are_right():
    counts = (100_000 / np.arange(1, 400)).astype(np.int64)
    vocab = L.Vocabulary(np.arange(1, 400, dtype=np.uint64), counts, int(counts.sum()), 399)
    p = L.Parameters(vocab)
    sizes = np.diff(p.first)[1:]
    assert 15 <= len(sizes) <= 20 and sizes[0] < 5 < sizes[-1] and sizes.sum() == len(vocab.prior) - 1
    p.r1, p.r2 = p.r1 * 900, p.r2 * 900  # exp of many products is no number of single precision
    w, a, b = np.random.default_rng(3).integers(0, len(vocab.prior), (3, 500))
    found = L.Scorer(p).log10(w, a, b)
    h = (p.r1[a] + p.r2[b]).astype(np.float64)
    classes, words = h @ p.k.T.astype(np.float64) + p.class_bias, h @ p.q.T.astype(np.float64) + p.bias
    same = p.group[w][:, None] == p.group[None]
    log_sum = lambda x: x.max(axis=1) + np.log(np.exp(x - x.max(axis=1)[:, None]).sum(axis=1))
    each = np.arange(500)
    expected = classes[each, p.group[w]] - log_sum(classes) + words[each, w] - log_sum(np.where(same, words, -np.inf))
    assert np.abs(h @ p.k.T).max() > 100 and np.allclose(found, expected / math.log(10), rtol=1e-4, atol=1e-3)


def test_a_table_of_a_file_for_each_core_is_not_sent_again(spark, tmp_path):
    from shelfmark.sources.corpus import spread

    texts = spark.range(40).select("id")
    cores = spark.sparkContext.defaultParallelism
    for files in (1, cores):
        texts.coalesce(1).repartition(files).write.parquet(f"{tmp_path}/{files}")
        plan = spread(spark.read.parquet(f"{tmp_path}/{files}"))._jdf.queryExecution().optimizedPlan().toString()
        assert ("Repartition" in plan) == (files < cores)
