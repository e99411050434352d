import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from shelfmark.llm import variants as V
from shelfmark.llm.common import Scratch


def brute_words(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def brute_near(words):
    """By deletions: words that share one, or are one, and then letter by letter."""
    by = defaultdict(set)
    for w in words:
        for x in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            by[x].add(w)
    near = defaultdict(set)
    for group in by.values():
        for a in group:
            for b in group:
                if a != b and one_edit(a, b):
                    near[a].add(b)
    return near


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = brute_words(rows)
    near = brute_near(n)
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 5 * n[w]:
                form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return out


def test_neighbourhood_is_full_and_has_no_word_twice():
    rng = np.random.default_rng(5)
    for size, symbols in ((1, 3), (4, 3), (6, 4)):
        m = rng.integers(33, 33 + symbols, (5, size)).astype(np.uint8)
        own, row, code = V.neighbourhood(m, symbols)
        for i, w in enumerate(m.tolist()):
            words = {tuple(w[:j] + w[j + 1 :]) for j in range(size)}
            words |= {tuple(w[:j] + [c] + w[j + 1 :]) for j in range(size) for c in range(33, 33 + symbols)} - {tuple(w)}
            words |= {tuple(w[:j] + [c] + w[j:]) for j in range(size + 1) for c in range(33, 33 + symbols)}
            mine = code[row == i]
            assert len(mine) == len(set(mine.tolist())) == len(words)
            expected = {V.neighbourhood(np.array([x], dtype=np.uint8).reshape(1, -1), symbols)[0][0] for x in words if x}
            assert expected <= set(mine.tolist())


@pytest.mark.parametrize("symbols", [4, 16, len(V.LETTERS)])
def test_near_words_for_every_alphabet(spark, symbols):
    words = ["planet", "planets", "planes", "plànet", "plamet", "plane", "xplanet", "lanet", "zzzzzz", "zzzzzzz", "zzzzz", "ÿÿÿÿÿÿ", "ÿÿÿÿÿ", "aaaaab", "aaaaba"]
    table = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    found = {(r.word, r.near) for r in V.near_words(table, Scratch(spark), symbols).collect()}
    assert found == {(a, b) for a in words for b in words if a != b and one_edit(a, b)}


def test_all_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in V.variants(docs).collect()}
    expected = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert len(expected) > 1000 and rows == expected


def test_edges(spark):
    long = "q" * 3000
    rows = [(1, None), (2, ""), (None, "Étoile ÉTOILE " * 40), (3, f"{long} " * 6 + f"{long}q " * 40), (3, "banana " * 900), (3, "banana " * 900), (4, "ban×ana bañana " * 7), (5, "banane " * 50 + "bananes " * 9 + "bananas " * 8)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int")
    found = V.variants(docs)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in found.collect()} == brute(rows)
    assert V.variants(docs.limit(0)).count() == 0


def test_the_alphabet_grows_with_the_words(spark):
    few = spark.createDataFrame([("planet", 5), ("comets", 5)], "word string, n long")
    assert V.choose(few) == V.SYMBOLS[0]
    many = spark.range(40_000).selectExpr("concat('word', translate(lpad(id, 5, '0'), '0123456789', 'abcdefghij')) AS word", "5L AS n")
    assert V.choose(many) > V.SYMBOLS[0]
