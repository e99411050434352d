import random
import re
from collections import Counter

import pytest

from shelfmark.llm import near_dedup as N


def sets_of(texts):
    out = {}
    for key, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out[key] = frozenset(zip(words, words[1:], words[2:], strict=False)) if len(words) >= 3 else frozenset([tuple(words)] if words else [])
    return out


def brute(texts):
    sets = sets_of(texts)
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


def check(spark, texts, extra=()):
    docs = spark.createDataFrame([(k, t, 0) for k, t in texts.items()] + list(extra), "doc_id long, text string, component_id int")
    rows = N.near_duplicates(docs).collect()
    expected = brute(texts)
    for row in rows:
        if row.doc_id is not None:
            assert (row.n_shingles, row.component_id) == expected[row.doc_id], row
            assert row.kept == (row.doc_id == row.component_id)
    return rows


@pytest.fixture(scope="module")
def words():
    return [f"w{i}" for i in range(3000)]


def test_edge_cases(spark):
    texts = {1: None, 2: "", 3: "  \n", 4: "one", 5: "ONE", 6: "one two", 7: "one two", 8: "a b c", 9: "a b c d", 10: "x " * 20_000, 11: "x x x"}
    rows = check(spark, texts, extra=[(None, "a b c", 0), (None, "alone here now", 0), (8, "a b c", 0)])
    loose = [r for r in rows if r.doc_id is None]
    assert sorted((r.component_id, r.kept) for r in loose if r.component_id) == [(8, False)]
    assert [r.kept for r in loose if r.component_id is None] == [True]
    assert N.keep_first(spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c"), (None, "q r s")], "doc_id long, text string")).count() == 2


def test_chains_and_a_large_near_copy_group(spark, words, monkeypatch):
    rng = random.Random(4)
    base = rng.sample(words, 150)
    texts = {}
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randrange(0, 14)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts[i] = " ".join(copy)
    chain = rng.sample(words, 200)
    for i in range(20):
        texts[1000 + i] = " ".join(chain[i * 5 :] + rng.sample(words, i * 5))
    for i in range(60):
        texts[2000 + i] = " ".join(rng.sample(words, 60))
    monkeypatch.setattr(N, "BLOCK", 16)
    check(spark, texts)
    monkeypatch.setattr(N, "BLOCK", 1024)
    monkeypatch.setattr(N, "CALL_BYTES", 20_000)
    check(spark, texts)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(docs).count() == 0
    assert N.keep_first(docs).count() == 0


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(120)] + [(500, 600), (600, 550)], "a long, b long")
    found = {r.id: r.component for r in N.components(edges).collect()}
    assert all(found[i] == 0 for i in range(121)) and found[550] == found[600] == found[500] == 500


def test_a_doc_id_has_one_component_and_no_text_is_lost(spark):
    rows = [(1, "a b c d e", "x"), (5, "a b c d e", "x"), (5, "q r s t u", "x"), (5, "q r s t u", "x"), (6, "q r s t u", "x"), (7, None, "x"), (7, "", "x"), (None, "q r s t u", "x"), (8, "only this one here", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, set_key string")
    found = {(r.doc_id, r.component_id) for r in N.near_duplicates(docs).collect()}
    assert found == {(1, 1), (5, 1), (6, 1), (7, 7), (None, 1), (8, 8)}
    kept = sorted(((r.doc_id, r.text) for r in N.keep_first(docs).collect()), key=str)
    assert [k for k in kept if k[0] != 7] == sorted([(1, "a b c d e"), (5, "q r s t u"), (8, "only this one here"), (None, "q r s t u")], key=str)
    assert len([k for k in kept if k[0] == 7]) == 1 and N.keep_first(docs).columns == docs.columns


def test_blank_texts_stay_once(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, ""), (3, None), (4, " ")], "doc_id long, text string")
    assert sorted(r.doc_id for r in N.keep_first(docs).collect()) == [1, 3, 4]


def test_recall_on_the_given_documents(spark):
    """All links of 10,000 documents, found by indexing the rarest shingles of each: components must be the same."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    sets = sets_of({r.doc_id: r.text for r in docs.collect()})
    df = Counter(g for s in sets.values() for g in s)
    index, parent = {}, {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = 0
    for k in sorted(sets):
        mine = sorted(sets[k], key=lambda g: (df[g], g))
        n = len(mine)
        prefix = mine[: n - -(-85 * n // 100) + 1]  # two linked sets share one of their rarest shingles
        for other in {o for g in prefix for o in index.get(g, ())}:
            if find(other) == find(k):
                continue
            both = len(sets[k] & sets[other])
            if 100 * both >= 85 * (n + len(sets[other]) - both):
                links += 1
                x, y = find(k), find(other)
                parent[max(x, y)] = min(x, y)
        for g in prefix:
            index.setdefault(g, []).append(k)
    found = {r.doc_id: r.component_id for r in N.near_duplicates(docs).collect()}
    wrong = sum(found[k] != find(k) for k in sets)
    assert links > 500 and wrong <= 0.01 * links, (links, wrong)
