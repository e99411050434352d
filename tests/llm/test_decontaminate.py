import random

from shelfmark.llm import decontaminate as D
from shelfmark.llm.decontaminate import drop_leaks, leaks

QUESTION = "What is 12 km plus 30 km when Bob walks with Alice in the rain today and tomorrow?"


def test_exact_and_reparameterised(spark):
    docs = spark.createDataFrame(
        [
            (1, f"Before it. {QUESTION} And after it.", 9),
            (2, "So. What is 15 km plus 31 km when Tom walks with Eve in the rain today and tomorrow? ok", 9),
            (3, "Nothing of that kind is here, only words that stand in a row for a while and then end.", 9),
            (4, None, 9), (5, "", 9), (6, "What is 12 km plus 30 km", 9), (1, f"Before it. {QUESTION} And after it.", 9), (None, QUESTION, 9), (7, f"{QUESTION} " * 500, 9),
        ],
        "doc_id long, text string, item_id int",
    )
    items = spark.createDataFrame([(7, QUESTION), (8, QUESTION.replace("30", "12")), (9, None), (10, "a b"), (7, QUESTION)], "item_id long, text string")
    rows = {(r.doc_id, r.item_id): r for r in leaks(docs, items).collect()}
    assert set(rows) >= {(1, 7), (2, 7), (None, 7), (7, 7)} and not {d for d, _ in rows} & {3, 4, 5, 6}
    assert rows[1, 7].kind == "exact" and rows[1, 7].changed == 0
    assert rows[2, 7].kind == "reparameterised" and rows[2, 7].changed == 4
    assert (2, 8) not in rows  # one value of the item would stand for two
    kept = drop_leaks(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [3, 4, 5, 6]
    assert kept.where("doc_id IS NULL").count() == 1


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert leaks(docs, items).count() == 0
    some = spark.createDataFrame([(1, QUESTION)], "doc_id long, text string")
    assert leaks(some, items).count() == 0 and drop_leaks(some, items).count() == 1


def test_against_brute_force(spark):
    """Passages without slots: a document leaks an item exactly if it holds 80 % of its 5-word windows."""
    rng = random.Random(2)
    vocabulary = [f"{a}{b}" for a in "bcdfghklmn" for b in ("ala", "olo", "ebe", "iki", "ufu")]
    item = [rng.sample(vocabulary, 20) for _ in range(10)]
    rows = []
    for i in range(200):
        words = rng.choices(vocabulary, k=30)
        part = item[i % 10][: rng.choice([20, 20, 17, 12, 0])]
        rows.append((i, " ".join(words[:10] + part + words[10:])))
    windows = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    expected = {(i, j) for i, t in rows for j, w in enumerate(item) if len(windows(w) & windows(t.split())) >= 0.8 * len(windows(w))}
    found = leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(j, " ".join(w)) for j, w in enumerate(item)], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == expected


def test_benchmark_passages_in_the_given_documents(spark):
    from shelfmark.llm.queries import op1_decontamination

    folder = "/root/testdata/sf0.01"
    found = {(r.doc_id, r.item_id) for r in op1_decontamination(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{folder}/benchmark.parquet").collect()
    assert {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text} <= found


def test_items_without_regular_windows(spark):
    """Few words, only numbers, mostly names or units, scripts without spaces: found where the whole text stands in a document."""
    items = [(1, "Photosynthesis"), (2, "Blue whale?"), (3, "who wrote it"), (4, "name the largest planet"), (5, "12 + 30 * 5 = 9"), (6, "中国的首都是哪里？"), (7, "7 km 8 m Alice Bob Carol 9"), (8, "?!"), (9, QUESTION), (9, "short one"), (10, "日本で一番高い山")]
    texts = ["about photosynthesis here", "A blue whale swims.", "So: who wrote it", "Please name the largest planet now", "It is 12 + 30 * 5 = 9, no?", "问：中国的首都是哪里？答", "from 7 km 8 m Alice Bob Carol 9 on", "?!", "a short one", "富士山は日本で一番高い山です"]
    apart = ["photosynthetic", "blue. A whale", "who wrote", "it. who wrote", "name largest planet", "12 30 5", "中国的首都", "7 km 8 m Alice Carol Bob 9", "日本で一番", "short", None, ""]
    docs = spark.createDataFrame(list(enumerate([*texts, *apart])), "doc_id long, text string")
    found = leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (8, 9), (9, 10)}
    assert len(found) == 9 and {(r.kind, r.windows, r.matched) for r in found} == {("exact", 1, 1)}


def test_short_texts_of_one_id_are_not_mixed(spark):
    items = spark.createDataFrame([(1, "red green blue"), (1, "lime pink grey")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "red green grey"), (2, "red green pink grey"), (3, "red green"), (3, "x green blue"), (None, "lime pink grey")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in leaks(docs, items).collect()] == [(None, 1)]


def test_null_and_text_ids_are_judged_as_others(spark):
    """The same inconsistent text is no leak under any id, a null one too; ids can be text."""
    item = "A farmer has 12 apples and sells 12 apples then buys 30 pears and eats 30 pears before the long winter comes again"
    mixed = item.replace("12", "7", 1).replace("12", "8", 1).replace("30", "5", 1).replace("30", "6", 1)
    rows = [(2, mixed), (None, mixed), (3, item), (4, item.replace("12", "9").replace("30", "41"))]
    for kind, own in (("long", lambda x: x), ("string", lambda x: None if x is None else f"d{x}")):
        docs = spark.createDataFrame([(own(i), t) for i, t in rows], f"doc_id {kind}, text string")
        bench = spark.createDataFrame([(own(1), item), (None, "the quick brown fox jumps over the lazy dog every single day")], f"item_id {kind}, text string")
        found = {(r.doc_id, r.item_id): r.kind for r in D.leaks(docs, bench).collect()}
        assert found == {(own(3), own(1)): "exact", (own(4), own(1)): "reparameterised"}, found
        kept = {r.doc_id for r in D.drop_leaks(docs, bench).collect()}
        assert kept == {own(2), None}


def test_a_stem_of_many_items_and_documents_makes_no_pairs(spark):
    """1,000 items and 1,000 documents share a stem of 57 % of the windows; only the documents that have an item's own words are looked at."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("bcdfghklmnaeiou", k=9))
    stem = " ".join(word() for _ in range(20))
    own = [" ".join(word() for _ in range(12)) for _ in range(1000)]
    items = [(j, f"{stem} {o}") for j, o in enumerate(own)]
    docs = [(i, f"{stem} " + (own[i] if i % 50 == 0 else " ".join(word() for _ in range(12)))) for i in range(1000)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    seen = []
    plain = D._candidates
    try:
        D._candidates = lambda *a: seen.append(plain(*a)) or seen[-1]
        found = {(r.doc_id, r.item_id) for r in leaks(docs, items).collect()}
    finally:
        D._candidates = plain
    assert found == {(i, i) for i in range(0, 1000, 50)} and seen[0].count() == 20


def test_a_very_long_text_leaks_from_its_end(spark):
    docs = spark.createDataFrame([(1, "some words that go on " * 100_000 + QUESTION)], "doc_id long, text string")
    assert [(r.doc_id, r.item_id, r.kind) for r in leaks(docs, spark.createDataFrame([(7, QUESTION)], "item_id long, text string")).collect()] == [(1, 7, "exact")]
