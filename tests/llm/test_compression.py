import zlib

import numpy as np

from shelfmark.llm import compression as C


def test_differences_tell_texts_apart():
    good = [f"the quiet river runs by the old mill number {i} and the fields of wheat".encode() for i in range(400)]
    bad = [f"BUY!! NOW!! {i} CHEAP!! OFFER!! CLICK!! HERE!! WIN!!".encode() for i in range(400)]
    b, g = C.dictionary(bad), C.dictionary(good)
    d = C.differences([b"the old mill by the river and the quiet fields", b"CLICK!! HERE!! BUY!! CHEAP!! OFFER!!", b""], b, g)
    assert d[0] > 0 > d[1] and d[2] == 0


def test_all_of_a_text_counts():
    good, bad = C.dictionary([b"green meadows and slow rivers %d" % i for i in range(300)]), C.dictionary([b"$$$ WIN MONEY %d $$$" % i for i in range(300)])
    start = b"green meadows and slow rivers " * 500
    assert C.differences([start + b"$$$ WIN MONEY " * 2000], bad, good)[0] < C.differences([start], bad, good)[0]


def test_few_pieces_are_a_dictionary_themselves():
    assert C.dictionary([b"only one"]) == b"only one"


def test_held_out_accuracy(spark):
    from shelfmark.llm.queries import op11_compression_quality

    folder = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in op11_compression_quality(spark, folder).collect()}
    assert len(rows) == 10_000
    labels = [r for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(rows[r.doc_id].held_out for r in labels)
    right = np.mean([rows[r.doc_id].predicted == r.quality for r in labels])
    assert right >= 0.95, right
    # calibrated: scores say how many are good
    scores = np.array([rows[r.doc_id].score for r in labels])
    truth = np.array([r.quality for r in labels])
    assert abs(scores.mean() - truth.mean()) < 0.03
    poor = [r for r in labels if not r.quality]
    assert np.mean([rows[r.doc_id].predicted == 0 for r in poor]) > 0.75


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "very long " * 300_000, "a"), (None, "x", "a"), (2, "", "a"), (7, "ok", "a")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = C.quality_scores(docs, C.fit(docs, none)).collect()
    assert len(rows) == 6 and {r.score for r in rows} == {0.5}
    one = spark.createDataFrame([(1, 1), (None, 0), (3, None)], "doc_id long, quality int")
    assert {round(r.score, 6) for r in C.quality_scores(docs, C.fit(docs, one)).collect()} == {round(2 / 3, 6)}
    many = spark.createDataFrame([(i, f"good words of calm prose number {i} " * 40 if i % 2 else f"BAD!! {i} SHOUT!! " * 60) for i in range(200)] + [(9, "good words again")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(9, 0)], "doc_id long, quality int")
    model = C.fit(many, labels)
    rows = C.quality_scores(docs, model).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert C.quality_scores(docs.limit(0), model).count() == 0
    broken = spark.sql("SELECT 5L AS doc_id, cast(X'FF6162' AS string) AS text")
    assert C.quality_scores(broken, model).count() == 1
