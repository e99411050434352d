from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest

from shelfmark.llm import bpe, near_dedup, quality, stages


def test_stages_follow_each_other(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, sizes, kept = docs.columns, [], {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = (before, docs)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[2] == sizes[3] == sizes[4]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(kept["quality_rules"][1]) == ids(quality.quality(kept["quality_rules"][0]).where("kept"))
    assert ids(kept["near_dedup"][1]) == ids(near_dedup.near_duplicates(kept["near_dedup"][0]).where("kept"))
    again = {r.doc_id: r for r in bpe.round_trip(kept["tokens"][0], public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).collect()}
    assert {r.doc_id: r for r in docs.collect()} == again


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert set(out.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} and out.count() > 0


def test_a_run_goes_on_where_it_stopped(spark, tmp_path):
    folder, made = str(tmp_path / "run"), []

    def noted(name, stage):
        def run(spark, docs, sf_dir):
            made.append(name)
            if name == "decontamination" and len(made) == 3:
                raise RuntimeError("lost")
            return stage(spark, docs, sf_dir)

        return name, run

    noted_stages = [noted(*s) for s in corpus_pipeline.STAGES[:4]]
    with pytest.raises(RuntimeError, match="lost"):
        stages.run(spark, "/root/testdata/sf0.001", noted_stages, folder)
    out = stages.run(spark, "/root/testdata/sf0.001", noted_stages, folder)
    assert made == ["quality_rules", "near_dedup", "decontamination", "decontamination", "redaction"] and out.count() > 0


def test_stages_bear_odd_tables(spark, tmp_path):
    """Nulls in every column, blank, long and repeated texts, clashing columns, and no rows at all."""
    good = " ".join(f"word{i}" for i in range(80))
    other = " ".join(f"term{i * 3}" for i in range(90))
    rows = [(1, good, None, "a", 5, "k", "r"), (1, good, None, "a", 5, "k", "r"), (1, other, "en", None, None, None, "r"), (2, None, None, None, None, None, None), (3, "", "en", "b", 0, "k", "r"), (None, good + " more", "en", "b", 0, "k", "r"), (4, good + " x", "en", "b", 9, "k", "r"), (5, " ".join(f"long{i}" for i in range(30_000)), "en", "b", 9, "k", "r")]
    columns = "doc_id long, text string, lang string, source string, n_chars long, set_key string, row string"
    for part, expected in ((rows, {1: 2, None: 1, 5: 1}), ([], {})):
        docs = spark.createDataFrame(part, columns)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
            path = f"{tmp_path}/{len(part)}-{k}"
            stage(spark, docs, "/root/testdata/sf0.001").write.parquet(path)
            docs = spark.read.parquet(path)
            assert docs.columns == [c.split()[0] for c in columns.split(", ")]
        assert Counter(r.doc_id for r in docs.collect()) == expected
        assert corpus_pipeline.STAGES[4][1](spark, docs, "").count() == sum(expected.values())
