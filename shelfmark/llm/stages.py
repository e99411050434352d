"""The stages of the corpus pipeline, each a thin call of one operator."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from .common import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    from .quality import keep_good

    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    from .near_dedup import keep_first

    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    from .decontaminate import drop_leaks

    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; no document goes."""
    from .pii import redact

    return redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each redacted text."""
    import public_tokenizers

    from .bpe import round_trip

    return round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("redaction", redaction),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str, stages: Sequence[tuple[str, Stage]], folder: str | None = None) -> DataFrame:
    """The last stage's rows. Every stage is written as Parquet under `folder` (a new one in the shared checkpoint folder by default), in a folder of its name.

    With a folder of its own a run that failed goes on where it stopped: stages that are complete there are read, not made again.
    Null texts and blank ones go in the first stage; an empty table passes through all stages; columns beside doc_id and text stay to the last stage but one,
    whatever their names; rows that repeat a doc_id are told apart by their texts.
    """
    folder = folder or Scratch(spark, "pipeline").path
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(stages):
        path = f"{folder}/{k}-{name}"
        if not _complete(spark, path):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs


def _complete(spark: SparkSession, path: str) -> bool:
    """Was a table written to its end? Spark's committer leaves a mark."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)
