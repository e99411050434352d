"""The corpus pipeline: quality rules, near-dedup, decontamination, personal data, token counts; each stage written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm import stages

#: (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
STAGES = stages.STAGES

#: SQL can express neither signatures nor token merges; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage keeps is written in the shared folder before the next one reads it."""
    return stages.run(spark, sf_dir, STAGES)
