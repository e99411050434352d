"""Queries by name with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfmark.sources.corpus import Corpus, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(text: str | None = None, *tables: str, recursive: bool = False):
    """Registers a function of Corpus under its name; text is its SQL over the domain tables named."""

    def wrap(f: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Corpus(spark, sf_dir))

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if text is not None:
            ORACLES[f.__name__] = sql(text, *tables, recursive=recursive)
        return f

    return wrap
