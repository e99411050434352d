"""Intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Where that is unset, a session on one machine takes a temporary one; on a cluster that is an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="shelfmark-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """The rows of df, written to the checkpoint folder; later jobs read them and survive lost executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Tables of one computation as Parquet in the shared checkpoint folder: columns can be read alone, and their sizes are known, so that Spark sends small ones to all tasks by itself."""

    def __init__(self, spark: SparkSession, name: str = "scratch") -> None:
        self.spark, self.count = spark, 0
        self.path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.path}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Deletes the tables."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)
