"""Shared-folder tables: the way operators cut lineage so that lost executors cost a re-read only."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; without one, a folder of our own in local mode, else an error."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pathloom-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/pathloom/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that no returned DataFrame reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """The tables of one run that its result doesn't read; ``clear`` deletes them once the result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def saved(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(fresh_path(self.spark, name))
        return saved(df, name, self.paths[-1])

    def clear(self) -> None:
        while self.paths:
            discard(self.spark, self.paths.pop())
