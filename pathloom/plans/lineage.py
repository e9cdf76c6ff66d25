"""Cutting lineage in the shared checkpoint folder, so that iterative jobs survive lost executors."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names the folder in spark.checkpoint.dir; only in local mode a folder of our own stands in."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="pathloom-"))


def cut(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
