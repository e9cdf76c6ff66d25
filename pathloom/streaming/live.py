"""Structured Streaming over live speeds and traces: windows with watermarks, sessions, latest state, online thinning.

Each function takes a streaming (or batch) DataFrame with (event_id, ts, user_id, event_type, value).
``run_to_end`` drives a stream over files through to a table, one file-source micro-batch after another.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pathloom.plans.lineage import ensure_checkpoint_dir

LATENESS = "10 minutes"


def bucket_means(events: DataFrame, minutes: int = 5) -> DataFrame:
    """Mean speed of each edge (user) in tumbling windows, late events beyond the watermark dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATENESS)
    grouped = timed.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.unix_timestamp("w.start").alias("start"), "user_id", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "2 hours") -> DataFrame:
    """Traces cut where no event came for ``gap``."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATENESS)
    grouped = timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return grouped.select(F.unix_timestamp("w.start").alias("start"), "user_id", "n")


def first_of_each(events: DataFrame) -> DataFrame:
    """Repeated event ids dropped within the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATENESS)
    return timed.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id")


def running_counts(events: DataFrame) -> DataFrame:
    """Running count and last value of each user by custom state, one row per user and micro-batch."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for frame in frames:
            n += len(frame)
            total += float(frame["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [round(total, 4)]})

    return events.select("user_id", "value").groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def upsert_latest(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the last row of each user in versioned folders under ``path``."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
        merged = fresh if number == 0 else fresh.unionByName(spark.read.parquet(f"{path}/{number - 1}"))
        last = merged.groupBy("user_id").agg(F.max_by(F.struct("ts", "event_id", "value"), F.struct("ts", "event_id")).alias("r")).select("user_id", "r.*")
        last.write.mode("overwrite").parquet(f"{path}/{number}")

    return write


def run_to_end(spark: SparkSession, source: str, transform: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """Read ``source`` (parquet) as a stream, transform it, and return the table it wrote when all files are read.

    Append mode holds back what the watermark hasn't passed, as a stream does.
    """
    ensure_checkpoint_dir(spark)
    place = f"{spark.sparkContext.getCheckpointDir()}/pathloom-stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(source).schema
    stream = transform(spark.readStream.schema(schema).parquet(source))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).option("basePath", f"{place}/out").parquet(f"{place}/out").drop("batch")


def latest_state(spark: SparkSession, source: str) -> DataFrame:
    """The last event of each user, kept up by upserts."""
    ensure_checkpoint_dir(spark)
    place = f"{spark.sparkContext.getCheckpointDir()}/pathloom-stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(source).schema
    query = spark.readStream.schema(schema).parquet(source).writeStream.option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(upsert_latest(f"{place}/latest")).start()
    query.awaitTermination()
    last = query.lastProgress["batchId"] if query.lastProgress else 0
    return spark.read.parquet(f"{place}/latest/{last}")
