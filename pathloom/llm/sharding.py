"""Contiguous shards of near-equal bytes by global prefix sums.

Rows are dealt into ordered ranges of the id; each range's total gives the bytes before it, a running sum inside
the range gives the bytes before a row, and the shard is where that offset falls among equal targets. Only the
totals (one row a range) meet in one place; the texts themselves never leave their partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.workspace import shared_dir


def _placed(before: dict[int, int], total: int, shards: int, rows_before: dict[int, int], first_row: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_seen: dict[int, int] = {}
        rows_seen: dict[int, int] = {}
        for batch in batches:
            at = batch.column(3).to_numpy()
            size = batch.column(1).to_numpy()
            offset, rank = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for part in np.unique(at).tolist():
                own = at == part
                run_sum = np.cumsum(size[own])
                offset[own] = before[part] + bytes_seen.get(part, 0) + run_sum - size[own]
                rank[own] = rows_before[part] + rows_seen.get(part, 0) + np.arange(own.sum())
                bytes_seen[part] = bytes_seen.get(part, 0) + int(run_sum[-1])
                rows_seen[part] = rows_seen.get(part, 0) + int(own.sum())
            # the shard whose target interval holds the row's middle byte; exact in integers
            exact = offset.astype(object) if 2 * total * shards >= 2**63 else offset  # Python's integers, if need be
            middle = 2 * exact + size
            shard = np.minimum((middle * shards // (2 * total)).astype(np.int64), shards - 1)
            slot = rank - first_row[shard] if first_row is not None else rank
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(shard, pa.int32()), pa.array(slot, pa.int64())], names=["doc_id", "size", "text_crc32", "shard", "slot"])

    return run


def balanced_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard): every row in one of ``shards`` contiguous shards.

    size is the text's UTF-8 bytes plus 1 (null text: 1, crc 0). Rows are ordered by id (null ids first; equal
    ids by crc and size), so each shard is a range of ids, and shard sizes differ from total/shards by less than
    the largest row. slot counts a shard's rows from 0. law is 'bytes'; grown_shard is null, since with another
    count the cuts move. Equal texts get no special place. An empty table gives an empty result; other columns
    are not read.
    """
    spark = docs.sparkSession
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    order = ["doc_id", "text_crc32", "size"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared_dir(spark)
    # checkpoint() keeps a range in one partition, which a re-read table would not
    ranged = sized.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).checkpoint()
    totals = {r["part"]: (r["size"], r["rows"]) for r in ranged.groupBy("part").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()}
    before, rows_before, size, rows = {}, {}, 0, 0
    for part in sorted(totals):
        before[part], rows_before[part] = size, rows
        size, rows = size + totals[part][0], rows + totals[part][1]
    schema = "doc_id long, size long, text_crc32 long, shard int, slot long"
    ranked = ranged.mapInArrow(_placed(before, max(size, 1), shards, rows_before, None), schema)
    counts = {r["shard"]: r["count"] for r in ranked.groupBy("shard").count().collect()}
    first = np.cumsum([0, *(counts.get(k, 0) for k in range(shards - 1))])
    done = ranged.mapInArrow(_placed(before, max(size, 1), shards, rows_before, first), schema)
    return done.select(F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
