"""Edges as a folder of tiles by level and tile id, in place of one blob a tile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions import ids


def write_tiles(edges: DataFrame, path: str, level: int = 2) -> None:
    """Parquet partitioned by level and tile of the edge's begin; a tile's rows come in one file, by edge id."""
    tile = F.expr(ids.tile_id("lon1", "lat1", ids.LEVEL_DEGREES[level]))
    tiled = edges.withColumns({"level": F.lit(level), "tile": tile})
    tiled.repartition("tile").sortWithinPartitions("tile", "edge_id").write.partitionBy("level", "tile").parquet(path)


def read_tiles(spark: SparkSession, path: str, tiles: list[int] | None = None, level: int = 2) -> DataFrame:
    """The edges of some tiles (all, if none are named); only their folders are read."""
    held = spark.read.parquet(path).where(F.col("level") == level)
    return held if tiles is None else held.where(F.col("tile").isin(tiles))
