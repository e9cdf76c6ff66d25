"""Speed tables as JSON text, and their assignment to edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "array<struct<admin: bigint, urban: array<bigint>, rural: array<bigint>>>"


def parse_speed_table(text: DataFrame, column: str = "text") -> DataFrame:
    """(admin_id, urban, road_class, kph) of JSON [{"admin", "urban": [kph by class], "rural": [...]}]; null is no speed.

    An entry without an admin holds for all that have none of their own (admin_id null).
    """
    entry = text.select(F.explode(F.from_json(column, SCHEMA)).alias("e"))
    sides = entry.select(F.col("e.admin").alias("admin_id"), F.explode(F.array(F.struct(F.lit(True).alias("urban"), F.col("e.urban").alias("k")), F.struct(F.lit(False).alias("urban"), F.col("e.rural").alias("k")))).alias("s"))
    rows = sides.select("admin_id", "s.urban", F.posexplode("s.k").alias("road_class", "kph"))
    return rows.where("kph IS NOT NULL").select("admin_id", "urban", F.col("road_class").cast("long").alias("road_class"), "kph")


def assign_speeds(edges: DataFrame, table: DataFrame, urban: str = "density >= 8") -> DataFrame:
    """(edge_id, kph, changed): the speed of the admin's entry, else the general one, else the edge's own.

    The table is a small dimension: classes times admins times two.
    """
    held = edges.select("edge_id", "admin_id", "road_class", "speed", F.expr(urban).alias("urban"))
    own = table.where("admin_id IS NOT NULL").withColumnRenamed("kph", "own")
    general = table.where("admin_id IS NULL").select("urban", "road_class", F.col("kph").alias("general"))
    met = held.join(own, ["admin_id", "urban", "road_class"], "left").join(general, ["urban", "road_class"], "left")
    return met.selectExpr("edge_id", "coalesce(own, general, speed) AS kph", "coalesce(own, general, speed) <> speed AS changed")
