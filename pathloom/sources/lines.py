"""Lines given as text: encoded polylines and GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.codec import points_of

GEOJSON = "type string, geometry struct<type: string, coordinates: array<array<double>>>, coordinates array<array<double>>"


def geojson_points(lines: DataFrame, text: str = "text", id_col: str = "line") -> DataFrame:
    """(id, seq, lon, lat) of GeoJSON LineStrings, bare or as a feature; any other text gives no rows."""
    held = lines.select(id_col, F.from_json(text, GEOJSON).alias("o"))
    shape = F.when(F.col("o.type") == "LineString", F.col("o.coordinates")).when(F.col("o.geometry.type") == "LineString", F.col("o.geometry.coordinates"))
    points = held.select(id_col, F.posexplode(shape).alias("seq", "p"))
    return points.select(id_col, "seq", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))


def polyline_points(lines: DataFrame, text: str = "text", id_col: str = "line") -> DataFrame:
    """(id, seq, lon, lat) of encoded polylines with six digits."""
    points = lines.select(id_col, F.posexplode(points_of(text)).alias("seq", "p"))
    return points.select(id_col, "seq", "p.lon", "p.lat")
