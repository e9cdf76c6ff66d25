"""Tagged ways: tags to fixed columns, conditional hours, way-level restrictions to edges, relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Road class of the highway tag.
CLASSES = {"motorway": 0, "trunk": 1, "primary": 2, "secondary": 3, "tertiary": 4, "unclassified": 5, "residential": 6}
#: Weekday names, Sunday first.
DAYS = ["Su", "Mo", "Tu", "We", "Th", "Fr", "Sa"]


def transform_tags(ways: DataFrame) -> DataFrame:
    """(way_id, road_class, kph, oneway, toll) from rows (way_id, tags map); an unknown highway is class 7.

    maxspeed reads as km/h, or miles with 'mph'; anything else is null.
    """
    kind = F.col("tags")["highway"]
    road = F.lit(7)
    for name, number in CLASSES.items():
        road = F.when(kind == name, number).otherwise(road)
    number = F.expr("try_cast(regexp_extract(tags['maxspeed'], '^([0-9]+)', 1) AS INT)")
    kph = F.when(F.col("tags")["maxspeed"].endswith("mph"), F.round(number * 1.609344).cast("int")).otherwise(number)
    yes = [F.coalesce(F.col("tags")[t].isin("yes", "true", "1"), F.lit(False)).alias(t) for t in ("oneway", "toll")]
    return ways.select("way_id", road.alias("road_class"), kph.alias("kph"), *yes)


def weekday_mask(text: str) -> str:
    """Bits (Sunday 1) of 'Mo-Fr' or a single day, as an expression; all days without one."""
    number = lambda at: "(CASE " + " ".join(f"WHEN {at} = '{d}' THEN {k}" for k, d in enumerate(DAYS)) + " ELSE -1 END)"
    a, b = number(f"substr({text}, 1, 2)"), number(f"CASE WHEN substr({text}, 3, 1) = '-' THEN substr({text}, 4, 2) ELSE substr({text}, 1, 2) END")
    days = " + ".join(f"(CASE WHEN ({k} - {a} + 7) % 7 <= ({b} - {a} + 7) % 7 THEN {1 << k} ELSE 0 END)" for k in range(7))
    return f"(CASE WHEN {a} < 0 THEN 127 ELSE {days} END)"


def minutes_of(text: str, last: bool) -> str:
    """Minute of the day of the first or last hh:mm of 'hh:mm-hh:mm' in a text."""
    hh, mm = ("-([0-9]{2}):[0-9]{2}$", "-[0-9]{2}:([0-9]{2})$") if last else ("([0-9]{2}):[0-9]{2}-", "[0-9]{2}:([0-9]{2})-")
    return f"(CAST(regexp_extract({text}, '{hh}', 1) AS INT) * 60 + CAST(regexp_extract({text}, '{mm}', 1) AS INT))"


def resolve_restrictions(rules: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, from_edge, to_edge): way-level rules (rule, from_way, via_node, to_way) on the edges at their node."""
    into = edges.select(F.col("edge_id").alias("from_edge"), F.col("way_id").alias("from_way"), F.col("dst").alias("via_node"))
    out = edges.select(F.col("edge_id").alias("to_edge"), F.col("way_id").alias("to_way"), F.col("src").alias("via_node"))
    return rules.join(into, ["from_way", "via_node"]).join(out, ["to_way", "via_node"]).select("rule", "from_edge", "to_edge")
