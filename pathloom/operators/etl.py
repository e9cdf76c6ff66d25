"""Batch derivation of a network: density, edges from ways, hierarchy levels, stop impact, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.plans.lineage import cut


def density(lengths: DataFrame, cell_area: float, most: int = 15) -> DataFrame:
    """(r, c, density) of cells from rows (r, c, length): each cell's sum goes to its nine neighbours, then one sum."""
    cells = lengths.groupBy("r", "c").agg(F.sum("length").alias("metres"))
    spread = cells.select("metres", F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(r + i AS r, c + j AS c, i = 0 AND j = 0 AS own))))")).alias("n")).select("n.*", "metres")
    summed = spread.groupBy("r", "c").agg(F.sum("metres").alias("metres"), F.count("*").alias("cells"), F.bool_or("own").alias("own")).where("own")
    return summed.select("r", "c", F.expr(f"CAST(least(15, round(0.7e0 * metres * 0.0005e0 / ({cell_area}e0 * cells))) AS BIGINT)").alias("density"))


def edges_of_ways(way_nodes: DataFrame) -> DataFrame:
    """(way_id, edge, from_node, to_node, points): ways split at their ends and at nodes that several uses share.

    ``way_nodes`` has (way_id, seq, node_id).
    """
    uses = way_nodes.groupBy("node_id").agg(F.count("*").alias("uses"))
    by_way = Window.partitionBy("way_id").orderBy("seq")
    held = way_nodes.join(uses, "node_id").withColumns({"first": F.row_number().over(by_way) == 1, "last": F.lead("seq").over(by_way).isNull()})
    held = held.withColumn("cut", F.col("first") | F.col("last") | (F.col("uses") > 1))
    held = held.withColumn("edge", F.sum(F.col("cut").cast("int")).over(by_way.rowsBetween(Window.unboundedPreceding, 0)))
    # a cutting node ends the edge before it as well
    ends = held.where("cut AND NOT first").select("way_id", (F.col("edge") - 1).alias("edge"), "seq", "node_id")
    parts = held.where("NOT (cut AND last)").select("way_id", "edge", "seq", "node_id").unionByName(ends)
    return parts.groupBy("way_id", "edge").agg(F.min_by("node_id", "seq").alias("from_node"), F.max_by("node_id", "seq").alias("to_node"), F.count("*").alias("points"))


def hierarchy(edges: DataFrame, classes: str = "road_class") -> DataFrame:
    """(node_id, levels, best): levels a node is on, by the classes of its edges (0-2 highway, 3-4 arterial, else local)."""
    level = f"CASE WHEN {classes} <= 2 THEN 0 WHEN {classes} <= 4 THEN 1 ELSE 2 END"
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id"), F.expr(level).alias("level"))
    return ends.groupBy("node_id").agg(F.array_join(F.sort_array(F.collect_set("level")), ",").alias("levels"), F.min("level").alias("best"))


def stop_impact(pairs: DataFrame) -> DataFrame:
    """``pairs`` (from_class, best_other, turn) with the stop impact of a plain junction: class difference, 0 to 7."""
    raw = "CASE WHEN best_other IS NULL THEN 0 ELSE greatest(0, least(from_class, 5) - best_other + 3) END"
    return pairs.withColumn("stop_impact", F.expr(f"CAST(least(7, CASE WHEN turn IN (3, 5) THEN {raw} + 1 WHEN turn IN (1, 7) THEN floor(({raw}) / 2e0) ELSE {raw} END) AS BIGINT)"))


def invalid_edges(edges: DataFrame) -> DataFrame:
    """(edge_id, problem): edges without an opposing edge, or whose lengths differ."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("length").alias("back"))
    met = edges.select("edge_id", "src", "dst", "length").join(back, ["src", "dst"], "left")
    return met.where("back IS NULL OR back <> length").select("edge_id", F.when(F.col("back").isNull(), "no opposing edge").otherwise("lengths differ").alias("problem"))


def dictionary(df: DataFrame, column: str, index: str = "idx") -> DataFrame:
    """(column, index): a gapless number from 1 for each distinct value, in its order.

    Values are dealt into ordered ranges; a value's number is its place in its range and the sizes of those before.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = cut(df.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(parts, column).sortWithinPartitions(column).select(column, F.spark_partition_id().alias("_part"), place.alias("_place")))
    before, starts = 1, []
    for r in dealt.groupBy("_part").count().orderBy("_part").collect():  # one row a range
        starts.append((r["_part"], before))
        before += r["count"]
    held = df.sparkSession.createDataFrame(starts, "_part int, _start long")  # as many rows as ranges
    return dealt.join(F.broadcast(held), "_part").select(column, (F.col("_start") + F.col("_place")).alias(index))


def kept_graph(edges: DataFrame, condition: str) -> DataFrame:
    """(edge_id, src, dst): edges that pass, their nodes numbered anew without gaps in the order of their ids."""
    left = cut(edges.where(condition).select("edge_id", "src", "dst"))
    numbers = dictionary(left.select(F.explode(F.array("src", "dst")).alias("node")), "node", "number")
    by_src = left.join(numbers.withColumnRenamed("node", "src"), "src").withColumnRenamed("number", "new_src")
    return by_src.join(numbers.withColumnRenamed("node", "dst"), "dst").select("edge_id", F.col("new_src").alias("src"), F.col("number").alias("dst"))


def enhance(edges: DataFrame, cells: DataFrame, cell: float = 0.02, x0: float = 4.0, y0: float = 52.0, urban: int = 8, ends: int = 1) -> DataFrame:
    """(edge_id, density, urban, dead_end): density of the cell an edge begins in, and whether at most ``ends`` ways lead on.

    ``cells`` has (r, c, density); with ``ends`` at 1 a dead end has only the way back.
    """
    held = edges.selectExpr("edge_id", "src", "dst", f"CAST(floor((lat1 - {y0}e0) / {cell}e0) AS BIGINT) AS r", f"CAST(floor((lon1 - {x0}e0) / {cell}e0) AS BIGINT) AS c")
    outs = edges.groupBy(F.col("src").alias("dst")).agg(F.count_distinct("dst").alias("outs"))
    met = held.join(cells, ["r", "c"], "left").join(outs, "dst", "left")
    return met.selectExpr("edge_id", "coalesce(density, 0) AS density", f"coalesce(density, 0) >= {urban} AS urban", f"coalesce(outs, 0) <= {ends} AS dead_end")
