"""Spatial joins by bins: the equi-join key that stands in for a spatial index."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions import geo
from pathloom.plans.lineage import cut

BIN = 0.05  #: degrees of a bin side
FINE = 0.01  #: of bins for radii of up to FINE_METRES
FINE_METRES = 600.0
COLUMNS = 7200  #: bins round the earth


def bin_row(lat: str, size: float = BIN) -> str:
    return f"CAST(floor(({lat} + 90e0) / {size}e0) AS BIGINT)"


def bin_col(lon: str, size: float = BIN) -> str:
    return f"CAST(floor(({lon} + 180e0) / {size}e0) AS BIGINT)"


def _bin_id(row: str, col: str, size: float) -> str:
    columns = round(360 / size)
    return f"{row} * {columns} + pmod({col}, {columns}) AS bin_id"


def _wrapped(lon: str, by: str) -> str:
    """A longitude moved by a turn, if need be, to lie within half a turn of another one."""
    return f"(CASE WHEN {lon} - {by} > 180e0 THEN {lon} - 360e0 WHEN {lon} - {by} < -180e0 THEN {lon} + 360e0 ELSE {lon} END)"


def edge_bins(edges: DataFrame, keep: tuple[str, ...] = ("edge_id",), size: float = BIN) -> DataFrame:
    """(bin_id, keep): the bins of each edge's box, exact for axis-parallel edges and a superset else.

    An edge over the date line takes the short way.
    """
    held = edges.selectExpr(*keep, "lat1 AS _a", "lat2 AS _b", "lon1 AS _x", f"{_wrapped('lon2', 'lon1')} AS _y")
    cols = held.selectExpr(*keep, "_a", "_b", f"explode(sequence({bin_col('least(_x, _y)', size)}, {bin_col('greatest(_x, _y)', size)})) AS _c")
    rows = cols.selectExpr(*keep, "_c", f"explode(sequence({bin_row('least(_a, _b)', size)}, {bin_row('greatest(_a, _b)', size)})) AS _r")
    return rows.selectExpr(_bin_id("_r", "_c", size), *keep)


def point_bins(points: DataFrame, margin: float, keep: list[str], metres: bool = False, size: float = BIN) -> DataFrame:
    """The points with every bin that a box of ``margin`` degrees (or metres) around them touches.

    In metres the box is as many degrees of longitude wide as the circle is at the point's latitude; around a pole it
    goes all the way round.
    """
    if metres:
        up = f"({margin / geo.METERS_PER_DEGREE:.15f}e0)"
        far = f"(abs(lat) + {up})"
        across = f"(CASE WHEN {far} >= 89.9e0 THEN 180e0 ELSE least(180e0, {up} / cos(radians({far}))) END)"
    else:
        up = across = f"({margin!r}e0)"
    held = points.selectExpr(*keep, f"{up} AS _up", f"{across} AS _across")
    first, columns = bin_col("(lon - _across)", size), round(360 / size)
    last = f"least({bin_col('(lon + _across)', size)}, {first} + {columns - 1})"
    cols = held.selectExpr("*", f"explode(sequence({first}, {last})) AS _c")
    rows = cols.selectExpr("*", f"explode(sequence({bin_row('(lat - _up)', size)}, {bin_row('(lat + _up)', size)})) AS _r")
    return rows.selectExpr(*keep, *(("_up", "_across") if metres else ()), _bin_id("_r", "_c", size))


def _binned(edges: DataFrame, size: float = BIN) -> DataFrame:
    return edge_bins(edges, ("edge_id", "lon1", "lat1", "lon2", "lat2"), size)


def _within(points: DataFrame, binned: DataFrame, radius: float, id_col: str, size: float = BIN) -> DataFrame:
    near = point_bins(points, radius, [id_col, "lon", "lat"], metres=True, size=size).join(binned, "bin_id").drop("bin_id")
    near = near.selectExpr(id_col, "edge_id", "lat", "lat1", "lat2", "lon1", "_up", "_across", f"{_wrapped('lon', 'lon1')} AS lon", f"{_wrapped('lon2', 'lon1')} AS lon2")
    # the boxes first: few of a bin's edges are left for the distance
    near = near.where("lat >= least(lat1, lat2) - _up AND lat <= greatest(lat1, lat2) + _up AND lon >= least(lon1, lon2) - _across AND lon <= greatest(lon1, lon2) + _across")
    met = near.selectExpr("*", f"{geo.project_share('lon', 'lat', 'lon1', 'lat1', 'lon2', 'lat2')} AS share")
    hits = met.selectExpr(id_col, "edge_id", "share", f"{geo.haversine('lon', 'lat', '(lon1 + share * (lon2 - lon1))', '(lat1 + share * (lat2 - lat1))')} AS metres").where(f"metres <= {radius}e0")
    return hits.dropDuplicates([id_col, "edge_id"])  # a pair may share several bins


def edges_within(points: DataFrame, edges: DataFrame, radius: float, id_col: str = "pt_id") -> DataFrame:
    """(id, edge_id, share, metres): edges within ``radius`` metres of each point; bins are joined, never all pairs.

    Holds at any latitude and over the date line. Points without an edge in reach have no row.
    """
    size = FINE if radius <= FINE_METRES else BIN
    return _within(points, _binned(edges, size), radius, id_col, size)


def points_within(points: DataFrame, others: DataFrame, radius: float, id_col: str = "pt_id", other_col: str = "node_id") -> DataFrame:
    """(id, other id, metres): places of ``others`` within ``radius`` metres of each point."""
    held = others.selectExpr(other_col, "lon AS lon2", "lat AS lat2", f"{bin_row('lat')} * {COLUMNS} + pmod({bin_col('lon')}, {COLUMNS}) AS bin_id")
    met = point_bins(points, radius, [id_col, "lon", "lat"], metres=True).join(held, "bin_id")
    return met.selectExpr(id_col, other_col, f"{geo.haversine('lon', 'lat', 'lon2', 'lat2')} AS metres").where(f"metres <= {radius}e0")


def closest_on_lines(points: DataFrame, lines: DataFrame, id_col: str = "pt_id") -> DataFrame:
    """(id, edge_id, share, metres): where each point (id, line, lon, lat) is closest to the edges of its line.

    Distances within a millimetre count as equal; the smaller id then comes first.
    """
    shot = points.select(id_col, "line", "lon", "lat").join(lines.select("line", "edge_id", "lon1", "lat1", "lon2", "lat2"), "line")
    shot = shot.selectExpr("*", f"{geo.project_share('lon', 'lat', 'lon1', 'lat1', 'lon2', 'lat2')} AS share")
    far = shot.selectExpr(id_col, "edge_id", "share", f"{geo.haversine('lon', 'lat', '(lon1 + share * (lon2 - lon1))', '(lat1 + share * (lat2 - lat1))')} AS metres")
    best = far.groupBy(id_col).agg(F.min(F.struct(F.round("metres", 3).alias("mm"), "edge_id", "share", "metres")).alias("b"))
    return best.select(id_col, "b.edge_id", "b.share", "b.metres")


def nearest_edges(points: DataFrame, edges: DataFrame, k: int, radius: float = 500.0, most: float = 35000.0, id_col: str = "pt_id") -> DataFrame:
    """The k nearest edges of each point, by rings of growing radius: only unmatched points go on.

    Edges are binned once. The first ring holds k edges on average, by the edges' number and the box around them, and
    ``radius`` metres at least. Distances within a millimetre count as equal; the smaller id then comes first.
    """
    binned = cut(_binned(edges))
    box = binned.agg(F.count_distinct("edge_id"), F.min("lon1"), F.max("lon1"), F.min("lat1"), F.max("lat1")).first()
    if box[0]:
        high, wide = (box[4] - box[3]) * geo.METERS_PER_DEGREE + 1, (box[2] - box[1]) * geo.METERS_PER_DEGREE * math.cos(math.radians((box[3] + box[4]) / 2)) + 1
        radius = min(most, max(radius, 2 * math.sqrt(k * high * wide / (math.pi * box[0]))))
    left, found, ring = points, None, radius
    order = Window.partitionBy(id_col).orderBy(F.round("metres", 3), "edge_id")
    while True:
        hits = _within(left, binned, ring, id_col).withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")
        if ring < most:
            hits = cut(hits.withColumn("_n", F.max("rank").over(Window.partitionBy(id_col))).where(f"_n >= {k}").drop("_n"))
        found = hits if found is None else found.unionByName(hits)
        if ring >= most:
            return found
        left = left.join(hits.where("rank = 1").select(id_col), id_col, "left_anti")
        if left.isEmpty():
            return found
        ring = min(most, ring * 4)


def self_intersections(shapes: DataFrame, cell: float = BIN) -> DataFrame:
    """(line, a, b): numbers of the segments of each line (line, seq, lon, lat) that meet and aren't neighbours.

    Segments meet in the bins of their boxes; a segment has the number of the point it begins at.
    """
    following = Window.partitionBy("line").orderBy("seq")
    parts = shapes.select("line", "seq", F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), F.lead("lon").over(following).alias("lon2"), F.lead("lat").over(following).alias("lat2"), F.lead("seq").over(following).alias("next")).where("next IS NOT NULL")
    binned = edge_bins(parts, ("line", "seq", "next", "lon1", "lat1", "lon2", "lat2"))
    one = binned.select("bin_id", "line", F.col("seq").alias("a"), "next", *(F.col(c).alias(f"a{c}") for c in ("lon1", "lat1", "lon2", "lat2")))
    other = binned.select("bin_id", "line", F.col("seq").alias("b"), *(F.col(c).alias(f"b{c}") for c in ("lon1", "lat1", "lon2", "lat2")))
    crossing = geo.segments_cross("alon1", "alat1", "alon2", "alat2", "blon1", "blat1", "blon2", "blat2")
    boxes = [tuple(f"{f}({s}{c}1, {s}{c}2)" for f, c in (("least", "lon"), ("least", "lat"), ("greatest", "lon"), ("greatest", "lat"))) for s in "ab"]
    return one.join(other, ["bin_id", "line"]).where("b > next").where(crossing).where(geo.boxes_meet(*boxes)).select("line", "a", "b").distinct()


def in_polygon(lon: str, lat: str, ring: list[tuple[float, float]]) -> str:
    """Crossing parity of a closed ring, as an expression."""
    terms = []
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if ay != by:
            terms.append(f"CAST(({lat} < {ay}e0) <> ({lat} < {by}e0) AND {lon} < {ax}e0 + ({lat} - {ay}e0) * {(bx - ax) / (by - ay)!r}e0 AS INT)")
    return f"(({' + '.join(terms)}) % 2 = 1)"
