"""Filters, joins, aggregations, windows, rankings and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pathloom import fixtures as fx
from pathloom.fixtures import ASKED, DEPARTURES, POINTS, TRACES, WITH
from pathloom.functions import geo
from pathloom.operators import filters as fl
from pathloom.operators import spatial, transit
from pathloom.queries.portable import portable
from pathloom.registry import query

# --- filters ------------------------------------------------------------------------------------------------

portable("f2_access_mask", fx.edges, "edges", {"edge_id": "edge_id", "access": "access"}, where=fl.accessible(fl.AUTO))
portable("f1_attribute_projection", fx.edges, "edges", {"edge_id": "edge_id", "length": "length", "speed": "speed"})
portable("f7_dimensions", fx.edges, "edges", {"edge_id": "edge_id", "passes": fl.fits({"height": 3.5, "weight": 12.0}, {"height": "(CASE WHEN edge_id % 4 = 0 THEN edge_id % 500 ELSE 0 END)", "weight": "(CASE WHEN edge_id % 3 = 0 THEN edge_id % 3000 ELSE 0 END)"})})
portable("f10_search_filter", fx.edges, "edges", {"edge_id": "edge_id"}, where="road_class >= 2 AND road_class <= 6 AND NOT toll AND use <> 12")
portable("f12_heading_filter", fx.edges, "edges", {"edge_id": "edge_id", "heading": "heading"}, where=fl.heading_near("heading", "15e0"))
portable("f13_levels", fx.edges, "edges", {"edge_id": "edge_id", "on_level": "edge_id % 5 BETWEEN 1 AND 3"})
portable("f18_zoom_by_class", fx.edges, "edges", {"edge_id": "edge_id", "zoom": "(CASE road_class WHEN 0 THEN 6 WHEN 1 THEN 7 WHEN 2 THEN 8 WHEN 3 THEN 9 WHEN 4 THEN 10 ELSE 12 END)"}, where="(CASE road_class WHEN 0 THEN 6 WHEN 1 THEN 7 WHEN 2 THEN 8 WHEN 3 THEN 9 WHEN 4 THEN 10 ELSE 12 END) <= 9")
portable("f20_service_limits", fx.edges, "edges", {"edge_id": "edge_id", "error": "(CASE WHEN length > 1100e0 THEN 154 WHEN speed > 90 THEN 112 ELSE 0 END)"})


def _turn_pairs(spark, sf_dir):
    e = fx.edges(spark, sf_dir)
    return e.alias("p").join(e.alias("e"), F.col("p.dst") == F.col("e.src"))


_PAIRS = "edges p JOIN edges e ON p.dst = e.src"


@query("f3_f4_f5_f8_allowed_turns", f"{WITH} SELECT p.edge_id AS from_edge, e.edge_id AS to_edge, {fl.entering('toll')} AS toll_entered FROM {_PAIRS} WHERE {fl.allowed(fl.AUTO)} AND (p.edge_id * 31 + e.edge_id) % 17 <> 0")
def allowed_turns(spark, sf_dir):
    pairs = _turn_pairs(spark, sf_dir).where(fl.allowed(fl.AUTO)).where("(p.edge_id * 31 + e.edge_id) % 17 <> 0")
    return pairs.selectExpr("p.edge_id AS from_edge", "e.edge_id AS to_edge", f"{fl.entering('toll')} AS toll_entered")


_RULES = "rules AS (SELECT o_orderkey % (SELECT max(edge_id) + 1 FROM edges) AS edge_id, CASE WHEN o_orderkey % 2 = 0 THEN 'allowed' ELSE 'denied' END AS kind, o_orderkey * 7 % 1440 AS b, o_orderkey * 13 % 1440 AS e FROM orders)"


@query("f6_timed_restrictions", f"{WITH}, {_RULES} SELECT x.edge_id, bool_and({fl.in_time('r.kind', 'r.b', 'r.e', '600')}) AS open_at_ten, count(*) AS rules FROM edges x JOIN rules r ON r.edge_id = x.edge_id GROUP BY x.edge_id")
def timed_restrictions(spark, sf_dir):
    e = fx.edges(spark, sf_dir).select("edge_id")
    most = e.agg(F.max("edge_id")).first()[0] + 1
    rules = fx.table(spark, sf_dir, "orders").selectExpr(f"o_orderkey % {most} AS edge_id", "CASE WHEN o_orderkey % 2 = 0 THEN 'allowed' ELSE 'denied' END AS kind", "o_orderkey * 7 % 1440 AS b", "o_orderkey * 13 % 1440 AS e")
    return e.join(rules, "edge_id").groupBy("edge_id").agg(F.bool_and(F.expr(fl.in_time("kind", "b", "e", "600"))).alias("open_at_ten"), F.count("*").alias("rules"))


_LIVE = "live AS (SELECT edge_id, speed FROM (SELECT event_id % (SELECT count(*) FROM edges) AS rnk, CASE WHEN event_type = 'error' THEN 0e0 ELSE least(value / 2e0, 252e0) END AS speed, row_number() OVER (PARTITION BY event_id % (SELECT count(*) FROM edges) ORDER BY ts DESC, event_id DESC) AS k FROM events) l JOIN (SELECT edge_id, row_number() OVER (ORDER BY edge_id) - 1 AS rnk FROM edges) d ON d.rnk = l.rnk WHERE k = 1)"


@query("f14_s9_closures", f"{WITH}, {_LIVE} SELECT e.edge_id, coalesce(l.speed = 0e0, FALSE) AS closed, round(coalesce(l.speed, CAST(e.speed AS DOUBLE)), 6) AS kph FROM edges e LEFT JOIN live l ON l.edge_id = e.edge_id")
def closures(spark, sf_dir):
    from pathloom.sources.traffic import latest_speeds

    e = fx.edges(spark, sf_dir).select("edge_id", "speed")
    live = latest_speeds(fx.table(spark, sf_dir, "events"), e.select("edge_id"))
    return e.join(live.withColumnRenamed("speed", "live"), "edge_id", "left").selectExpr("edge_id", "coalesce(live = 0e0, FALSE) AS closed", "round(coalesce(live, CAST(speed AS DOUBLE)), 6) AS kph")


_RING = [(4.05, 52.05), (4.2, 52.06), (4.22, 52.2), (4.1, 52.12), (4.03, 52.18)]
portable("g09_point_in_polygon", fx.nodes, "nodes", {"node_id": "node_id", "inside": spatial.in_polygon("lon", "lat", _RING)})


@query("f15_j10_exclude_polygons", f"{WITH} SELECT edge_id FROM edges WHERE NOT ({spatial.in_polygon('lon1', 'lat1', _RING)} OR {spatial.in_polygon('lon2', 'lat2', _RING)})")
def exclude_polygons(spark, sf_dir):
    e = fx.edges(spark, sf_dir)
    # the ring's box first, the exact test on what it holds
    box = "lon1 BETWEEN 4.02e0 AND 4.23e0 OR lon2 BETWEEN 4.02e0 AND 4.23e0"
    hit = e.where(box).where(f"{spatial.in_polygon('lon1', 'lat1', _RING)} OR {spatial.in_polygon('lon2', 'lat2', _RING)}").select("edge_id")
    return e.join(hit, "edge_id", "left_anti").select("edge_id")


@query("f11_side_of_street", f"{WITH}, {POINTS} SELECT p.pt_id, e.edge_id, {fl.side_of('p.lon', 'p.lat', 'e.lon1', 'e.lat1', 'e.lon2', 'e.lat2')} AS side FROM points p JOIN edges e ON e.src = p.pt_id")
def side_of_street(spark, sf_dir):
    p = fx.points(spark, sf_dir)
    return p.join(fx.edges(spark, sf_dir), F.col("pt_id") == F.col("src")).selectExpr("pt_id", "edge_id", f"{fl.side_of('lon', 'lat', 'lon1', 'lat1', 'lon2', 'lat2')} AS side")


portable("f17_mode_filter", fx.edges, "edges", {"edge_id": "edge_id", "new_id": "edge_id * 2 + 1"}, where=fl.accessible(fl.AUTO | fl.BUS))

# --- joins --------------------------------------------------------------------------------------------------


@query("j1_j2_way_nodes", f"{WITH}, wn AS (SELECT way_id, src AS node_id FROM edges UNION ALL SELECT way_id, dst FROM edges) SELECT w.node_id, count(*) AS uses, count(DISTINCT w.way_id) AS ways FROM wn w JOIN nodes n ON n.node_id = w.node_id GROUP BY w.node_id")
def way_nodes(spark, sf_dir):
    e = fx.edges(spark, sf_dir)
    wn = e.select("way_id", F.explode(F.array("src", "dst")).alias("node_id"))
    return wn.join(fx.nodes(spark, sf_dir).select("node_id"), "node_id").groupBy("node_id").agg(F.count("*").alias("uses"), F.count_distinct("way_id").alias("ways"))


@query("j3_adjacency_expansion", f"{WITH} SELECT p.edge_id, count(*) AS successors, sum(e.length) AS metres FROM {_PAIRS} GROUP BY p.edge_id")
def adjacency(spark, sf_dir):
    e = fx.edges(spark, sf_dir)
    # the sums of a node's out-edges first: one row a node meets each in-edge
    out = e.groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("successors"), F.sum("length").alias("metres"))
    return e.select("edge_id", "dst").join(out, "dst").select("edge_id", "successors", "metres")


@query("j4_j5_opposing_edge", f"{WITH} SELECT a.edge_id, b.edge_id AS opp_edge_id, a.length = b.length AS same_length FROM edges a JOIN edges b ON b.src = a.dst AND b.dst = a.src")
def opposing(spark, sf_dir):
    a, b = fx.edges(spark, sf_dir).alias("a"), fx.edges(spark, sf_dir).alias("b")
    return a.join(b, (F.col("b.src") == F.col("a.dst")) & (F.col("b.dst") == F.col("a.src"))).selectExpr("a.edge_id", "b.edge_id AS opp_edge_id", "a.length = b.length AS same_length")


_HITS = f"hits AS (SELECT p.pt_id, e.edge_id, p.lon, p.lat, e.lon1, e.lat1, e.lon2, e.lat2, {geo.project_share('p.lon', 'p.lat', 'e.lon1', 'e.lat1', 'e.lon2', 'e.lat2')} AS share FROM points p, edges e), near AS (SELECT pt_id, edge_id, share, {geo.haversine('lon', 'lat', '(lon1 + share * (lon2 - lon1))', '(lat1 + share * (lat2 - lat1))')} AS metres FROM hits)"


@query("j7_w10_o3_nearest_edges", f"{WITH}, {POINTS}, {_HITS} SELECT pt_id, edge_id, round(metres, 3) AS metres, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY pt_id ORDER BY round(metres, 3), edge_id) AS INT) AS rank FROM near WHERE metres <= 35000e0) WHERE rank <= 3")
def nearest_edges(spark, sf_dir):
    found = spatial.nearest_edges(fx.points(spark, sf_dir), fx.edges(spark, sf_dir), 3)
    return found.selectExpr("pt_id", "edge_id", "round(metres, 3) AS metres", "rank")


@query("j8_o7_h2_range_query", f"{WITH}, {POINTS}, {_HITS} SELECT pt_id, edge_id, round(share, 6) AS share, round(metres, 3) AS metres FROM near WHERE metres <= 600e0")
def range_query(spark, sf_dir):
    return spatial.edges_within(fx.points(spark, sf_dir), fx.edges(spark, sf_dir), 600.0).selectExpr("pt_id", "edge_id", "round(share, 6) AS share", "round(metres, 3) AS metres")


@query("p22_candidate_correlation", f"{WITH}, {POINTS}, {_HITS}, best AS (SELECT *, row_number() OVER (PARTITION BY pt_id ORDER BY round(metres, 3), edge_id) AS k FROM near WHERE metres <= 35000e0), top AS (SELECT b.pt_id, b.edge_id, b.share, b.metres, e.length FROM best b JOIN edges e ON e.edge_id = b.edge_id WHERE k = 1) SELECT pt_id, edge_id, round(share, 6) AS percent_along, share * length <= 5e0 OR (1e0 - share) * length <= 5e0 AS at_node FROM top UNION ALL SELECT pt_id, edge_id + 1, round(1e0 - share, 6), share * length <= 5e0 OR (1e0 - share) * length <= 5e0 FROM top")
def candidate_correlation(spark, sf_dir):
    e = fx.edges(spark, sf_dir)
    # of a road's two edges, equally far, the one with the smaller id comes first; the other one is its opposite
    top = spatial.nearest_edges(fx.points(spark, sf_dir), e, 1).join(e.select("edge_id", "length"), "edge_id")
    at = "share * length <= 5e0 OR (1e0 - share) * length <= 5e0"
    return top.selectExpr("pt_id", f"explode(array(struct(edge_id, round(share, 6) AS percent_along, {at} AS at_node), struct(edge_id + 1 AS edge_id, round(1e0 - share, 6) AS percent_along, {at} AS at_node))) AS c").select("pt_id", "c.*")


@query("j9_box_to_edges", f"{WITH}, {POINTS} SELECT p.pt_id, count(*) AS edges FROM points p JOIN edges e ON {geo.boxes_meet(('p.lon - 0.02e0', 'p.lat - 0.02e0', 'p.lon + 0.02e0', 'p.lat + 0.02e0'), ('least(e.lon1, e.lon2)', 'least(e.lat1, e.lat2)', 'greatest(e.lon1, e.lon2)', 'greatest(e.lat1, e.lat2)'))} GROUP BY p.pt_id")
def box_to_edges(spark, sf_dir):
    e, p = fx.edges(spark, sf_dir), fx.points(spark, sf_dir)
    near = spatial.point_bins(p, 0.02, ["pt_id", "lon", "lat"]).join(spatial.edge_bins(e), "bin_id").select("pt_id", "lon", "lat", "edge_id").distinct()
    met = near.join(e.select("edge_id", "lon1", "lat1", "lon2", "lat2"), "edge_id").where(geo.boxes_meet(("lon - 0.02e0", "lat - 0.02e0", "lon + 0.02e0", "lat + 0.02e0"), ("least(lon1, lon2)", "least(lat1, lat2)", "greatest(lon1, lon2)", "greatest(lat1, lat2)")))
    return met.groupBy("pt_id").agg(F.count("*").alias("edges"))


@query("j11_e14_node_admin", f"{WITH}, areas AS (SELECT n_nationkey AS area, 4e0 + 0.07e0 * (n_nationkey % 5) AS x1, 52e0 + 0.07e0 * floor(n_nationkey / 5e0) AS y1 FROM nation) SELECT n.node_id, min(a.area) AS area FROM nodes n JOIN areas a ON n.lon >= a.x1 AND n.lon <= a.x1 + 0.1e0 AND n.lat >= a.y1 AND n.lat <= a.y1 + 0.1e0 GROUP BY n.node_id")
def node_admin(spark, sf_dir):
    # areas (a fixed dimension) enter by the bins of their boxes
    areas = fx.table(spark, sf_dir, "nation").selectExpr("n_nationkey AS area", "4e0 + 0.07e0 * (n_nationkey % 5) AS x1", "52e0 + 0.07e0 * floor(n_nationkey / 5e0) AS y1")
    cells = areas.selectExpr("*", f"explode(sequence({spatial.bin_col('x1')}, {spatial.bin_col('(x1 + 0.1e0)')})) AS c").selectExpr("*", f"explode(sequence({spatial.bin_row('y1')}, {spatial.bin_row('(y1 + 0.1e0)')})) AS r")
    n = fx.nodes(spark, sf_dir).selectExpr("node_id", "lon", "lat", f"{spatial.bin_col('lon')} AS c", f"{spatial.bin_row('lat')} AS r")
    return n.join(cells, ["c", "r"]).where("lon >= x1 AND lon <= x1 + 0.1e0 AND lat >= y1 AND lat <= y1 + 0.1e0").groupBy("node_id").agg(F.min("area").alias("area"))


@query("j12_j13_v5_speed_lookup", f"{WITH}, cfg AS (SELECT n_nationkey AS admin_id, n_nationkey % 8 AS road_class, 20 + n_nationkey AS kph FROM nation WHERE n_nationkey % 2 = 0) SELECT e.edge_id, CAST(coalesce(c.kph, d.kph, e.speed) AS BIGINT) AS kph FROM edges e LEFT JOIN cfg c ON c.admin_id = e.admin_id AND c.road_class = e.road_class LEFT JOIN (SELECT r_regionkey AS road_class, 50 + r_regionkey AS kph FROM region) d ON d.road_class = e.road_class")
def speed_lookup(spark, sf_dir):
    exact = fx.table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").selectExpr("n_nationkey AS admin_id", "CAST(n_nationkey % 8 AS BIGINT) AS road_class", "20 + n_nationkey AS exact")
    any_ = fx.table(spark, sf_dir, "region").selectExpr("CAST(r_regionkey AS BIGINT) AS road_class", "50 + r_regionkey AS general")
    return fx.edges(spark, sf_dir).join(exact, ["admin_id", "road_class"], "left").join(any_, "road_class", "left").selectExpr("edge_id", "CAST(coalesce(exact, general, speed) AS BIGINT) AS kph")


@query("j14_j15_j16_side_tables", f"{WITH}, {_RULES} SELECT e.edge_id, count(r.edge_id) AS rules, CAST(count(r.edge_id) > 0 AS INT) AS signed FROM edges e LEFT JOIN rules r ON r.edge_id = e.edge_id GROUP BY e.edge_id")
def side_tables(spark, sf_dir):
    e = fx.edges(spark, sf_dir).select("edge_id")
    most = e.agg(F.max("edge_id")).first()[0] + 1
    rules = fx.table(spark, sf_dir, "orders").selectExpr(f"o_orderkey % {most} AS edge_id").groupBy("edge_id").agg(F.count("*").alias("n"))
    return e.join(rules, "edge_id", "left").selectExpr("edge_id", "coalesce(n, 0L) AS rules", "CAST(n IS NOT NULL AS INT) AS signed")


@query("j18_next_departure", f"WITH {DEPARTURES}, {ASKED.format(dow=0)} SELECT req_id, line_id, t_secs, dep_secs, trip_id FROM (SELECT a.*, d.dep_secs, d.trip_id, row_number() OVER (PARTITION BY a.req_id ORDER BY d.dep_secs, d.trip_id, d.line_no) AS k FROM asked a JOIN departures d ON d.line_id = a.line_id AND d.dep_secs >= a.t_secs AND (d.dow_mask // CAST(pow(2, a.dow) AS BIGINT)) % 2 = 1) WHERE k = 1")
def next_departure(spark, sf_dir):
    return transit.next_departure(fx.asked(spark, sf_dir), fx.departures(spark, sf_dir))


@query("j19_departure_by_trip", f"WITH {DEPARTURES} SELECT trip_id, count(*) AS stops, min(dep_secs) AS first, max(dep_secs) AS last FROM departures GROUP BY trip_id")
def by_trip(spark, sf_dir):
    return fx.departures(spark, sf_dir).groupBy("trip_id").agg(F.count("*").alias("stops"), F.min("dep_secs").alias("first"), F.max("dep_secs").alias("last"))


@query("j20_t11_w12_service_days", "SELECT o_orderkey, CAST(sum(CASE WHEN (o_orderkey % 128 // CAST(pow(2, (o_custkey + d) % 7) AS BIGINT)) % 2 = 1 AND d >= o_orderkey % 20 AND d <= 59 - o_custkey % 20 THEN CAST(pow(2, d) AS BIGINT) ELSE 0 END) AS BIGINT) AS days FROM orders, (SELECT unnest(generate_series(0, 59)) AS d) GROUP BY o_orderkey")
def service_days(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderkey % 128 AS week", "o_custkey % 7 AS first_dow", "CAST(o_orderkey % 20 AS INT) AS begin", "CAST(59 - o_custkey % 20 AS INT) AS end")
    return o.select("o_orderkey", transit.service_bits("week", "first_dow", "begin", "end").alias("days"))


@query("j21_j22_stop_to_road", f"{WITH}, {POINTS}, {_HITS} SELECT pt_id, min(CASE WHEN (e.access & 1) <> 0 THEN n.metres END)::DECIMAL(18,3)::DOUBLE AS drive, min(CASE WHEN (e.access & 8) <> 0 THEN n.metres END)::DECIMAL(18,3)::DOUBLE AS walk FROM near n JOIN edges e ON e.edge_id = n.edge_id WHERE n.metres <= 4000e0 GROUP BY pt_id")
def stop_to_road(spark, sf_dir):
    e = fx.edges(spark, sf_dir)
    near = spatial.edges_within(fx.points(spark, sf_dir), e, 4000.0).join(e.select("edge_id", "access"), "edge_id")
    least = [F.round(F.min(F.when(F.expr(fl.accessible(m)), F.col("metres"))), 3).alias(n) for m, n in ((fl.AUTO, "drive"), (fl.PEDESTRIAN, "walk"))]
    return near.groupBy("pt_id").agg(*least)


@query("j23_e16_landmarks", f"{WITH}, {POINTS}, {_HITS} SELECT edge_id, count(*) AS landmarks, min(pt_id) AS first FROM near WHERE metres <= 75e0 GROUP BY edge_id")
def landmarks(spark, sf_dir):
    return spatial.edges_within(fx.points(spark, sf_dir), fx.edges(spark, sf_dir), 75.0).groupBy("edge_id").agg(F.count("*").alias("landmarks"), F.min("pt_id").alias("first"))


@query("j24_s10_incidents", f"{WITH}, inc AS (SELECT event_id, event_id % (SELECT max(edge_id) + 1 FROM edges) AS edge_id, (event_id % 50) / 100e0 AS a, (event_id % 50) / 100e0 + 0.3e0 AS b FROM events WHERE event_type = 'error') SELECT e.edge_id, i.event_id, round(least(i.b, 0.9e0) - greatest(i.a, 0.2e0), 6) AS overlap FROM edges e JOIN inc i ON i.edge_id = e.edge_id AND i.a < 0.9e0 AND i.b > 0.2e0")
def incidents(spark, sf_dir):
    most = fx.edges(spark, sf_dir).agg(F.max("edge_id")).first()[0] + 1
    inc = fx.table(spark, sf_dir, "events").where("event_type = 'error'").selectExpr("event_id", f"event_id % {most} AS edge_id", "(event_id % 50) / 100e0 AS a", "(event_id % 50) / 100e0 + 0.3e0 AS b")
    return fx.edges(spark, sf_dir).select("edge_id").join(inc, "edge_id").where("a < 0.9e0 AND b > 0.2e0").selectExpr("edge_id", "event_id", "round(least(b, 0.9e0) - greatest(a, 0.2e0), 6) AS overlap")


@query("j29_u2_u4_avoid_sets", f"{WITH} SELECT edge_id FROM edges WHERE edge_id NOT IN (SELECT edge_id FROM edges WHERE toll UNION SELECT edge_id FROM edges WHERE rw1 = 2)")
def avoid_sets(spark, sf_dir):
    e = fx.edges(spark, sf_dir)
    avoided = e.where("toll").select("edge_id").union(e.where("rw1 = 2").select("edge_id")).distinct()
    return e.join(avoided, "edge_id", "left_anti").select("edge_id")


@query("u1_u3_u5_set_operations", f"{WITH} SELECT node_id, 'both' AS kind FROM (SELECT src AS node_id FROM edges WHERE toll INTERSECT SELECT dst FROM edges WHERE road_class = 2) UNION ALL SELECT node_id, 'only' FROM (SELECT src AS node_id FROM edges WHERE toll EXCEPT SELECT dst FROM edges WHERE road_class = 2)")
def set_operations(spark, sf_dir):
    e = fx.edges(spark, sf_dir)
    a, b = e.where("toll").select(F.col("src").alias("node_id")), e.where("road_class = 2").select(F.col("dst").alias("node_id"))
    return a.intersect(b).withColumn("kind", F.lit("both")).unionByName(a.subtract(b).withColumn("kind", F.lit("only")))


@query("j31_time_overlap", f"WITH {DEPARTURES} SELECT line_id, count(*) AS waits FROM departures WHERE dep_secs < 30000 AND dep_secs + elapsed > 20000 GROUP BY line_id")
def time_overlap(spark, sf_dir):
    return fx.departures(spark, sf_dir).where("dep_secs < 30000 AND dep_secs + elapsed > 20000").groupBy("line_id").agg(F.count("*").alias("waits"))


@query("j28_s17_way_edges", f"{WITH} SELECT way_id, string_agg(CAST(edge_id AS VARCHAR), ',' ORDER BY edge_id) AS edges FROM edges GROUP BY way_id")
def way_edges(spark, sf_dir):
    return fx.edges(spark, sf_dir).groupBy("way_id").agg(F.sort_array(F.collect_list("edge_id")).alias("e")).selectExpr("way_id", "array_join(CAST(e AS ARRAY<STRING>), ',') AS edges")


# --- aggregations -------------------------------------------------------------------------------------------

_CELL = "CAST(floor((lat1 - 52e0) / 0.02e0) AS BIGINT)"
_CELLC = "CAST(floor((lon1 - 4e0) / 0.02e0) AS BIGINT)"


@query("a1_road_density", f"{WITH}, cell AS (SELECT {_CELL} AS r, {_CELLC} AS c, sum(length) AS metres FROM edges GROUP BY ALL) SELECT a.r, a.c, CAST(least(15, round(0.7e0 * sum(b.metres) * 0.0005e0 / (4e0 * count(*)))) AS BIGINT) AS density FROM cell a JOIN cell b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY a.r, a.c")
def road_density(spark, sf_dir):
    from pathloom.operators.etl import density

    cells = fx.edges(spark, sf_dir).selectExpr(f"{_CELL} AS r", f"{_CELLC} AS c", "length")
    return density(cells, cell_area=4.0)


@query("a2_k16_statistics", f"{WITH} SELECT admin_id, road_class, round(sum(length / 2e0), 1) AS metres, count(*) AS edges, count(*) FILTER (WHERE toll) AS tolls FROM edges GROUP BY GROUPING SETS ((admin_id, road_class), (admin_id), (road_class))")
def statistics(spark, sf_dir):
    admin, kind = F.col("admin_id"), F.col("road_class")
    return fx.edges(spark, sf_dir).groupingSets([[admin, kind], [admin], [kind]], admin, kind).agg(F.round(F.sum(F.col("length") / 2.0), 1).alias("metres"), F.count("*").alias("edges"), F.count_if(F.col("toll")).alias("tolls"))


@query("a8_a12_summary", f"{WITH} SELECT way_id, round(sum(length), 1) AS metres, round(sum(length * 3.6e0 / speed), 3) AS secs, bool_or(toll) AS has_toll, min(least(lon1, lon2)) AS x1, max(greatest(lat1, lat2)) AS y2 FROM edges GROUP BY way_id")
def summary(spark, sf_dir):
    return fx.edges(spark, sf_dir).groupBy("way_id").agg(F.round(F.sum("length"), 1).alias("metres"), F.round(F.sum(F.expr("length * 3.6e0 / speed")), 3).alias("secs"), F.bool_or("toll").alias("has_toll"), F.min(F.least("lon1", "lon2")).alias("x1"), F.max(F.greatest("lat1", "lat2")).alias("y2"))


_GRADE = "greatest(-10e0, least(15e0, 100e0 * (b.elevation - a.elevation) / e.length))"
_WEIGHT = "(CASE WHEN {g} > 0e0 THEN 1e0 + {g} / 7e0 ELSE 1e0 + {g} / 17e0 END)"


@query("a9_weighted_grade", f"{WITH}, g AS (SELECT e.way_id, {_GRADE} AS g, (a.elevation + b.elevation) / 2e0 AS h FROM edges e JOIN nodes a ON a.node_id = e.src JOIN nodes b ON b.node_id = e.dst) SELECT way_id, round(sum(g * {_WEIGHT.format(g='g')}) / sum({_WEIGHT.format(g='g')}), 6) AS grade, round(max(g), 6) AS up, round(min(g), 6) AS down, round(sum(h), 6) AS total, count(*) AS samples FROM g GROUP BY way_id HAVING abs(sum({_WEIGHT.format(g='g')})) > 1e-9")
def weighted_grade(spark, sf_dir):
    n = fx.nodes(spark, sf_dir)
    e = fx.edges(spark, sf_dir).join(n.select(F.col("node_id").alias("src"), F.col("elevation").alias("ha")), "src").join(n.select(F.col("node_id").alias("dst"), F.col("elevation").alias("hb")), "dst")
    g = e.selectExpr("way_id", "greatest(-10e0, least(15e0, 100e0 * (hb - ha) / length)) AS g", "(ha + hb) / 2e0 AS h").selectExpr("*", f"{_WEIGHT.format(g='g')} AS w")
    out = g.groupBy("way_id").agg(F.sum(F.col("g") * F.col("w")).alias("gw"), F.sum("w").alias("w"), F.max("g").alias("up"), F.min("g").alias("down"), F.sum("h").alias("total"), F.count("*").alias("samples"))
    return out.where("abs(w) > 1e-9").selectExpr("way_id", "round(gw / w, 6) AS grade", "round(up, 6) AS up", "round(down, 6) AS down", "round(total, 6) AS total", "samples")


@query("a14_a15_h11_local_edges", f"{WITH} SELECT src AS node_id, count(*) AS edges, count(*) FILTER (WHERE (access & 1) <> 0) AS drivable, count(DISTINCT street) AS streets FROM edges GROUP BY src")
def local_edges(spark, sf_dir):
    return fx.edges(spark, sf_dir).groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("edges"), F.count_if(F.expr(fl.accessible(fl.AUTO))).alias("drivable"), F.count_distinct("street").alias("streets"))


@query("a11_edge_density", f"{WITH} SELECT e.edge_id, (a.admin_id % 16 + b.admin_id % 16) / 2e0 AS density FROM edges e JOIN nodes a ON a.node_id = e.src JOIN nodes b ON b.node_id = e.dst")
def edge_density(spark, sf_dir):
    n = fx.nodes(spark, sf_dir)
    return fx.edges(spark, sf_dir).select("edge_id", "src", "dst").join(n.selectExpr("node_id AS src", "admin_id AS a"), "src").join(n.selectExpr("node_id AS dst", "admin_id AS b"), "dst").selectExpr("edge_id", "(a % 16 + b % 16) / 2e0 AS density")


@query("a18_o8_distinct_tiles", f"{WITH} SELECT DISTINCT CAST(floor((lat + 90e0) / 0.25e0) AS BIGINT) * 1440 + CAST(floor((lon + 180e0) / 0.25e0) AS BIGINT) AS tile FROM nodes")
def distinct_tiles(spark, sf_dir):
    return fx.nodes(spark, sf_dir).selectExpr("CAST(floor((lat + 90e0) / 0.25e0) AS BIGINT) * 1440 + CAST(floor((lon + 180e0) / 0.25e0) AS BIGINT) AS tile").distinct().sortWithinPartitions("tile")


@query("a3_a20_conditional_counts", f"{WITH} SELECT road_class, count(*) FILTER (WHERE toll) AS tolls, count(*) FILTER (WHERE surface = 7) AS impassable, count(*) FILTER (WHERE length < 700e0) AS short FROM edges GROUP BY road_class")
def conditional_counts(spark, sf_dir):
    return fx.edges(spark, sf_dir).groupBy("road_class").agg(F.count_if("toll").alias("tolls"), F.count_if(F.col("surface") == 7).alias("impassable"), F.count_if(F.col("length") < 700).alias("short"))


@query("a19_order_free_digest", f"{WITH} SELECT road_class, bit_xor((edge_id * 1000003 + src * 7919 + dst) % 2147483647) AS digest FROM edges GROUP BY road_class")
def digest(spark, sf_dir):
    return fx.edges(spark, sf_dir).groupBy("road_class").agg(F.bit_xor(F.expr("(edge_id * 1000003 + src * 7919 + dst) % 2147483647")).alias("digest"))


@query("a10_curvature", f"{WITH}, s AS (SELECT rw, lon, lat, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2, lead(lon, 2) OVER w AS lon3, lead(lat, 2) OVER w AS lat3 FROM nodes WINDOW w AS (PARTITION BY rw ORDER BY col)) SELECT rw, CAST(round(15e0 * (1e0 - avg(least(1000e0, {geo.circumradius(geo.haversine('lon', 'lat', 'lon2', 'lat2'), geo.haversine('lon2', 'lat2', 'lon3', 'lat3'), geo.haversine('lon', 'lat', 'lon3', 'lat3'))})) / 1000e0)) AS BIGINT) AS curvature FROM s WHERE lon3 IS NOT NULL GROUP BY rw")
def curvature(spark, sf_dir):
    w = Window.partitionBy("rw").orderBy("col")
    s = fx.nodes(spark, sf_dir).select("rw", "lon", "lat", *(F.lead(c, k).over(w).alias(f"{c}{k + 1}") for k in (1, 2) for c in ("lon", "lat"))).where("lon3 IS NOT NULL")
    radius = geo.circumradius(geo.haversine("lon", "lat", "lon2", "lat2"), geo.haversine("lon2", "lat2", "lon3", "lat3"), geo.haversine("lon", "lat", "lon3", "lat3"))
    return s.groupBy("rw").agg(F.expr(f"CAST(round(15e0 * (1e0 - avg(least(1000e0, {radius})) / 1000e0)) AS BIGINT)").alias("curvature"))


# --- windows ------------------------------------------------------------------------------------------------


@query("w1_w2_k8_cumulative", f"{WITH}, {TRACES}, s AS (SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM traces WINDOW w AS (PARTITION BY trace_id ORDER BY seq)) SELECT trace_id, seq, round(sum(coalesce({geo.haversine('plon', 'plat', 'lon', 'lat')}, 0e0)) OVER (PARTITION BY trace_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 2) AS range FROM s")
def cumulative(spark, sf_dir):
    w = Window.partitionBy("trace_id").orderBy("seq")
    s = fx.traces(spark, sf_dir).withColumns({"plon": F.lag("lon").over(w), "plat": F.lag("lat").over(w)})
    step = F.coalesce(F.expr(geo.haversine("plon", "plat", "lon", "lat")), F.lit(0.0))
    return s.select("trace_id", "seq", F.round(F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("range"))


@query("w3_w4_heading_change", f"{WITH}, {TRACES}, h AS (SELECT trace_id, seq, {geo.heading('lon', 'lat', 'lead(lon) OVER w', 'lead(lat) OVER w')} AS h FROM traces WINDOW w AS (PARTITION BY trace_id ORDER BY seq)) SELECT trace_id, seq, round(h, 4) AS h, CAST(floor(h - lag(h) OVER (PARTITION BY trace_id ORDER BY seq) + 720e0) AS BIGINT) % 360 AS turn FROM h")
def heading_change(spark, sf_dir):
    w = Window.partitionBy("trace_id").orderBy("seq")
    h = fx.traces(spark, sf_dir).withColumns({"lon2": F.lead("lon").over(w), "lat2": F.lead("lat").over(w)}).selectExpr("trace_id", "seq", f"{geo.heading('lon', 'lat', 'lon2', 'lat2')} AS h")
    return h.withColumn("turn", F.expr("CAST(floor(h - lag(h) OVER (PARTITION BY trace_id ORDER BY seq) + 720e0) AS BIGINT) % 360")).selectExpr("trace_id", "seq", "round(h, 4) AS h", "turn")


@query("w6_w7_a17_islands", f"WITH o AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS change FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT *, sum(change) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM o) SELECT user_id, CAST(island AS BIGINT) AS island, min(event_type) AS kind, count(*) AS n, round(sum(value), 4) AS total FROM i GROUP BY user_id, island")
def islands(spark, sf_dir):
    from pathloom.operators.guidance import runs

    return runs(fx.table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").groupBy("user_id", "island").agg(F.min("event_type").alias("kind"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("w8_m9_breakage", f"{WITH}, {TRACES}, s AS (SELECT trace_id, seq, CASE WHEN {geo.haversine('lag(lon) OVER w', 'lag(lat) OVER w', 'lon', 'lat')} > 2000e0 THEN 1 ELSE 0 END AS b FROM traces WINDOW w AS (PARTITION BY trace_id ORDER BY seq)) SELECT trace_id, seq, CAST(sum(b) OVER (PARTITION BY trace_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS part FROM s")
def breakage(spark, sf_dir):
    from pathloom.operators.matching import split_traces

    return split_traces(fx.traces(spark, sf_dir), 2000.0).select("trace_id", "seq", "part")


@query("w9_shape_slices", "WITH c AS (SELECT l_orderkey, 0e0 AS pos FROM lineitem UNION SELECT l_orderkey, 1e0 FROM lineitem UNION SELECT l_orderkey, l_discount * 5e0 FROM lineitem UNION SELECT l_orderkey, l_tax * 5e0 FROM lineitem), s AS (SELECT l_orderkey, pos, lead(pos) OVER (PARTITION BY l_orderkey ORDER BY pos) AS until FROM c) SELECT l_orderkey, round(pos, 6) AS pos, round(until, 6) AS until FROM s WHERE until IS NOT NULL")
def shape_slices(spark, sf_dir):
    cuts = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", F.explode(F.array(F.lit(0.0), F.lit(1.0), F.col("l_discount") * 5, F.col("l_tax") * 5)).alias("pos")).distinct()
    until = F.lead("pos").over(Window.partitionBy("l_orderkey").orderBy("pos"))
    return cuts.withColumn("until", until).where("until IS NOT NULL").select("l_orderkey", F.round("pos", 6).alias("pos"), F.round("until", 6).alias("until"))


@query("w11_level_changes", f"{WITH}, {TRACES} SELECT trace_id, seq, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY trace_id ORDER BY seq) AS before FROM traces) WHERE before IS NOT NULL AND before <> event_type")
def level_changes(spark, sf_dir):
    before = F.lag("event_type").over(Window.partitionBy("trace_id").orderBy("seq"))
    return fx.traces(spark, sf_dir).withColumn("before", before).where("before IS NOT NULL AND before <> event_type").select("trace_id", "seq", "event_type")


@query("m13_elapsed_timestamps", f"{WITH}, {TRACES} SELECT trace_id, seq, CAST(floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY trace_id ORDER BY seq))) AS BIGINT) AS elapsed FROM traces")
def elapsed(spark, sf_dir):
    at = F.expr("unix_timestamp(CAST(ts AS TIMESTAMP))")
    t = fx.traces(spark, sf_dir).withColumn("at", at)
    return t.select("trace_id", "seq", (F.col("at") - F.lag("at").over(Window.partitionBy("trace_id").orderBy("seq"))).alias("elapsed"))


@query("o1_o4_top_k", f"{WITH} SELECT road_class, edge_id, rank FROM (SELECT road_class, edge_id, CAST(row_number() OVER (PARTITION BY road_class ORDER BY length DESC, edge_id) AS INT) AS rank FROM edges) WHERE rank <= 5")
def top_k(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("road_class").orderBy(F.desc("length"), "edge_id"))
    return fx.edges(spark, sf_dir).select("road_class", "edge_id", rank.alias("rank")).where("rank <= 5")


@query("a16_a21_longest_names", f"{WITH}, s AS (SELECT rw1, street, sum(length) AS metres FROM edges GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY rw1 ORDER BY metres DESC, street) AS k FROM s) SELECT rw1, string_agg(street, ', ' ORDER BY street) AS names FROM k WHERE k <= 3 GROUP BY rw1")
def longest_names(spark, sf_dir):
    s = fx.edges(spark, sf_dir).groupBy("rw1", "street").agg(F.sum("length").alias("metres"))
    top = s.withColumn("k", F.row_number().over(Window.partitionBy("rw1").orderBy(F.desc("metres"), "street"))).where("k <= 3")
    return top.groupBy("rw1").agg(F.array_join(F.sort_array(F.collect_list("street")), ", ").alias("names"))
