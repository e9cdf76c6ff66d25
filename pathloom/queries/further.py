"""Text forms, tables from text, tiles, map matching settings, guidance passes and the rest of the inventory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pathloom import fixtures as fx
from pathloom.fixtures import POINTS, TRACES, WITH
from pathloom.functions import geo, speeds
from pathloom.operators import contours, etl, guidance, matching, paths, spatial
from pathloom.operators import filters as fl
from pathloom.plans.lineage import ensure_checkpoint_dir
from pathloom.plans.planner import MATCH_MODES, match_config
from pathloom.queries.network import _ARCS, _SEEDS, _node_arcs, _reach, _seeds
from pathloom.queries.portable import portable
from pathloom.queries.relational import _CELL, _CELLC, _HITS
from pathloom.registry import query
from pathloom.sinks import json as out
from pathloom.sinks import tiles
from pathloom.sources import lines as ln
from pathloom.sources import speeds as sp

# --- geometry -----------------------------------------------------------------------------------------------

portable("g02_planar_distance", fx.edges, "edges", {"edge_id": "edge_id", "squared": f"round({geo.planar2('lon1', 'lat1', 'lon2', 'lat2')}, 3)"})


@query("g19_self_intersections", f"{WITH}, {TRACES}, s AS (SELECT trace_id AS line, seq, lon AS x1, lat AS y1, lead(lon) OVER w AS x2, lead(lat) OVER w AS y2 FROM traces WINDOW w AS (PARTITION BY trace_id ORDER BY seq)), k AS (SELECT * FROM s WHERE x2 IS NOT NULL) SELECT a.line, a.seq AS a, b.seq AS b FROM k a JOIN k b ON b.line = a.line AND b.seq > a.seq + 1 WHERE sign((a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1)) * sign((a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1)) <= 0 AND sign((b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1)) * sign((b.x2 - b.x1) * (a.y2 - b.y1) - (b.y2 - b.y1) * (a.x2 - b.x1)) <= 0 AND greatest(a.x1, a.x2) >= least(b.x1, b.x2) AND greatest(b.x1, b.x2) >= least(a.x1, a.x2) AND greatest(a.y1, a.y2) >= least(b.y1, b.y2) AND greatest(b.y1, b.y2) >= least(a.y1, a.y2)")
def self_intersections(spark, sf_dir):
    shapes = fx.traces(spark, sf_dir).select(F.col("trace_id").alias("line"), "seq", "lon", "lat")
    return spatial.self_intersections(shapes)


_nx, _ny = geo.noisy("lon", "lat", 4.0, "node_id")
portable("g33_gps_noise", fx.nodes, "nodes", {"node_id": "node_id", "lon": f"round({_nx}, 8)", "lat": f"round({_ny}, 8)"})


@query("g38_points_near_points", f"{WITH}, {POINTS}, d AS (SELECT pt_id, node_id, {geo.haversine('p.lon', 'p.lat', 'n.lon', 'n.lat')} AS metres FROM points p, nodes n) SELECT pt_id, node_id, round(metres, 3) AS metres FROM d WHERE metres <= 900e0")
def points_near_points(spark, sf_dir):
    return spatial.points_within(fx.points(spark, sf_dir), fx.nodes(spark, sf_dir), 900.0).selectExpr("pt_id", "node_id", "round(metres, 3) AS metres")


@query(
    "v3_dct_encode",
    "WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE * 1000 AS v, unnest(generate_series(0, len(embedding) - 1)) AS i, len(embedding) AS n FROM embeddings), k AS (SELECT unnest([0, 1, 5, 30]) AS k) SELECT vec_id, k, CAST(round(sqrt(2e0 / any_value(n)) * (CASE WHEN k = 0 THEN 0.707106781e0 ELSE 1e0 END) * sum(v * cos(pi() / n * (i + 0.5e0) * k))) AS BIGINT) AS c FROM x, k GROUP BY vec_id, k",
)
def dct_encode(spark, sf_dir):
    buckets = fx.table(spark, sf_dir, "embeddings").selectExpr("vec_id", "transform(embedding, v -> CAST(v AS DOUBLE) * 1000e0) AS b", "explode(array(0, 1, 5, 30)) AS k").where("b IS NOT NULL")
    return buckets.selectExpr("vec_id", "k", f"{speeds.dct_coefficient('b', 'k')} AS c")


# --- text forms ---------------------------------------------------------------------------------------------

_ALONG = "along AS (SELECT rw1 AS trip_id, src AS seq, edge_id, 'Block ' || CAST(floor(col1 / 3e0) AS BIGINT) AS street, length, length * 3.6e0 / speed AS secs, col1, dst FROM edges WHERE kind = 0 AND edge_id % 2 = 0)"


def _along(spark, sf_dir):
    """The eastward path of every lattice row; three edges share a street."""
    e = fx.edges(spark, sf_dir).where("kind = 0 AND edge_id % 2 = 0")
    return e.selectExpr("rw1 AS trip_id", "src AS seq", "edge_id", "'Block ' || CAST(floor(col1 / 3e0) AS BIGINT) AS street", "length", "length * 3.6e0 / speed AS secs", "col1", "dst")


@query(
    "k2_k9_route_json",
    f"{WITH}, {_ALONG}, l AS (SELECT trip_id, street, min(seq) AS first, sum(length) AS m, sum(secs) AS s, string_agg(CAST(edge_id AS VARCHAR), ',' ORDER BY seq) AS edges FROM along GROUP BY trip_id, street) SELECT trip_id, '{{\"trip\":{{\"summary\":{{\"length\":' || CAST(round(sum(m)) AS BIGINT) || ',\"time\":' || CAST(round(sum(s)) AS BIGINT) || '}},\"legs\":[' || string_agg('{{\"street\":\"' || street || '\",\"length\":' || CAST(round(m) AS BIGINT) || ',\"time\":' || CAST(round(s) AS BIGINT) || ',\"edges\":[' || edges || ']}}', ',' ORDER BY first) || ']}}}}}}}}' AS body FROM l GROUP BY trip_id".replace("{{", "{").replace("}}", "}"),
)
def route_json(spark, sf_dir):
    return out.route_json(_along(spark, sf_dir))


@query(
    "k8_height_json",
    f"{WITH}, {TRACES}, s AS (SELECT trace_id, seq, value, coalesce({geo.haversine('lag(lon) OVER w', 'lag(lat) OVER w', 'lon', 'lat')}, 0e0) AS step FROM traces WINDOW w AS (PARTITION BY trace_id ORDER BY seq)), r AS (SELECT trace_id AS line, seq, value, sum(step) OVER (PARTITION BY trace_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS range FROM s) SELECT line, '{{\"range_height\":[' || string_agg('[' || CAST(round(range) AS BIGINT) || ',' || CAST(round(value) AS BIGINT) || ']', ',' ORDER BY seq) || ']}}' AS body FROM r GROUP BY line".replace("{{", "{").replace("}}", "}"),
)
def height_json(spark, sf_dir):
    w = Window.partitionBy("trace_id").orderBy("seq")
    t = fx.traces(spark, sf_dir).withColumns({"plon": F.lag("lon").over(w), "plat": F.lag("lat").over(w)})
    step = F.coalesce(F.expr(geo.haversine("plon", "plat", "lon", "lat")), F.lit(0.0))
    return out.height_json(t.select(F.col("trace_id").alias("line"), "seq", F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("range"), F.col("value").alias("height")))


_LINES = ", ".join(f"({kind}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for kind, own in contours.SEGMENTS.items() for a, b in own)


@query(
    "k6_p18_contour_geojson",
    f"{WITH}, k AS (SELECT rw - i AS r, col - j AS c, sum(CAST(pow(2, 2 * i + j) AS BIGINT)) AS kind FROM nodes, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j) WHERE elevation <= 400e0 GROUP BY ALL), s AS (SELECT 2 * r + ya AS y1, 2 * c + xa AS x1, 2 * r + yb AS y2, 2 * c + xb AS x2 FROM k JOIN (VALUES {_LINES}) t(kind, ya, xa, yb, xb) ON t.kind = k.kind) SELECT 0::BIGINT AS source, '{{{{\"type\":\"Feature\",\"properties\":{{{{\"contour\":15}}}},\"geometry\":{{{{\"type\":\"MultiLineString\",\"coordinates\":[' || string_agg(printf('[[%.6f,%.6f],[%.6f,%.6f]]', x1 * 0.005e0, y1 * 0.005e0, x2 * 0.005e0, y2 * 0.005e0), ',' ORDER BY y1, x1, y2, x2) || ']}}}}}}}}' AS body FROM s".replace("{{", "{").replace("}}", "}"),
)
def contour_geojson(spark, sf_dir):
    cells = fx.nodes(spark, sf_dir).selectExpr("0L AS source", "rw AS r", "col AS c", "elevation AS minutes")
    return out.contour_geojson(contours.segments(contours.marching_squares(cells, 400.0)), 0.01, 15)


@query("k10_expansion_geojson", f"{WITH}, {_ARCS}, {_reach('SELECT 0::BIGINT AS source, 5::BIGINT AS node, 0e0 AS cost', '400e0')} SELECT e.edge_id, printf('{{\"type\":\"Feature\",\"properties\":{{\"cost\":%d}},\"geometry\":{{\"type\":\"LineString\",\"coordinates\":[[%.6f,%.6f],[%.6f,%.6f]]}}}}}}}}', CAST(round(round(r.cost, 6)) AS BIGINT), e.lon1, e.lat1, e.lon2, e.lat2) AS body FROM r JOIN edges e ON e.src = r.node".replace("{{", "{").replace("}}", "}"))
def expansion_geojson(spark, sf_dir):
    labels = paths.reach_within(_node_arcs(spark, sf_dir), spark.range(1).selectExpr("id AS source", "5L AS node"), 400.0)
    met = fx.edges(spark, sf_dir).join(labels.select(F.col("node").alias("src"), F.round("cost", 6).alias("cost")), "src")
    return out.expansion_geojson(met)


@query("k12_field_selector", "SELECT event_id, '{' || concat_ws(',', CASE WHEN event_id % 2 = 0 THEN '\"trip\":' || user_id END, CASE WHEN event_id % 3 = 0 THEN '\"status\":\"' || event_type || '\"' END) || '}' AS body FROM events")
def field_selector(spark, sf_dir):
    wanted = "filter(array(IF(event_id % 2 = 0, 'trip', ''), IF(event_id % 3 = 0, 'status', '')), x -> x <> '') AS wanted"
    rows = fx.table(spark, sf_dir, "events").selectExpr("event_id", "user_id AS trip", "event_type AS status", wanted)
    return out.chosen_sections(rows, ["trip", "status"]).select("event_id", "body")


@query("k19_metric_lines", "SELECT 'pathloom.' || event_type || ':' || count(*) || '|c' AS line FROM events GROUP BY event_type")
def metric_lines(spark, sf_dir):
    counts = fx.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("value"))
    return out.statsd_lines(counts.withColumn("kind", F.lit("c")))


# --- tables from text, tiles --------------------------------------------------------------------------------

_TABLE = '[{"admin": 3, "urban": [50, 45, null, 40, 30, 30, 20, 10], "rural": [90, 80, 70, 60, null, 40, 30, 15]}, {"admin": 7, "urban": [60, 55, 50, 45, 40, 35, 30, 25], "rural": [100, 95, 85, 75, 65, 55, 45, 35]}, {"urban": [null, 52, 47, null, 37, 32, 27, null], "rural": [110, null, 88, 77, 66, 55, 44, 33]}]'
_ENTRIES = [(3, True, [50, 45, None, 40, 30, 30, 20, 10]), (3, False, [90, 80, 70, 60, None, 40, 30, 15]), (7, True, [60, 55, 50, 45, 40, 35, 30, 25]), (7, False, [100, 95, 85, 75, 65, 55, 45, 35]), (None, True, [None, 52, 47, None, 37, 32, 27, None]), (None, False, [110, None, 88, 77, 66, 55, 44, 33])]
_CONFIG = "cfg(admin_id, urban, road_class, kph) AS (VALUES " + ", ".join(f"({'NULL' if a is None else a}, {u}, {c}, {k})" for a, u, kph in _ENTRIES for c, k in enumerate(kph) if k is not None) + ")"


@query("s13_e17_assigned_speeds", f"{WITH}, {_CONFIG} SELECT e.edge_id, CAST(coalesce(c.kph, g.kph, e.speed) AS BIGINT) AS kph, coalesce(c.kph, g.kph, e.speed) <> e.speed AS changed FROM edges e LEFT JOIN cfg c ON c.admin_id = e.admin_id AND c.urban = (e.density >= 8) AND c.road_class = e.road_class LEFT JOIN cfg g ON g.admin_id IS NULL AND g.urban = (e.density >= 8) AND g.road_class = e.road_class")
def assigned_speeds(spark, sf_dir):
    table = sp.parse_speed_table(spark.createDataFrame([(_TABLE,)], "text string"))
    return sp.assign_speeds(fx.edges(spark, sf_dir), table)


@query("s16_line_inputs", f"{WITH} SELECT rw AS line, col AS seq, round(lon, 6) AS lon, round(lat, 6) AS lat, 'polyline' AS form FROM nodes UNION ALL SELECT rw, col, round(lon, 6), round(lat, 6), 'geojson' FROM nodes")
def line_inputs(spark, sf_dir):
    from pathloom.functions.codec import polyline_of

    shape = fx.nodes(spark, sf_dir).groupBy(F.col("rw").alias("line")).agg(F.sort_array(F.collect_list(F.struct("col", "lon", "lat"))).alias("s"))
    coded = shape.select("line", polyline_of(F.transform("s", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))).alias("text"))
    body = "concat('{\"type\":\"Feature\",\"geometry\":{\"type\":\"LineString\",\"coordinates\":', to_json(transform(s, p -> array(p.lon, p.lat))), '}}') AS text"
    both = ln.polyline_points(coded).withColumn("form", F.lit("polyline")).unionByName(ln.geojson_points(shape.selectExpr("line", body)).withColumn("form", F.lit("geojson")))
    return both.select("line", F.col("seq").cast("long").alias("seq"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "form")


@query("s3_node_scan", f"{WITH}, wn AS (SELECT way_id, src AS node_id FROM edges UNION SELECT way_id, dst FROM edges) SELECT w.way_id, w.node_id, n.lon, n.lat, w.node_id % 13 = 0 AS signal FROM wn w JOIN nodes n ON n.node_id = w.node_id")
def node_scan(spark, sf_dir):
    """Nodes that ways use, with their places and tags."""
    tagged = fx.nodes(spark, sf_dir).selectExpr("node_id", "lon", "lat", "map('highway', IF(node_id % 13 = 0, 'traffic_signals', 'none')) AS tags")
    used = fx.edges(spark, sf_dir).select("way_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    return used.join(tagged, "node_id").selectExpr("way_id", "node_id", "lon", "lat", "tags['highway'] = 'traffic_signals' AS signal")


@query("k1_s6_h9_tiles", f"{WITH}, t AS (SELECT edge_id, CAST(floor((lat1 + 90e0) / 0.25e0) AS BIGINT) * 1440 + CAST(floor((lon1 + 180e0) / 0.25e0) AS BIGINT) AS tile FROM edges) SELECT tile, count(*) AS edges, min(edge_id) AS first FROM t GROUP BY tile")
def tile_store(spark, sf_dir):
    import uuid

    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tiles-{uuid.uuid4().hex}"
    tiles.write_tiles(fx.edges(spark, sf_dir), path)
    return tiles.read_tiles(spark, path).groupBy(F.col("tile").cast("long").alias("tile")).agg(F.count("*").alias("edges"), F.min("edge_id").alias("first"))


@query("h7_gzip_round_trip", "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes FROM documents")
def gzip_round_trip(spark, sf_dir):
    from pathloom.functions.codec import deflated, inflated

    packed = fx.table(spark, sf_dir, "documents").select("doc_id", deflated(F.coalesce("text", F.lit("")).cast("binary")).alias("z"))
    return packed.select("doc_id", F.octet_length(inflated("z")).cast("long").alias("bytes"))


# --- matching, guidance -------------------------------------------------------------------------------------

_NAMES = ["sigma_z", "beta", "search_radius", "turn_penalty_factor"]


@query("m10_h15_match_settings", "SELECT event_id, 4.07e0 AS sigma_z, CASE WHEN event_id % 5 = 0 THEN value ELSE 3e0 END AS beta, 50e0 AS search_radius, CASE event_id % 4 WHEN 0 THEN 200e0 WHEN 1 THEN 100e0 WHEN 2 THEN 140e0 ELSE 70e0 END AS turn_penalty_factor FROM events")
def match_settings(spark, sf_dir):
    """Defaults, what the mode sets, then what the request does."""
    modes = {m: match_config(m) for m in MATCH_MODES}
    mode = "CASE event_id % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'pedestrian' WHEN 2 THEN 'bicycle' ELSE 'multimodal' END AS mode"
    table = spark.createDataFrame([(m, *(c[n] for n in _NAMES)) for m, c in modes.items()], "mode string, " + ", ".join(f"{n} double" for n in _NAMES))  # a row a mode
    asked = fx.table(spark, sf_dir, "events").selectExpr("event_id", mode, "IF(event_id % 5 = 0, value, NULL) AS given")
    return asked.join(F.broadcast(table), "mode").select("event_id", "sigma_z", F.coalesce("given", "beta").alias("beta"), "search_radius", "turn_penalty_factor")


@query("m7_o6_k_best_paths")
def k_best_paths(spark, sf_dir):
    states = fx.traces(spark, sf_dir).select("trace_id", "seq", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("state"))
    before = F.when(F.col("seq") > 1, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(None).cast("int")))
    steps = states.select("*", F.explode(before).alias("before"))
    cost = "CAST((seq * 7 + state * 5 + trace_id * 3) % 11 AS DOUBLE) AS emission"
    steps = steps.selectExpr("trace_id", "seq AS time", "CAST(state AS BIGINT) AS state", cost, "CAST(before AS BIGINT) AS before", "coalesce(abs(state - before) * 2e0, 0e0) AS transition")
    return matching.k_best(steps, 3).select("trace_id", "rank", "cost", F.array_join("states", "").alias("states"))


@query(
    "d4_collapsed_maneuvers",
    f"{WITH}, {_ALONG}, i AS (SELECT trip_id, CAST(floor(col1 / 3e0) AS BIGINT) + 1 AS island, 'Block ' || CAST(floor(col1 / 3e0) AS BIGINT) AS street, sum(length) AS metres FROM along GROUP BY ALL), t AS (SELECT *, coalesce(max(CASE WHEN metres >= 2000e0 THEN island END) OVER (PARTITION BY trip_id ORDER BY island ROWS UNBOUNDED PRECEDING), min(CASE WHEN metres >= 2000e0 THEN island END) OVER (PARTITION BY trip_id), island) AS kept FROM i) SELECT trip_id, kept AS island, max(CASE WHEN island = kept THEN street END) AS street, round(sum(metres), 3) AS metres, count(*) AS parts FROM t GROUP BY trip_id, kept",
)
def collapsed_maneuvers(spark, sf_dir):
    legs = guidance.runs(_along(spark, sf_dir), "trip_id", ["seq"], "street").groupBy("trip_id", "island").agg(F.first("street").alias("street"), F.sum("length").alias("metres"))
    done = guidance.collapse(legs, 2000.0)
    return done.select("trip_id", "island", "street", F.round("metres", 3).alias("metres"), "parts")


@query(
    "d5_roundabout_exits",
    f"{WITH}, {_ALONG}, p AS (SELECT trip_id, seq, dst, col1 % 5 IN (2, 3) AS r FROM along), g AS (SELECT *, sum(CASE WHEN r THEN 0 ELSE 1 END) OVER (PARTITION BY trip_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS k FROM p), o AS (SELECT src, count(*) AS n FROM edges WHERE NOT (kind = 0 AND edge_id % 2 = 0 AND col1 % 5 IN (2, 3)) GROUP BY src), m AS (SELECT g.trip_id, g.seq, g.k, coalesce(o.n, 0) AS n FROM g LEFT JOIN o ON o.src = g.dst WHERE g.r) SELECT trip_id, min(seq) AS first, CAST(sum(n) - max_by(n, seq) + least(max_by(n, seq), 1) AS BIGINT) AS exit FROM m GROUP BY trip_id, k",
)
def roundabout_exits(spark, sf_dir):
    e = fx.edges(spark, sf_dir).withColumn("roundabout", F.expr("kind = 0 AND edge_id % 2 = 0 AND col1 % 5 IN (2, 3)"))
    path = _along(spark, sf_dir).selectExpr("trip_id", "seq", "edge_id", "col1 % 5 IN (2, 3) AS roundabout")
    return guidance.roundabout_exits(path, e)


# --- network building ---------------------------------------------------------------------------------------

_DENSITY = f"cell AS (SELECT {_CELL} AS r, {_CELLC} AS c, sum(length) AS metres FROM edges GROUP BY ALL), dens AS (SELECT a.r, a.c, CAST(least(15, round(0.7e0 * sum(b.metres) * 0.0005e0 / (4e0 * count(*)))) AS BIGINT) AS density FROM cell a JOIN cell b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY a.r, a.c)"


@query("e4_enhanced_edges", f"{WITH}, {_DENSITY}, outs AS (SELECT src, count(DISTINCT dst) AS n FROM edges GROUP BY src) SELECT e.edge_id, d.density, d.density >= 2 AS urban, coalesce(o.n, 0) <= 2 AS dead_end FROM edges e JOIN dens d ON d.r = {_CELL} AND d.c = {_CELLC} LEFT JOIN outs o ON o.src = e.dst")
def enhanced_edges(spark, sf_dir):
    e = fx.edges(spark, sf_dir)
    cells = etl.density(e.selectExpr(f"{_CELL} AS r", f"{_CELLC} AS c", "length"), cell_area=4.0)
    # on a lattice no way ends, so the corners stand for ends
    return etl.enhance(e, cells, urban=2, ends=2)


@query("e6_kept_graph", f"{WITH}, k AS (SELECT edge_id, src, dst FROM edges WHERE {fl.accessible(fl.TRUCK)}), n AS (SELECT node, dense_rank() OVER (ORDER BY node) AS number FROM (SELECT src AS node FROM k UNION SELECT dst FROM k)) SELECT k.edge_id, a.number AS src, b.number AS dst FROM k JOIN n a ON a.node = k.src JOIN n b ON b.node = k.dst")
def kept_graph(spark, sf_dir):
    return etl.kept_graph(fx.edges(spark, sf_dir), fl.accessible(fl.TRUCK))


@query("e8_bike_stations", f"{WITH}, {POINTS}, {_HITS}, r AS (SELECT n.pt_id, n.edge_id, n.metres, m.mode, row_number() OVER (PARTITION BY n.pt_id, m.mode ORDER BY round(n.metres, 3), n.edge_id) AS k FROM near n JOIN edges e ON e.edge_id = n.edge_id JOIN (VALUES ('walk', 8), ('ride', 2)) m(mode, mask) ON (e.access & m.mask) <> 0) SELECT pt_id, mode, edge_id, round(metres, 3) AS metres FROM r WHERE k = 1")
def bike_stations(spark, sf_dir):
    """Every station is joined to the nearest edge that one may walk on, and to the nearest to ride on."""
    e, stations = fx.edges(spark, sf_dir), fx.points(spark, sf_dir)
    found = [spatial.nearest_edges(stations, e.where(fl.accessible(mask)), 1).withColumn("mode", F.lit(mode)) for mode, mask in (("walk", fl.PEDESTRIAN), ("ride", 2))]
    return found[0].unionByName(found[1]).select("pt_id", "mode", "edge_id", F.round("metres", 3).alias("metres"))


@query("o2_cost_buckets", f"{WITH}, {_ARCS}, {_reach(_SEEDS, '900e0')} SELECT source, CAST(floor(round(cost, 6) / 60e0) AS BIGINT) AS bucket, count(*) AS nodes FROM r GROUP BY ALL")
def cost_buckets(spark, sf_dir):
    labels = paths.costs_from(_node_arcs(spark, sf_dir), _seeds(spark, sf_dir), 900.0)
    return paths.cost_buckets(labels.withColumn("cost", F.round("cost", 6)), 60.0)
