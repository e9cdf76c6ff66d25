"""Scalar library: geometry, ids, time, speeds and strings over the fixture network."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom import fixtures as fx
from pathloom.fixtures import POINTS, TRACES, WITH
from pathloom.functions import geo, ids, speeds, timefn
from pathloom.queries.portable import portable
from pathloom.registry import query

_AB = ("lon1", "lat1", "lon2", "lat2")

portable("g01_g03_distance_heading", fx.edges, "edges", {"edge_id": "edge_id", "metres": f"round({geo.haversine(*_AB)}, 3)", "planar": f"round(sqrt({geo.planar2(*_AB)}), 3)", "bearing": f"round({geo.heading(*_AB)}, 5)"})
_lon, _lat = geo.along(*_AB, "0.25e0")
portable("g05_point_along", fx.edges, "edges", {"edge_id": "edge_id", "lon": f"round({_lon}, 8)", "lat": f"round({_lat}, 8)"})


def _corner(spark, sf_dir):
    """Each node with the node to its east and the node to the north-east."""
    e = fx.edges(spark, sf_dir)
    east = e.where("kind = 0 AND edge_id % 2 = 0").selectExpr("src AS a", "dst AS b", "lon1 AS ax", "lat1 AS ay", "lon2 AS bx", "lat2 AS by_")
    north = e.where("kind = 1 AND edge_id % 2 = 0").selectExpr("src AS b", "dst AS c", "lon2 AS cx", "lat2 AS cy")
    return east.join(north, "b")


_CORNER = "corner AS (SELECT x.src AS a, x.dst AS b, y.dst AS c, x.lon1 AS ax, x.lat1 AS ay, x.lon2 AS bx, x.lat2 AS by_, y.lon2 AS cx, y.lat2 AS cy FROM edges x JOIN edges y ON y.src = x.dst WHERE x.kind = 0 AND x.edge_id % 2 = 0 AND y.kind = 1 AND y.edge_id % 2 = 0)"
_sides = [geo.haversine("ax", "ay", "bx", "by_"), geo.haversine("bx", "by_", "cx", "cy"), geo.haversine("ax", "ay", "cx", "cy")]
portable("g06_curvature_radius", _corner, "corner", {"a": "a", "radius": f"round({geo.circumradius(*_sides)}, 2)", "in_line": f"{geo.circumradius('1e0', '2e0', '3e0')} > 1e300"}, extra=_CORNER)
portable("g10_triangle_contains", _corner, "corner", {"a": "a", "inside": geo.in_triangle("ax + 0.006e0", "ay + 0.004e0", "ax", "ay", "bx", "by_", "cx", "cy"), "outside": geo.in_triangle("ax + 0.001e0", "ay + 0.008e0", "ax", "ay", "bx", "by_", "cx", "cy")}, extra=_CORNER)
portable("g11_segment_intersection", _corner, "corner", {"a": "a", "meets": geo.segments_cross("ax", "ay", "cx", "cy", "ax + 0.005e0", "ay", "ax + 0.005e0", "cy"), "misses": geo.segments_cross("ax", "ay", "bx", "by_", "ax", "ay + 0.003e0", "bx", "by_ + 0.003e0")}, extra=_CORNER)
portable("g13_box_relations", _corner, "corner", {"a": "a", "meets": geo.boxes_meet(("ax", "ay", "cx", "cy"), ("ax + 0.005e0", "ay - 0.1e0", "ax + 0.5e0", "ay + 0.1e0")), "apart": geo.boxes_meet(("ax", "ay", "cx", "cy"), ("cx + 1e0", "cy", "cx + 2e0", "cy + 1e0")), "wider": "round((cx - ax + 0.02e0) * (cy - ay + 0.02e0), 8)"}, extra=_CORNER)
portable("g22_polygon_area", _corner, "corner", {"a": "a", "area": "round(abs((ax * by_ - bx * ay) + (bx * cy - cx * by_) + (cx * ay - ax * cy)) / 2e0, 9)"}, extra=_CORNER)
portable("g35_turn_degree_type", _corner, "corner", {"a": "a", "degree": geo.turn_degree(geo.heading("ax", "ay", "bx", "by_"), geo.heading("bx", "by_", "cx", "cy")), "kind": geo.turn_type(geo.turn_degree(geo.heading("ax", "ay", "bx", "by_"), geo.heading("bx", "by_", "cx", "cy")))}, extra=_CORNER)
_ex, _ey = geo.azimuthal("lon2", "lat2", "lon1", "lat1")
portable("g28_azimuthal_projection", fx.edges, "edges", {"edge_id": "edge_id", "east": f"round({_ex}, 3)", "north": f"round({_ey}, 3)"})
_mx, _my = geo.mercator_tile("lon", "lat", 14)
portable("g29_mercator_tiles", fx.nodes, "nodes", {"node_id": "node_id", "x": _mx, "y": _my})
portable("g36_clamps", fx.nodes, "nodes", {"node_id": "node_id", "clamped": "least(greatest(elevation, 10e0), 500e0)", "wrapped": f"round({geo.circular_clamp('lon * 100e0', -180, 180)}, 6)"})
_size = ids.LEVEL_DEGREES[2]
portable(
    "g24_b1_tiles_and_ids",
    fx.nodes,
    "nodes",
    {
        "node_id": "node_id",
        "tile": ids.tile_id("lon", "lat", _size),
        "gid": ids.pack("2", ids.tile_id("lon", "lat", _size), "node_id"),
        "level": ids.level_of(ids.pack("2", ids.tile_id("lon", "lat", _size), "node_id")),
        "tile_back": f"CAST({ids.tile_of(ids.pack('2', ids.tile_id('lon', 'lat', _size), 'node_id'))} AS BIGINT)",
        "index_back": f"CAST({ids.index_of(ids.pack('2', ids.tile_id('lon', 'lat', _size), 'node_id'))} AS BIGINT)",
    },
)
_tile = ids.tile_id("lon", "lat", _size)
portable("b2_tile_paths", fx.nodes, "nodes", {"node_id": "node_id", "path": f"'2/' || lpad(CAST(CAST(floor({_tile} / 1000000e0) AS BIGINT) AS VARCHAR(3)), 3, '0') || '/' || lpad(CAST(CAST(floor({_tile} / 1000e0) AS BIGINT) % 1000 AS VARCHAR(3)), 3, '0') || '/' || lpad(CAST({_tile} % 1000 AS VARCHAR(3)), 3, '0')"})
portable("b3_tile_parents", fx.nodes, "nodes", {"node_id": "node_id", "local": _tile, "arterial": ids.tile_id("lon", "lat", 1.0), "highway": ids.tile_id("lon", "lat", 4.0)})


@query(
    "g25_b4_tiles_of_box",
    f"{WITH}, boxes AS (SELECT node_id, {ids.col_of('lon - 0.3e0', _size)} AS c1, {ids.col_of('lon + 0.3e0', _size)} AS c2, {ids.row_of('lat - 0.3e0', _size)} AS r1, {ids.row_of('lat + 0.3e0', _size)} AS r2 FROM nodes), cs AS (SELECT *, unnest(generate_series(c1, c2)) AS c FROM boxes), rs AS (SELECT *, unnest(generate_series(r1, r2)) AS r FROM cs) SELECT node_id, r * {ids.columns(_size)} + c AS tile FROM rs",
)
def tiles_of_box(spark, sf_dir):
    at = fx.nodes(spark, sf_dir)
    cols = at.selectExpr("node_id", "lat", f"explode(sequence({ids.col_of('lon - 0.3e0', _size)}, {ids.col_of('lon + 0.3e0', _size)})) AS c")
    rows = cols.selectExpr("node_id", "c", f"explode(sequence({ids.row_of('lat - 0.3e0', _size)}, {ids.row_of('lat + 0.3e0', _size)})) AS r")
    return rows.selectExpr("node_id", f"r * {ids.columns(_size)} + c AS tile")


_WAY = "way AS (SELECT rw AS line, list(struct_pack(lon := lon, lat := lat) ORDER BY col) AS shape FROM nodes GROUP BY rw)"


@query("g16_polyline_length", f"{WITH}, seg AS (SELECT rw, lon, lat, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM nodes WINDOW w AS (PARTITION BY rw ORDER BY col)) SELECT rw AS line, count(*) AS points, round(sum(coalesce({geo.haversine('lon', 'lat', 'lon2', 'lat2')}, 0e0)), 2) AS metres FROM seg GROUP BY rw")
def polyline_length(spark, sf_dir):
    shape = fx.nodes(spark, sf_dir).groupBy(F.col("rw").alias("line")).agg(F.sort_array(F.collect_list(F.struct("col", "lon", "lat"))).alias("shape"))
    step = geo.haversine("shape[i].lon", "shape[i].lat", "shape[i + 1].lon", "shape[i + 1].lat")
    total = f"aggregate(transform(sequence(0, size(shape) - 1), i -> CASE WHEN i = size(shape) - 1 THEN 0e0 ELSE {step.replace('shape[i + 1]', 'get(shape, i + 1)')} END), 0e0, (s, x) -> s + x)"
    return shape.selectExpr("line", "CAST(size(shape) AS BIGINT) AS points", f"round({total}, 2) AS metres")


_LINES = "(SELECT max(rw) + 1 FROM nodes)"


@query(
    "g07_g08_closest_point_on_line",
    f"{WITH}, {POINTS}, shot AS (SELECT p.pt_id, e.edge_id, p.lon, p.lat, e.lon1, e.lat1, e.lon2, e.lat2, {geo.project_share('p.lon', 'p.lat', 'e.lon1', 'e.lat1', 'e.lon2', 'e.lat2')} AS t FROM points p JOIN edges e ON e.edge_id % 2 = 0 AND e.rw1 = p.pt_id % {_LINES} AND e.kind = 0), far AS (SELECT pt_id, edge_id, t, {geo.haversine('lon', 'lat', '(lon1 + t * (lon2 - lon1))', '(lat1 + t * (lat2 - lat1))')} AS metres FROM shot) SELECT pt_id, edge_id, round(t, 6) AS share, round(metres, 3) AS metres FROM (SELECT *, row_number() OVER (PARTITION BY pt_id ORDER BY round(metres, 3), edge_id) AS k FROM far) WHERE k = 1",
)
def closest_point(spark, sf_dir):
    from pathloom.operators.spatial import closest_on_lines

    # every point against the street of one lattice row, whose line runs along its eastward edges
    lines = fx.edges(spark, sf_dir).where("edge_id % 2 = 0 AND kind = 0").withColumnRenamed("rw1", "line")
    rows = fx.nodes(spark, sf_dir).agg(F.max("rw")).first()[0] + 1
    asked = fx.points(spark, sf_dir).withColumn("line", F.col("pt_id") % rows)
    return closest_on_lines(asked, lines).selectExpr("pt_id", "edge_id", "round(share, 6) AS share", "round(metres, 3) AS metres")


@query(
    "g18_hausdorff_distance",
    f"{WITH}, d AS (SELECT a.rw AS line, a.col AS i, min({geo.haversine('a.lon', 'a.lat', 'b.lon', 'b.lat')}) AS m FROM nodes a JOIN nodes b ON b.rw = a.rw + 1 GROUP BY ALL) SELECT line, round(max(m), 3) AS metres FROM d GROUP BY line",
)
def hausdorff(spark, sf_dir):
    a = fx.nodes(spark, sf_dir)
    shape = a.groupBy((F.col("rw") - 1).alias("rw")).agg(F.collect_list(F.struct("lon", "lat")).alias("other"))
    near = a.join(shape, "rw").selectExpr("rw AS line", f"array_min(transform(other, o -> {geo.haversine('lon', 'lat', 'o.lon', 'o.lat')})) AS m")
    return near.groupBy("line").agg(F.round(F.max("m"), 3).alias("metres"))


_bin = f"(CAST(floor((lat + 90e0) / 0.05e0) AS BIGINT) * 7200 + CAST(floor((lon + 180e0) / 0.05e0) AS BIGINT))"


@query(
    "g26_bin_cover",
    f"{WITH}, cells AS (SELECT edge_id, CAST(floor((least(lon1, lon2) + 180e0) / 0.05e0) AS BIGINT) AS c1, CAST(floor((greatest(lon1, lon2) + 180e0) / 0.05e0) AS BIGINT) AS c2, CAST(floor((least(lat1, lat2) + 90e0) / 0.05e0) AS BIGINT) AS r1, CAST(floor((greatest(lat1, lat2) + 90e0) / 0.05e0) AS BIGINT) AS r2 FROM edges), c AS (SELECT *, unnest(generate_series(c1, c2)) AS cc FROM cells), r AS (SELECT *, unnest(generate_series(r1, r2)) AS rr FROM c) SELECT rr * 7200 + cc AS bin_id, edge_id FROM r",
)
def bin_cover(spark, sf_dir):
    from pathloom.operators.spatial import edge_bins

    return edge_bins(fx.edges(spark, sf_dir))


# --- time ---------------------------------------------------------------------------------------------------

_EV = fx.table
_ts = lambda s, d: fx.table(s, d, "events")
portable("t1_t2_epoch_round_trip", _ts, "events", {"event_id": "event_id", "epoch": "CAST(floor(epoch(ts)) AS BIGINT)", "text": "strftime(ts, '%Y-%m-%dT%H:%M')"}, spark_columns={"epoch": "unix_timestamp(CAST(ts AS TIMESTAMP))", "text": "date_format(ts, \"yyyy-MM-dd'T'HH:mm\")"})
portable("t4_day_of_week_and_pivot", _ts, "events", {"event_id": "event_id", "dow": "CAST(dayofweek(ts) AS INT)", "mask": timefn.dow_mask("dayofweek(ts)"), "day": f"CAST(date_diff('day', DATE '{timefn.PIVOT}', CAST(ts AS DATE)) AS INT)", "second_of_week": f"CAST({timefn.second_of_week('ts', 0)} AS BIGINT)"}, spark_columns={"dow": "dayofweek(ts) - 1", "mask": timefn.dow_mask("(dayofweek(ts) - 1)"), "day": f"datediff(CAST(ts AS DATE), DATE '{timefn.PIVOT}')", "second_of_week": f"CAST({timefn.second_of_week('ts', 1)} AS BIGINT)"})
_month, _day = "CAST(month(ts) AS BIGINT)", "CAST(day(ts) AS BIGINT)"
_min = "(hour(ts) * 60 + minute(ts))"
portable("t5_conditional_windows", _ts, "events", {"event_id": "event_id", "morning": timefn.in_daily_window(_min, "420", "540"), "night": timefn.in_daily_window(_min, "1320", "360"), "winter": timefn.in_yearly_window(_month, _day, "11", "15", "1", "20"), "third_sunday": f"{_day} = {timefn.nth_weekday_day('1', '0', '3', '31')}", "fifth_tuesday": f"{_day} = {timefn.nth_weekday_day('1', '2', '5', '31')}", "fifth_monday": f"{_day} = {timefn.nth_weekday_day('1', '0', '5', '28')}"})
portable("t6_offset_date", _ts, "events", {"event_id": "event_id", "later": "strftime(ts + INTERVAL 5400 SECOND, '%Y-%m-%d %H:%M:%S')"}, spark_columns={"later": "date_format(ts + INTERVAL 5400 SECOND, 'yyyy-MM-dd HH:mm:ss')"})
portable("t7_time_at_node", _ts, "events", {"event_id": "event_id", "local": f"CAST(({timefn.second_of_week('ts', 0)} + 3600 * (event_id % 5 - 2) + 604800) % 604800 AS BIGINT)"}, spark_columns={"local": f"CAST(({timefn.second_of_week('ts', 1)} + 3600 * (event_id % 5 - 2) + 604800) % 604800 AS BIGINT)"})
portable("t9_t10_time_text", _ts, "events", {"event_id": "event_id", "span": "strftime(ts, '%H:%M') || '-' || strftime(ts + INTERVAL 2 HOUR, '%H:%M')", "day": "strftime(ts, '%d.%m.%Y')"}, spark_columns={"span": "date_format(ts, 'HH:mm') || '-' || date_format(ts + INTERVAL 2 HOUR, 'HH:mm')", "day": "date_format(ts, 'dd.MM.yyyy')"})


@query("t3_zone_difference", "SELECT event_id, CAST(CASE WHEN ts >= TIMESTAMP '2024-03-10 10:00:00' THEN 25200 ELSE 28800 END AS BIGINT) AS behind, CAST(3600 AS BIGINT) AS berlin FROM events")
def zone_difference(spark, sf_dir):
    def offset(zone):
        return f"unix_timestamp(from_utc_timestamp(ts, '{zone}')) - unix_timestamp(CAST(ts AS TIMESTAMP))"

    return fx.table(spark, sf_dir, "events").selectExpr("event_id", f"-({offset('America/Los_Angeles')}) AS behind", f"{offset('Europe/Berlin')} AS berlin")


# --- speeds -------------------------------------------------------------------------------------------------

_LIVE = {"bp1": "(CASE WHEN event_id % 10 = 0 THEN 0 WHEN event_id % 3 = 0 THEN 255 ELSE 100 END)", "bp2": "(CASE WHEN event_id % 3 = 0 THEN 255 ELSE 180 END)", "s1": "(event_id % 120)", "s2": "(CASE WHEN event_id % 7 = 0 THEN 127 ELSE event_id % 90 END)", "s3": "(CASE WHEN event_id % 4 = 0 THEN 127 ELSE 40 END)", "overall": "(CASE WHEN event_type = 'error' THEN 0 ELSE event_id % 100 END)"}
portable("v4_live_records", _ts, "events", {"event_id": "event_id", "valid": speeds.valid(_LIVE["bp1"], _LIVE["overall"]), "closed": speeds.closed(_LIVE["bp1"], _LIVE["overall"]), "kph": f"{_LIVE['overall']} * 2", "covered": f"round({speeds.coverage(*(_LIVE[k] for k in ('bp1', 'bp2', 's1', 's2', 's3')))}, 6)"})
_sod = "(CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(value * 170e0 AS INT) END)"
_live = f"(CASE WHEN {speeds.valid(_LIVE['bp1'], _LIVE['overall'])} THEN {_LIVE['overall']} * 2 ELSE 0 END)"
_part = f"({speeds.coverage(*(_LIVE[k] for k in ('bp1', 'bp2', 's1', 's2', 's3')))} * {speeds.fade('(event_id % 5000)')})"
_sod = "(CASE WHEN event_id % 9 = 0 THEN NULL ELSE (event_id * 7919) % 86400 END)"
portable("v1_layered_speed", _ts, "events", {"event_id": "event_id", "kph": speeds.blended(_live, _part, "(CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 110 AS DOUBLE) END)", "(event_id % 3 * 20)", "(event_id % 2 * 45)", "(30 + event_id % 50)", _sod, "(CASE WHEN event_id % 5 = 0 THEN 60 ELSE 0 END)")})
portable("v6_ferry_speed", fx.edges, "edges", {"edge_id": "edge_id", "kph": speeds.ferry_speed("length", "(60e0 + edge_id % 600)")})


@query(
    "v2_predicted_bucket_decode",
    f"WITH c AS (SELECT vec_id, unnest(embedding) * 1000.0::DOUBLE AS x, unnest(generate_series(0, len(embedding) - 1)) AS i FROM embeddings), b AS (SELECT unnest([0, 96, 500, 1007, 2015]) AS bucket) SELECT vec_id, bucket, round({speeds.NORM}e0 * sum(CASE WHEN i = 0 THEN x * 0.707106781e0 ELSE x * cos(pi() / 2016e0 * (bucket + 0.5e0) * i) END), 4) AS kph FROM c, b GROUP BY vec_id, bucket",
)
def predicted_decode(spark, sf_dir):
    term = "CASE WHEN i = 0 THEN x * 0.707106781e0 ELSE x * cos(pi() / 2016e0 * (bucket + 0.5e0) * i) END"
    coefficients = fx.table(spark, sf_dir, "embeddings").selectExpr("vec_id", "transform(embedding, v -> CAST(v AS DOUBLE) * 1000e0) AS c", "explode(array(0, 96, 500, 1007, 2015)) AS bucket")
    return coefficients.selectExpr("vec_id", "bucket", f"round({speeds.NORM}e0 * aggregate(transform(c, (x, i) -> {term}), 0e0, (s, v) -> s + v), 4) AS kph")


# --- strings, arrays, JSON ----------------------------------------------------------------------------------

portable("r1_r2_street_names", lambda s, d: fx.table(s, d, "supplier"), "supplier", {"s_suppkey": "s_suppkey", "pre": "regexp_extract(CASE s_suppkey % 3 WHEN 0 THEN 'North Main Street' WHEN 1 THEN 'Elm Avenue South' ELSE 'Broadway' END, '^(North|South|East|West) ', 1)", "post": "regexp_extract(CASE s_suppkey % 3 WHEN 0 THEN 'North Main Street' WHEN 1 THEN 'Elm Avenue South' ELSE 'Broadway' END, ' (North|South|East|West)$', 1)", "base": "regexp_replace(CASE s_suppkey % 3 WHEN 0 THEN 'North Main Street' WHEN 1 THEN 'Elm Avenue South' ELSE 'Broadway' END, '^(North|South|East|West) | (North|South|East|West)$', '')", "starts": "starts_with(s_name, 'Supp')"}, spark_columns={"starts": "startswith(s_name, 'Supp')"})
portable("r3_r5_r6_tokens", lambda s, d: fx.table(s, d, "part"), "part", {"p_partkey": "p_partkey", "first": "split_part(p_name, ' ', 1)", "joined": "replace(p_name, ' ', '; ')", "bare": "replace('\"' || p_brand || '\"', '\"', '')"})
portable("r7_word_and_utf8_length", lambda s, d: fx.table(s, d, "documents"), "documents", {"doc_id": "doc_id", "chars": "CAST(length(text) AS BIGINT)", "bytes": "CAST(strlen(text) AS BIGINT)", "words": "CAST(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS BIGINT)"}, spark_columns={"bytes": "CAST(octet_length(text) AS BIGINT)", "words": "CAST(size(regexp_extract_all(text, '[^ \\\\t\\\\n\\\\r]+', 0)) AS BIGINT)"})
portable("r9_units", lambda s, d: fx.table(s, d, "part"), "part", {"p_partkey": "p_partkey", "kph": "round(CASE WHEN p_partkey % 2 = 0 THEN CAST(regexp_extract(CAST(p_size AS VARCHAR(9)) || ' mph', '^([0-9.]+)', 1) AS DOUBLE) * 1.609344e0 ELSE CAST(p_size AS DOUBLE) END, 4)", "metres": "round(CASE WHEN p_partkey % 3 = 0 THEN p_size * 0.3048e0 ELSE p_size * 1e0 END, 4)"})
portable("r10_h8_class_names", fx.edges, "edges", {"edge_id": "edge_id", "class": "(CASE road_class WHEN 0 THEN 'motorway' WHEN 1 THEN 'trunk' WHEN 2 THEN 'primary' WHEN 3 THEN 'secondary' WHEN 4 THEN 'tertiary' WHEN 5 THEN 'unclassified' WHEN 6 THEN 'residential' ELSE 'service_other' END)"})


@query("n1_way_node_explode", f"{WITH} SELECT way_id, count(*) AS n, min(edge_id) AS first FROM edges GROUP BY way_id")
def way_explode(spark, sf_dir):
    ways = fx.edges(spark, sf_dir).groupBy("way_id").agg(F.sort_array(F.collect_list("edge_id")).alias("edges"))
    return ways.select("way_id", F.posexplode("edges").alias("pos", "edge_id")).groupBy("way_id").agg(F.count("*").alias("n"), F.min("edge_id").alias("first"))


@query("n6_s15_request_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, least(greatest(CAST(json_extract_string(props, '$.k') AS BIGINT), 10), 60) AS clamped, coalesce(json_extract_string(props, '$.missing'), 'auto') AS costing FROM events")
def request_json(spark, sf_dir):
    from pathloom.sources.requests import parse_requests

    return parse_requests(fx.table(spark, sf_dir, "events").select("event_id", "props"))


@query("n2_n3_array_and_map", f"{WITH}, n AS (SELECT src, list_sort(list(DISTINCT street)) AS names FROM edges GROUP BY src) SELECT e.edge_id, CAST(len(list_intersect(a.names, b.names)) AS INT) AS shared FROM edges e JOIN n a ON a.src = e.src JOIN n b ON b.src = e.dst")
def shared_names(spark, sf_dir):
    e = fx.edges(spark, sf_dir)
    names = e.groupBy("src").agg(F.collect_set("street").alias("names"))
    ends = e.select("edge_id", "src", "dst").join(names.withColumnRenamed("names", "a"), "src").join(names.select(F.col("src").alias("dst"), F.col("names").alias("b")), "dst")
    return ends.select("edge_id", F.size(F.array_intersect("a", "b")).alias("shared"))
