"""More of network building, geometry, guidance and text: the rest of the inventory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pathloom import fixtures as fx
from pathloom.fixtures import DEPARTURES, TRACES, WITH
from pathloom.functions import geo
from pathloom.operators import etl
from pathloom.operators import filters as fl
from pathloom.queries.portable import portable
from pathloom.registry import query
from pathloom.sources import ways as ws

_KIND = "CASE p_partkey % 9 WHEN 0 THEN 'motorway' WHEN 1 THEN 'trunk' WHEN 2 THEN 'primary' WHEN 3 THEN 'secondary' WHEN 4 THEN 'tertiary' WHEN 5 THEN 'unclassified' WHEN 6 THEN 'residential' ELSE 'track' END"


@query("s1_s2_e1_tag_transform", "SELECT p_partkey AS way_id, CASE WHEN p_partkey % 9 < 7 THEN CAST(p_partkey % 9 AS INT) ELSE 7 END AS road_class, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN CAST(round(p_size * 1.609344) AS INT) ELSE p_size END AS kph, p_partkey % 3 = 0 AS oneway, p_partkey % 4 = 0 AS toll FROM part")
def tag_transform(spark, sf_dir):
    speed = "CASE WHEN p_partkey % 5 = 0 THEN 'none' WHEN p_partkey % 2 = 0 THEN concat(p_size, ' mph') ELSE CAST(p_size AS STRING) END"
    tagged = fx.table(spark, sf_dir, "part").selectExpr("p_partkey AS way_id", f"map('highway', {_KIND}, 'maxspeed', {speed}, 'oneway', IF(p_partkey % 3 = 0, 'yes', 'no'), 'toll', IF(p_partkey % 4 = 0, '1', 'x')) AS tags")
    return ws.transform_tags(tagged)


_HOURS = "(CASE p_partkey % 4 WHEN 0 THEN 'Mo-Fr 07:00-09:30' WHEN 1 THEN 'Sa 22:15-06:00' WHEN 2 THEN 'Fr-Mo 00:00-23:59' ELSE '12:00-13:00' END)"
portable("t8_opening_hours", lambda s, d: fx.table(s, d, "part"), "part", {"p_partkey": "p_partkey", "mask": f"CAST({ws.weekday_mask(_HOURS)} AS INT)", "begin": ws.minutes_of(_HOURS, False), "until": ws.minutes_of(_HOURS, True)})

_RULES = "rules AS (SELECT o_orderkey AS rule, CAST(floor(o_custkey / 4e0) AS BIGINT) AS from_way, o_custkey + 1 AS via_node, CAST(floor((o_custkey + 1) / 4e0) AS BIGINT) AS to_way FROM orders)"


@query("p27_e11_restriction_builder", f"{WITH}, {_RULES} SELECT r.rule, a.edge_id AS from_edge, b.edge_id AS to_edge FROM rules r JOIN edges a ON a.way_id = r.from_way AND a.dst = r.via_node JOIN edges b ON b.way_id = r.to_way AND b.src = r.via_node")
def restriction_builder(spark, sf_dir):
    rules = fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS rule", "CAST(floor(o_custkey / 4e0) AS BIGINT) AS from_way", "o_custkey + 1 AS via_node", "CAST(floor((o_custkey + 1) / 4e0) AS BIGINT) AS to_way")
    return ws.resolve_restrictions(rules, fx.edges(spark, sf_dir))


@query("j17_j27_restriction_modes", f"{WITH}, {_RULES} SELECT e.edge_id, count(*) AS rules, bit_or(r.rule % 16) AS modes FROM edges e JOIN rules r ON r.from_way = e.way_id AND ((r.rule % 16) & 5) <> 0 GROUP BY e.edge_id")
def restriction_modes(spark, sf_dir):
    rules = fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey % 16 AS modes", "CAST(floor(o_custkey / 4e0) AS BIGINT) AS way_id").where("(modes & 5) <> 0")
    by_way = rules.groupBy("way_id").agg(F.count("*").alias("rules"), F.bit_or("modes").alias("modes"))
    return fx.edges(spark, sf_dir).select("edge_id", "way_id").join(by_way, "way_id").select("edge_id", "rules", "modes")


@query("j6_p30_twin_nodes", f"{WITH}, twins AS (SELECT node_id, node_id + 1000000 * l AS twin, l AS level FROM nodes, (SELECT unnest([0, 1, 2]) AS l) WHERE node_id % (l + 1) = 0) SELECT node_id, count(*) AS levels, count(*) - 1 AS transitions_up FROM twins GROUP BY node_id")
def twin_nodes(spark, sf_dir):
    twins = fx.nodes(spark, sf_dir).select("node_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("l")).where("node_id % (l + 1) = 0").selectExpr("node_id + 1000000L * l AS twin")
    return twins.selectExpr("twin % 1000000 AS node_id").groupBy("node_id").agg(F.count("*").alias("levels")).selectExpr("node_id", "levels", "levels - 1 AS transitions_up")


@query("j26_shortcut_recovery", f"{WITH} SELECT 5000000 + rw1 AS shortcut, edge_id, CAST(row_number() OVER (PARTITION BY rw1 ORDER BY src) AS INT) AS seq FROM edges WHERE kind = 0 AND edge_id % 2 = 0")
def shortcut_recovery(spark, sf_dir):
    made = fx.edges(spark, sf_dir).where("kind = 0 AND edge_id % 2 = 0").groupBy("rw1").agg(F.sort_array(F.collect_list(F.struct("src", "edge_id"))).alias("base"))
    return made.select((F.col("rw1") + 5000000).alias("shortcut"), F.posexplode("base").alias("pos", "b")).select("shortcut", "b.edge_id", (F.col("pos") + 1).alias("seq"))


@query("p24_edge_walk", f"{WITH}, walk AS (SELECT rw AS trip, col AS seq, node_id, lead(node_id) OVER (PARTITION BY rw ORDER BY col) AS nxt FROM nodes) SELECT w.trip, w.seq, e.edge_id FROM walk w JOIN edges e ON e.src = w.node_id AND e.dst = w.nxt")
def edge_walk(spark, sf_dir):
    nxt = F.lead("node_id").over(Window.partitionBy("rw").orderBy("col"))
    walk = fx.nodes(spark, sf_dir).select(F.col("rw").alias("trip"), F.col("col").alias("seq"), F.col("node_id").alias("src"), nxt.alias("dst")).where("dst IS NOT NULL")
    return walk.join(fx.edges(spark, sf_dir).select("src", "dst", "edge_id"), ["src", "dst"]).select("trip", "seq", "edge_id")


@query("p28_p29_reclassification", f"{WITH}, best AS (SELECT node, min(c) AS c FROM (SELECT src AS node, road_class AS c FROM edges WHERE use <> 6 UNION ALL SELECT dst, road_class FROM edges WHERE use <> 6) GROUP BY node) SELECT e.edge_id, least(e.road_class, greatest(coalesce(a.c, 7), coalesce(b.c, 7))) AS road_class FROM edges e LEFT JOIN best a ON a.node = e.src LEFT JOIN best b ON b.node = e.dst WHERE e.use = 6")
def reclassification(spark, sf_dir):
    e = fx.edges(spark, sf_dir)
    best = e.where("use <> 6").select(F.explode(F.array("src", "dst")).alias("node"), F.col("road_class").alias("c")).groupBy("node").agg(F.min("c").alias("c"))
    links = e.where("use = 6").select("edge_id", "src", "dst", "road_class")
    return links.join(best.selectExpr("node AS src", "c AS a"), "src", "left").join(best.selectExpr("node AS dst", "c AS b"), "dst", "left").selectExpr("edge_id", "least(road_class, greatest(coalesce(a, 7L), coalesce(b, 7L))) AS road_class")


@query("p23_p33_dead_ends", f"{WITH}, kept AS (SELECT * FROM edges WHERE NOT toll AND surface <> 7), d AS (SELECT n.node_id, count(DISTINCT k.dst) AS outs FROM nodes n LEFT JOIN kept k ON k.src = n.node_id GROUP BY n.node_id) SELECT node_id, CASE WHEN outs = 0 THEN 'unroutable' ELSE 'dead end' END AS kind FROM d WHERE outs <= 1")
def dead_ends(spark, sf_dir):
    outs = fx.edges(spark, sf_dir).where("NOT toll AND surface <> 7").groupBy(F.col("src").alias("node_id")).agg(F.count_distinct("dst").alias("outs"))
    held = fx.nodes(spark, sf_dir).select("node_id").join(outs, "node_id", "left").na.fill(0, ["outs"])
    return held.where("outs <= 1").selectExpr("node_id", "CASE WHEN outs = 0 THEN 'unroutable' ELSE 'dead end' END AS kind")


_t0 = "greatest(0e0, least((4.1e0 - lon1) / nullif(lon2 - lon1, 0e0), (4.15e0 - lon1) / nullif(lon2 - lon1, 0e0)))"
_t1 = "least(1e0, greatest((4.1e0 - lon1) / nullif(lon2 - lon1, 0e0), (4.15e0 - lon1) / nullif(lon2 - lon1, 0e0)))"
portable("g12_g14_clip_to_band", fx.edges, "edges", {"edge_id": "edge_id", "share": f"round(greatest(0e0, {_t1} - {_t0}), 5)"}, where="kind = 0")
portable("g15_ellipse_contains", fx.nodes, "nodes", {"node_id": "node_id", "inside": "pow((lon - 4.15e0) / 0.1003e0, 2e0) + pow((lat - 52.15e0) / 0.0707e0, 2e0) <= 1e0"})
portable("g21_trimmed_edges", fx.edges, "edges", {"edge_id": "edge_id", "x": "round(lon1 + 0.2e0 * (lon2 - lon1), 8)", "y": "round(lat1 + 0.2e0 * (lat2 - lat1), 8)", "metres": "round(length * 0.55e0, 5)"})
portable("g04_heading_at_end", fx.edges, "edges", {"edge_id": "edge_id", "bearing": f"round({geo.heading('(lon1 + 0.7e0 * (lon2 - lon1))', '(lat1 + 0.7e0 * (lat2 - lat1))', 'lon2', 'lat2')}, 4)"})


@query("g20_w13_resampled_points", f"{WITH}, p AS (SELECT edge_id, lon1, lat1, lon2, lat2, length, unnest(generate_series(0, CAST(floor(length / 250e0) AS BIGINT))) AS k FROM edges) SELECT edge_id, k, round(lon1 + (lon2 - lon1) * k * 250e0 / length, 7) AS lon, round(lat1 + (lat2 - lat1) * k * 250e0 / length, 7) AS lat FROM p")
def resampled(spark, sf_dir):
    p = fx.edges(spark, sf_dir).selectExpr("edge_id", "lon1", "lat1", "lon2", "lat2", "length", "explode(sequence(0L, CAST(floor(length / 250e0) AS BIGINT))) AS k")
    return p.selectExpr("edge_id", "k", "round(lon1 + (lon2 - lon1) * k * 250e0 / length, 7) AS lon", "round(lat1 + (lat2 - lat1) * k * 250e0 / length, 7) AS lat")


@query("g23_tile_set_boundary", f"{WITH}, c AS (SELECT DISTINCT rw AS r, col AS c FROM nodes WHERE node_id % 6 <> 0), s AS (SELECT r, c, d, r + CASE d WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS r2, c + CASE d WHEN 2 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS c2 FROM c, (SELECT unnest([0, 1, 2, 3]) AS d)) SELECT s.r, s.c, CAST(s.d AS INT) AS side FROM s LEFT JOIN c o ON o.r = s.r2 AND o.c = s.c2 WHERE o.r IS NULL")
def tile_set_boundary(spark, sf_dir):
    c = fx.nodes(spark, sf_dir).where("node_id % 6 <> 0").selectExpr("rw AS r", "col AS c").distinct()
    sides = c.selectExpr("r", "c", "explode(array(0, 1, 2, 3)) AS side").selectExpr("r", "c", "side", "r + CASE side WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS r2", "c + CASE side WHEN 2 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS c2")
    return sides.join(c.selectExpr("r AS r2", "c AS c2"), ["r2", "c2"], "left_anti").select("r", "c", "side")


portable("r4_r8_verbal_text", lambda s, d: fx.table(s, d, "supplier"), "supplier", {"s_suppkey": "s_suppkey", "spoken": "regexp_replace(regexp_replace(CASE s_suppkey % 3 WHEN 0 THEN 'I ' || s_suppkey WHEN 1 THEN 'US ' || s_suppkey ELSE 'SR ' || s_suppkey END, '^I ', 'Interstate '), '^SR ', 'State Route ')", "quoted": "'\"' || s_name || '\"'"})


@query("n4_h12_level_ranges", "SELECT p_partkey, l AS level FROM (SELECT p_partkey, unnest(generate_series(p_partkey % 5, p_partkey % 5 + p_size % 4)) AS l FROM part)")
def level_ranges(spark, sf_dir):
    text = fx.table(spark, sf_dir, "part").selectExpr("p_partkey", "concat(p_partkey % 5, '-', p_partkey % 5 + p_size % 4) AS t")
    return text.selectExpr("p_partkey", "explode(sequence(CAST(split(t, '-')[0] AS BIGINT), CAST(split(t, '-')[1] AS BIGINT))) AS level")


@query("h5_name_dictionary", f"{WITH} SELECT street, dense_rank() OVER (ORDER BY street) AS idx FROM (SELECT DISTINCT street FROM edges)")
def name_dictionary(spark, sf_dir):
    return etl.dictionary(fx.edges(spark, sf_dir), "street")


@query("d5_d6_forks", f"{WITH} SELECT a.src AS node_id, a.edge_id AS first, b.edge_id AS second FROM edges a JOIN edges b ON b.src = a.src AND b.edge_id > a.edge_id WHERE least(abs(a.heading - b.heading), 360e0 - abs(a.heading - b.heading)) <= 100e0")
def forks(spark, sf_dir):
    # at most four edges meet at a node
    e = fx.edges(spark, sf_dir).select("src", "edge_id", "heading")
    both = e.alias("a").join(e.alias("b"), F.expr("b.src = a.src AND b.edge_id > a.edge_id"))
    return both.where("least(abs(a.heading - b.heading), 360e0 - abs(a.heading - b.heading)) <= 100e0").selectExpr("a.src AS node_id", "a.edge_id AS first", "b.edge_id AS second")


@query("d7_turn_lanes", f"{WITH} SELECT edge_id, CAST(len(list_filter([edge_id % 3, edge_id % 4, edge_id % 5], lambda x: x = 2)) AS INT) AS active FROM edges")
def turn_lanes(spark, sf_dir):
    return fx.edges(spark, sf_dir).selectExpr("edge_id", "size(filter(array(edge_id % 3, edge_id % 4, edge_id % 5), x -> x = 2)) AS active")


portable("k3_d9_markup", fx.edges, "edges", {"edge_id": "edge_id", "modifier": "(CASE edge_id % 8 WHEN 0 THEN 'straight' WHEN 1 THEN 'slight right' WHEN 2 THEN 'right' WHEN 3 THEN 'sharp right' WHEN 4 THEN 'uturn' WHEN 5 THEN 'sharp left' WHEN 6 THEN 'left' ELSE 'slight left' END)", "spoken": "'<b>' || street || '</b>'"})


@query("m8_interpolated_points", f"{WITH}, {TRACES}, k AS (SELECT trace_id, seq, lon, seq % 3 = 1 AS kept FROM traces), g AS (SELECT trace_id, seq, max(CASE WHEN kept THEN seq END) OVER (PARTITION BY trace_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS a, min(CASE WHEN kept THEN seq END) OVER (PARTITION BY trace_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM k) SELECT g.trace_id, g.seq, round(x.lon + (y.lon - x.lon) * (g.seq - g.a) / CAST(nullif(g.b - g.a, 0) AS DOUBLE), 7) AS lon FROM g JOIN k x ON x.trace_id = g.trace_id AND x.seq = g.a JOIN k y ON y.trace_id = g.trace_id AND y.seq = g.b WHERE g.a < g.b")
def interpolated(spark, sf_dir):
    kept = F.when(F.col("seq") % 3 == 1, F.struct("seq", "lon"))
    nearest = {name: F.last(kept, True).over(Window.partitionBy("trace_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) for name, order in (("a", F.asc("seq")), ("b", F.desc("seq")))}
    g = fx.traces(spark, sf_dir).select("trace_id", "seq", *(c.alias(name) for name, c in nearest.items()))
    return g.where("a.seq < b.seq").selectExpr("trace_id", "seq", "round(a.lon + (b.lon - a.lon) * (seq - a.seq) / CAST(b.seq - a.seq AS DOUBLE), 7) AS lon")


@query("e18_e19_transit_checks", f"WITH {DEPARTURES} SELECT line_id, count(*) AS departures, count(DISTINCT trip_id) AS trips, min(dep_secs) AS first FROM departures WHERE dep_secs BETWEEN 25200 AND 68400 AND elapsed > 100 GROUP BY line_id")
def transit_checks(spark, sf_dir):
    return fx.departures(spark, sf_dir).where("dep_secs BETWEEN 25200 AND 68400 AND elapsed > 100").groupBy("line_id").agg(F.count("*").alias("departures"), F.count_distinct("trip_id").alias("trips"), F.min("dep_secs").alias("first"))


@query("h4_h6_used_ids", f"{WITH} SELECT node_id FROM nodes WHERE node_id IN (SELECT src FROM edges WHERE {fl.accessible(2)}) AND node_id NOT IN (SELECT dst FROM edges WHERE toll)")
def used_ids(spark, sf_dir):
    e = fx.edges(spark, sf_dir)
    n = fx.nodes(spark, sf_dir).select("node_id")
    return n.join(e.where(fl.accessible(2)).select(F.col("src").alias("node_id")), "node_id", "left_semi").join(e.where("toll").select(F.col("dst").alias("node_id")), "node_id", "left_anti")
