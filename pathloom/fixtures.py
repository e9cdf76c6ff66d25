"""A deterministic road network over the relational tables, for queries and tests.

The same network is given as DataFrames and, in ``WITH``, as SQL common table expressions for the checks.
Customers are lattice nodes, neighbours in a row and in a column are joined by two directed edges, an even one there
and an odd one back; queries that follow a line one way take the even ones of a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions import geo


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession, sf_dir: str) -> int:
    """Nodes of a lattice row; a count that parquet answers from its footers."""
    return max(1, int(table(spark, sf_dir, "customer").count() ** 0.5))


def _node_columns(w: str) -> list[tuple[str, str]]:
    return [
        ("node_id", "c_custkey"),
        ("col", f"c_custkey % {w}"),
        ("rw", f"CAST(floor(c_custkey / CAST({w} AS DOUBLE)) AS BIGINT)"),
        ("lon", f"4e0 + 0.01e0 * (c_custkey % {w})"),
        ("lat", f"52e0 + 0.01e0 * floor(c_custkey / CAST({w} AS DOUBLE))"),
        ("admin_id", "c_nationkey"),
        ("elevation", "c_acctbal / 10e0"),
        ("name", "c_name"),
    ]


#: The attributes of an edge from its id, ends and the begin node's admin.
_EDGE_COLUMNS = [
    ("length", f"CAST(round({geo.haversine('lon1', 'lat1', 'lon2', 'lat2')}) AS DOUBLE)"),
    ("road_class", "src % 8"),
    ("speed", "30 + 10 * ((src + dst) % 8)"),
    ("toll", "src % 11 = 0"),
    ("access", "(CASE edge_id % 7 WHEN 0 THEN 7 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 5 WHEN 4 THEN 15 WHEN 5 THEN 2 ELSE 9 END)"),
    ("surface", "edge_id % 8"),
    ("density", "admin_id % 16"),
    ("use", "edge_id % 13"),
    ("way_id", "CAST(floor(src / 4e0) AS BIGINT)"),
    ("street", "'Street ' || CAST(CASE WHEN kind = 0 THEN rw1 ELSE 100 + col1 END AS VARCHAR(20))"),
    ("heading", f"round({geo.heading('lon1', 'lat1', 'lon2', 'lat2')}, 6)"),
]

_W = "(SELECT CAST(floor(sqrt(count(*))) AS BIGINT) FROM customer)"
_NODE_SQL = ", ".join(f"{e} AS {n}" for n, e in _node_columns(_W))
_EDGE_SQL = ", ".join(f"{e} AS {n}" for n, e in _EDGE_COLUMNS)

WITH = f"""WITH RECURSIVE nodes AS (SELECT {_NODE_SQL} FROM customer),
pairs AS (SELECT a.node_id AS a, b.node_id AS b, k.kind FROM nodes a, (SELECT 0 AS kind UNION ALL SELECT 1) k, nodes b
  WHERE (k.kind = 0 AND b.node_id = a.node_id + 1 AND b.rw = a.rw) OR (k.kind = 1 AND b.node_id = a.node_id + {_W})),
directed AS (SELECT 4 * a + 2 * kind AS edge_id, a AS src, b AS dst, kind FROM pairs UNION ALL SELECT 4 * a + 2 * kind + 1, b, a, kind FROM pairs),
placed AS (SELECT d.*, s.lon AS lon1, s.lat AS lat1, s.col AS col1, s.rw AS rw1, e.lon AS lon2, e.lat AS lat2, s.admin_id FROM directed d JOIN nodes s ON s.node_id = d.src JOIN nodes e ON e.node_id = d.dst),
edges AS (SELECT placed.*, {_EDGE_SQL} FROM placed)
"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = width(spark, sf_dir)
    return table(spark, sf_dir, "customer").selectExpr(*(f"{e} AS {n}" for n, e in _node_columns(str(w))))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = width(spark, sf_dir)
    held = nodes(spark, sf_dir)
    ends = held.select(F.col("node_id").alias("b"), F.col("rw").alias("rw_b"), F.col("lon").alias("lon_b"), F.col("lat").alias("lat_b"), F.col("col").alias("col_b"), F.col("admin_id").alias("admin_b"))
    pairs = (
        held.withColumn("kind", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("b", F.when(F.col("kind") == 0, F.col("node_id") + 1).otherwise(F.col("node_id") + w))
        .join(ends, "b")
        .where("kind = 1 OR rw = rw_b")
    )
    there = "struct(4 * node_id + 2 * kind AS edge_id, node_id AS src, b AS dst, lon AS lon1, lat AS lat1, col AS col1, rw AS rw1, lon_b AS lon2, lat_b AS lat2, admin_id)"
    back = "struct(4 * node_id + 2 * kind + 1 AS edge_id, b AS src, node_id AS dst, lon_b AS lon1, lat_b AS lat1, col_b AS col1, rw_b AS rw1, lon AS lon2, lat AS lat2, admin_b AS admin_id)"
    both = pairs.selectExpr("kind", f"explode(array({there}, {back})) AS e").select("e.edge_id", "e.src", "e.dst", "kind", "e.lon1", "e.lat1", "e.col1", "e.rw1", "e.lon2", "e.lat2", "e.admin_id")
    return both.selectExpr("*", *(f"{e} AS {n}" for n, e in _EDGE_COLUMNS))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query points: suppliers over the lattice."""
    w = width(spark, sf_dir)
    return table(spark, sf_dir, "supplier").selectExpr(*(f"{e} AS {n}" for n, e in _point_columns(str(w))))


def _point_columns(w: str) -> list[tuple[str, str]]:
    return [("pt_id", "s_suppkey"), ("lon", f"4e0 + CAST(s_suppkey * 37 % (100 * {w}) AS DOUBLE) / 10000e0"), ("lat", f"52e0 + CAST(s_suppkey * 53 % (100 * {w}) AS DOUBLE) / 10000e0")]


POINTS = "points AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _point_columns(_W)) + " FROM supplier)"

_TRACE = "user_id AS trace_id, {rank} AS seq, event_id, ts, value, event_type"
_TRACE_PLACE = [
    ("lon", "4e0 + 0.01e0 * ((trace_id * 13 + seq) % {w}) + (value - 10e0 * floor(value / 10e0) - 5e0) * 0.0001e0"),
    ("lat", "52e0 + 0.01e0 * (trace_id % CAST(floor({n} / CAST({w} AS DOUBLE)) AS BIGINT)) + (value - 10e0 * floor(value / 10e0) - 5e0) * 0.0001e0"),
]
_N = "(SELECT count(*) FROM customer)"
TRACES = (
    "ordered AS (SELECT user_id AS trace_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id, ts, value, event_type FROM events), traces AS (SELECT trace_id, seq, event_id, ts, value, event_type, "
    + ", ".join(f"{e.format(w=_W, n=_N)} AS {n}" for n, e in _TRACE_PLACE)
    + " FROM ordered)"
)


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GPS points: each user's events in order, jittered around a lattice row."""
    w, n = width(spark, sf_dir), table(spark, sf_dir, "customer").count()
    ordered = table(spark, sf_dir, "events").selectExpr("user_id AS trace_id", "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq", "event_id", "ts", "value", "event_type")
    return ordered.selectExpr("*", *(f"{e.format(w=w, n=n)} AS {name}" for name, e in _TRACE_PLACE))


DEPARTURES = "departures AS (SELECT l_suppkey AS line_id, (l_orderkey * 37 + l_linenumber * 911) % 86400 AS dep_secs, CAST(60 + 10 * l_quantity AS BIGINT) AS elapsed, l_partkey % 128 AS dow_mask, l_orderkey AS trip_id, l_linenumber AS line_no FROM lineitem)"
ASKED = "asked AS (SELECT event_id AS req_id, event_id % (SELECT count(*) FROM supplier) AS line_id, CAST(extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + floor(extract(second FROM ts)) AS BIGINT) AS t_secs, dayofweek(ts) + {dow} AS dow FROM events)"


def departures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS line_id", "(l_orderkey * 37 + l_linenumber * 911) % 86400 AS dep_secs", "CAST(60 + 10 * l_quantity AS BIGINT) AS elapsed", "l_partkey % 128 AS dow_mask", "l_orderkey AS trip_id", "l_linenumber AS line_no")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Departure requests: line, second of the day and weekday (Sunday 0) of each event."""
    n = table(spark, sf_dir, "supplier").count()
    return table(spark, sf_dir, "events").selectExpr("event_id AS req_id", f"event_id % {n} AS line_id", "CAST(hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) AS BIGINT) AS t_secs", "dayofweek(ts) - 1 AS dow")
