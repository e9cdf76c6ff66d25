"""Streaming extensions over the events table, and codecs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom import fixtures as fx
from pathloom.fixtures import WITH
from pathloom.registry import query
from pathloom.streaming import live


def _source(sf_dir: str) -> str:
    return f"{sf_dir}/events.parquet*"  # a stream reads a folder or a pattern, not one file


@query("y1_tumbling_speed_buckets", "WITH b AS (SELECT CAST(floor(epoch(ts) / 300e0) * 300 AS BIGINT) AS start, user_id, value FROM events), m AS (SELECT floor(epoch(max(ts)) * 1000) / 1000 - 600 AS mark FROM events) SELECT start, user_id, count(*) AS n, round(sum(value), 4) AS total FROM b WHERE start + 300 <= (SELECT mark FROM m) GROUP BY start, user_id")
def tumbling(spark, sf_dir):
    return live.run_to_end(spark, _source(sf_dir), live.bucket_means)


@query("y2_session_windows", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT CAST(floor(epoch(min(ts))) AS BIGINT) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k")
def session_windows(spark, sf_dir):
    return live.sessions(fx.table(spark, sf_dir, "events"))


@query("y3_latest_per_key", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest(spark, sf_dir):
    return live.latest_state(spark, _source(sf_dir)).select("user_id", "event_id", "value")


@query("y4_custom_state", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def custom_state(spark, sf_dir):
    return live.run_to_end(spark, _source(sf_dir), live.running_counts, "update").groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("total", "n").alias("total"))


@query("y_dedupe_within_watermark", "SELECT event_id, user_id FROM events")
def dedupe(spark, sf_dir):
    return live.run_to_end(spark, _source(sf_dir), live.first_of_each)


@query("g30_polyline_round_trip", f"{WITH} SELECT rw AS line, count(*) AS points, round(sum(lon), 4) AS lon, round(sum(lat), 4) AS lat FROM nodes GROUP BY rw")
def polylines(spark, sf_dir):
    from pathloom.functions.codec import points_of, polyline_of

    shape = fx.nodes(spark, sf_dir).groupBy(F.col("rw").alias("line")).agg(F.sort_array(F.collect_list(F.struct("col", "lon", "lat"))).alias("s"))
    text = shape.select("line", polyline_of(F.transform("s", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))).alias("t"))
    back = text.select("line", F.explode(points_of("t")).alias("p"))
    return back.groupBy("line").agg(F.count("*").alias("points"), F.round(F.sum("p.lon"), 4).alias("lon"), F.round(F.sum("p.lat"), 4).alias("lat"))


@query("g31_h3_zigzag_and_deltas", f"{WITH} SELECT node_id, CASE WHEN d < 0 THEN -2 * d - 1 ELSE 2 * d END AS z, d AS back FROM (SELECT node_id, CAST(round((elevation - 450e0) * 4e0) AS BIGINT) AS d FROM nodes)")
def zigzags(spark, sf_dir):
    from pathloom.functions.codec import unzigzag, zigzag

    d = fx.nodes(spark, sf_dir).selectExpr("node_id", "CAST(round((elevation - 450e0) * 4e0) AS BIGINT) AS d").selectExpr("node_id", f"{zigzag('d')} AS z")
    return d.selectExpr("node_id", "z", f"{unzigzag('z')} AS back")


@query("g32_k18_base64", "SELECT p_partkey, to_base64(p_name::BLOB) AS coded, p_name AS back FROM part")
def base64(spark, sf_dir):
    return fx.table(spark, sf_dir, "part").select("p_partkey", F.base64(F.col("p_name").cast("binary")).alias("coded"), F.unbase64(F.base64(F.col("p_name").cast("binary"))).cast("string").alias("back"))


@query("g17_generalised_shapes")
def generalised(spark, sf_dir):
    import pandas as pd

    from pathloom.functions.codec import simplify

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        kept = simplify(list(zip(rows["lon"], rows["lat"], strict=True)), 0.01)
        return pd.DataFrame({"trace_id": [rows["trace_id"].iloc[0]], "points": [len(rows)], "kept": [len(kept)]})

    return fx.traces(spark, sf_dir).select("trace_id", "seq", "lon", "lat").groupBy("trace_id").applyInPandas(run, "trace_id long, points long, kept long")


@query("a13_g37_smallest_circle")
def circles(spark, sf_dir):
    import pandas as pd

    from pathloom.functions.codec import smallest_circle

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x, y, r = smallest_circle(list(zip(rows["lon1"], rows["lat1"], strict=True)))
        return pd.DataFrame({"way_id": [rows["way_id"].iloc[0]], "x": [round(x, 9)], "y": [round(y, 9)], "r": [round(r, 9)]})

    return fx.edges(spark, sf_dir).select("way_id", "lon1", "lat1").groupBy("way_id").applyInPandas(run, "way_id long, x double, y double, r double")
