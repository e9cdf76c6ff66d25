"""Cost models by hand, searches and matching against brute force, places near the poles and the date line, long keys."""

import heapq
import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.functions import geo, speeds
from pathloom.operators import costing, etl, guidance, matching, paths, spatial, transit
from pathloom.operators.costing import Options
from pathloom.plans import planner
from pathloom.sources import lines, speeds as tables

EDGE = {"length": 1000, "speed": 50, "road_class": 4, "surface": 1, "density": 0, "toll": False, "use": 0}
#: (model, what differs from a plain kilometre of paved tertiary road at 50 km/h, options, cost and seconds by hand)
BY_HAND = [
    ("auto", {}, {}, 72 * 0.85, 72.0),
    ("auto", {"use": 12}, {}, 72.0, 72.0),
    ("auto", {"use": 11}, {}, 72 * 2.8, 72.0),  # 10 - 18 * 0.4
    ("auto", {"use": 12}, {"use_ferry": 0.0}, 720.0, 72.0),
    ("auto", {"use": 3, "surface": 4}, {}, 72 * (0.85 + 0.2) * 4, 72.0),
    ("auto", {"use": 10}, {}, 72 * 0.85 * 2.6, 72.0),  # 3 - 2 * 0.1 * 2
    ("auto", {"use": 2, "measured": True}, {}, 72 * 0.85 * 0.6, 72.0),
    ("auto", {"closed": True}, {}, 72 * 0.85 * 9, 72.0),
    ("auto", {"toll": True, "road_class": 0}, {"use_tolls": 0.0, "use_highways": 0.0}, 72 * (0.85 + 8 + 4), 72.0),
    ("auto", {"road_class": 1}, {"use_highways": 1.0}, 72 * (0.85 - 0.125 * 0.5), 72.0),
    ("auto", {"speed": 100}, {"top_speed": 80.0}, 45 * (0.85 + 20 * 0.05), 45.0),
    ("auto", {}, {"fixed_speed": 20.0}, 180 * 0.85, 180.0),
    ("auto", {"density": 8}, {"use_distance": 0.5}, (72 * 0.5 + 1000 * 0.5 / 16) * 1.05, 72.0),
    ("taxi", {"density": 15}, {}, 72 * 1.225 * 0.85, 72.0),
    ("truck", {}, {}, 72 * 0.85, 72.0),
    ("truck", {"road_class": 6}, {}, 72 * (0.85 + 1.5), 72.0),
    ("truck", {"truck_route": True, "truck_speed": 40}, {}, 90 * 0.85 * 0.85, 90.0),
    ("truck", {"use": 12, "toll": True, "road_class": 7}, {"use_tolls": 0.25, "use_truck_route": 0.5}, 72 * (2.0 + 1.0), 72.0),
    ("truck", {"use": 10}, {}, 72 * 0.85 * 3, 72.0),
    ("motorcycle", {"use": 12, "toll": True, "surface": 5}, {}, 72.0, 72.0),
    ("motorcycle", {"surface": 3}, {}, 72 * (0.85 + 8 * 0.1), 72.0),
    ("motorcycle", {"surface": 5, "toll": True}, {"use_trails": 0.5, "use_tolls": 0.0}, 72 * (0.85 + 2), 72.0),
    ("motor_scooter", {}, {}, 80 * (1 + 0.05 + 0.5 * 0.05 + 5 * 0.05), 80.0),
    ("motor_scooter", {"grade": 15, "surface": 2, "speed": 30, "dest_only": True}, {}, 600 * (1 + 0.05 + 0.5 * 10 + 0.2), 600.0),  # 30 * 0.9 * 0.25 is 6
    ("bicycle", {"use": 9}, {}, 3600 * 8.0, 3600.0),
    ("bicycle", {}, {}, 200 * (1 + 0.75 * 0.05 + 1.075 * (1 + (50 / 25 - 0.6 - 1) * 0.8125)), 200.0),
    ("bicycle", {"use": 8, "cycle_lane": 3}, {}, 200 * (1 + 0.0375 + 0.2), 200.0),
    ("bicycle", {"grade": 12, "surface": 4, "use": 10, "bike_network": True}, {}, 720 * (1 + 0.75 * 4.5 + 0.95 * 0.4 + 0.25), 720.0),  # 18 * 0.6 * 0.5 + 0.5 is 5
    ("bicycle", {"dismount": True, "lanes": 3, "truck_route": True, "use_sidepath": True, "speed": 40, "road_class": 6}, {}, 720 * (1 + 0.0375 + 3.25 * 1.65), 720.0),
    ("pedestrian", {}, {}, 3600 / 5.1, 3600 / 5.1),
    ("pedestrian", {"use": 5}, {}, 3600 / 5.1 * 2, 3600 / 5.1),
    ("pedestrian", {"use": 12}, {}, 36.0, 72.0),
    ("pedestrian", {"grade": 15, "sac_scale": 2}, {}, 3600 / 5.1 * 1.25 * 2.5 * (1 + 0.75 + 2.5), 3600 / 5.1 * 1.25 * 2.5),
    ("pedestrian", {"roundabout": True, "lit": False}, {"use_lit": 1.0}, 3600 / 5.1 * 2 * 8, 3600 / 5.1),
    ("pedestrian", {"roundabout": True, "sidewalk": True}, {"sidewalk_factor": 0.5}, 3600 / 5.1 * 0.5, 3600 / 5.1),
    ("pedestrian", {"use": 10}, {}, 3600 / 5.1 * 0.96, 3600 / 5.1),
    ("none", {}, {}, 0.0, 0.0),
]


def test_cost_models_by_hand(spark):
    one = spark.range(1)
    columns = []
    for k, (model, own, options, _, _) in enumerate(BY_HAND):
        values = {n: str(v).upper() if isinstance(v, bool) else str(v) for n, v in (EDGE | own).items()}
        cost, secs = costing.edge_cost(model, Options(options), values)
        columns += [f"CAST({cost} AS DOUBLE) AS c{k}", f"CAST({secs} AS DOUBLE) AS s{k}"]
    row = one.selectExpr(*columns).first()
    for k, (model, own, options, cost, secs) in enumerate(BY_HAND):
        assert (row[f"c{k}"], row[f"s{k}"]) == pytest.approx((cost, secs), rel=1e-9), (model, own, options)


def test_transit_weights_by_hand(spark):
    rows = {}
    for name, o in (("default", Options()), ("bus", Options({"use_bus": 1.0, "use_rail": 0.0}))):
        for vehicle in ("bus", "rail", "ferry"):
            rows[name, vehicle] = spark.range(1).selectExpr(f"CAST({costing.transit_cost('60', '600', repr(vehicle), o)[0]} AS DOUBLE) AS c").first()["c"]
    assert rows["default", "rail"] == 660 and rows["default", "ferry"] == 660 and rows["default", "bus"] == pytest.approx(60 + 600 * 2.6 * 2.6 / 0.9)
    assert rows["bus", "bus"] == 660 and rows["bus", "rail"] == pytest.approx(60 + 600 * 5 * 5 / 0.5)


def _network(seed=3, n=60, m=260):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n), float(rng.randint(1, 40)), k, float(rng.randint(50, 400))) for k in range(m)]


def _least(arcs, source):
    least, heap = {source: 0.0}, [(0.0, source)]
    while heap:
        c, x = heapq.heappop(heap)
        if c > least[x]:
            continue
        for a, b, w, *_ in arcs:
            if a == x and c + w < least.get(b, 1e18):
                least[b] = c + w
                heapq.heappush(heap, (c + w, b))
    return least


@pytest.mark.parametrize("held", [True, False])
def test_paths_between_by_brute_force(spark, monkeypatch, held):
    if not held:
        monkeypatch.setattr(paths, "CSR_EDGES", 10)
    arcs = _network()
    df = spark.createDataFrame(arcs, "src long, dst long, cost double, arc long, length double")
    rng = random.Random(1)
    trips = [(k, rng.randrange(60), rng.randrange(60)) for k in range(25)] + [(90, 5, 5), (91, 5, 999)]
    want = {k: _least(arcs, a).get(b) for k, a, b in trips}
    rows = paths.between(df, spark.createDataFrame(trips, "trip_id long, origin long, destination long")).collect()
    by_arc = {a[3]: a for a in arcs}
    for k, a, b in trips:
        own = sorted((r for r in rows if r["trip_id"] == k), key=lambda r: r["seq"])
        if want[k] is None or a == b:
            assert not own
            continue
        x, total = a, 0.0
        for r in own:
            src, dst, cost, *_ = by_arc[r["arc"]]
            assert src == x
            x, total = dst, total + cost
            assert r["cost"] == pytest.approx(total)
        assert x == b and total == want[k]


def test_search_from_both_ends_stops_early():
    n = 40
    arcs = [(x * n + y, (x + dx) * n + y + dy, 1.0, 0) for x in range(n) for y in range(n) for dx, dy in ((0, 1), (1, 0), (0, -1), (-1, 0)) if 0 <= x + dx < n and 0 <= y + dy < n]
    src, dst, cost, _ = (np.array(c) for c in zip(*arcs, strict=True))
    g = paths.Graph(src, dst, cost, np.arange(len(arcs)), np.ones(len(arcs)))
    found = g.between(g.find(20 * n + 15), g.find(20 * n + 24))
    assert found[0] == 9 and found[2] < 150  # of 1600 nodes


@pytest.mark.parametrize("held", [True, False])
def test_costs_and_matrix_by_brute_force(spark, monkeypatch, held):
    if not held:
        monkeypatch.setattr(paths, "CSR_EDGES", 10)
    monkeypatch.setattr(paths, "SOURCES", 3)
    arcs = _network(5)
    df = spark.createDataFrame(arcs, "src long, dst long, cost double, arc long, length double")
    sources = spark.createDataFrame([(k, 7 * k % 60) for k in range(10)], "source long, node long")
    want = {k: _least(arcs, 7 * k % 60) for k in range(10)}
    if held:
        got = {(r["source"], r["node"]): r["cost"] for r in paths.costs_from(df, sources).collect()}
        assert got == {(k, x): c for k in want for x, c in want[k].items()}
        near = {(r["source"], r["node"]): r["cost"] for r in paths.costs_from(df, sources, 30.0).collect()}
        assert near == {k: c for k, c in got.items() if c <= 30}
    targets = spark.createDataFrame([(k, 11 * k % 61) for k in range(8)], "target long, node long")
    found = {(r["source"], r["target"]): r["cost"] for r in paths.matrix(df, sources, targets).collect()}
    assert found == {(k, t): want[k].get(11 * t % 61) for k in range(10) for t in range(8)}


def test_alternates_pass_every_limit(spark):
    rng = random.Random(2)
    n, arcs = 12, []
    for x, y in itertools.product(range(n), range(n)):
        for dx, dy in ((0, 1), (1, 0), (0, -1), (-1, 0)):
            if 0 <= x + dx < n and 0 <= y + dy < n:
                arcs.append((x * n + y, (x + dx) * n + y + dy, float(rng.randint(40, 60)), len(arcs), 100.0))
    df = spark.createDataFrame(arcs, "src long, dst long, cost double, arc long, length double")
    trips = [(1, 0, 143), (2, 11, 132), (3, 5, 5), (4, 0, 1)]
    rows = paths.alternates(df, spark.createDataFrame(trips, "trip_id long, origin long, destination long"), 3).collect()
    by_arc = {a[3]: a for a in arcs}
    for trip, a, b in trips[:2]:
        own = sorted((r for r in rows if r["trip_id"] == trip), key=lambda r: r["rank"])
        assert len(own) == 4 and own[0]["cost"] == _least(arcs, a)[b]
        for k, r in enumerate(own):
            nodes = [a] + [by_arc[x][1] for x in r["arcs"]]
            assert [by_arc[x][0] for x in r["arcs"]] == nodes[:-1] and nodes[-1] == b and len(set(nodes)) == len(nodes)
            assert sum(by_arc[x][2] for x in r["arcs"]) == r["cost"] and own[max(k - 1, 0)]["cost"] <= r["cost"] < own[0]["cost"] * paths.longest_stretch(own[0]["cost"])
            for other in own[:k]:
                assert 100.0 * len(set(r["arcs"]) & set(other["arcs"])) <= 0.75 * other["length"]
    assert not [r for r in rows if r["trip_id"] == 3]
    assert paths.longest_stretch(599) == 2.0 and paths.longest_stretch(20000) == 1.25 and paths.longest_stretch(3600) == pytest.approx(1.4, abs=0.01)


@pytest.mark.parametrize("lon,lat", [(10.0, 0.0), (10.0, 61.0), (10.0, 78.0), (-40.0, -85.0), (179.99, 52.0), (-179.995, 70.0), (0.0, 89.5)])
def test_edges_at_any_latitude_and_over_the_date_line(spark, lon, lat):
    rng = random.Random(lat)
    turn = lambda x: (x + 540) % 360 - 180
    wide = 0.09 / max(0.005, math.cos(math.radians(lat)))
    edges = []
    for k in range(60):
        x, y = lon + rng.uniform(-wide, wide), max(-89.9, min(89.9, lat + rng.uniform(-0.09, 0.09)))
        edges.append((k, turn(x), y, turn(x + rng.uniform(-0.2, 0.2) * wide), max(-89.9, min(89.9, y + rng.uniform(-0.02, 0.02)))))
    df = spark.createDataFrame(edges, "edge_id long, lon1 double, lat1 double, lon2 double, lat2 double")
    point = spark.createDataFrame([(1, turn(lon), lat)], "pt_id long, lon double, lat double")

    def metres(a, b, c, d):
        h = math.sin(math.radians(d - b) / 2) ** 2 + math.cos(math.radians(b)) * math.cos(math.radians(d)) * math.sin(math.radians(turn(c - a)) / 2) ** 2
        return 2 * geo.EARTH_METERS * math.asin(min(1, math.sqrt(h)))

    want = {}
    for k, x1, y1, x2, y2 in edges:
        x2, px = x1 + turn(x2 - x1), x1 + turn(turn(lon) - x1)
        c = math.cos(math.radians(lat))
        bx, by = (x2 - x1) * c, y2 - y1
        t = max(0.0, min(1.0, ((px - x1) * c * bx + (lat - y1) * by) / (bx * bx + by * by)))
        want[k] = metres(px, lat, x1 + t * (x2 - x1), y1 + t * (y2 - y1))
    got = {r["edge_id"]: r["metres"] for r in spatial.edges_within(point, df, 4000.0).collect()}
    assert got.keys() == {k for k, m in want.items() if m <= 4000}
    assert all(got[k] == pytest.approx(want[k], abs=1e-3) for k in got)
    best = [r["edge_id"] for r in spatial.nearest_edges(point, df, 3, 50.0).orderBy("rank").collect()]
    assert best == sorted((k for k in want if want[k] <= 35000), key=lambda k: (round(want[k], 3), k))[:3]


def test_departures_of_one_long_line(spark):
    rng = random.Random(4)
    departures = [(1, rng.randrange(86400), rng.randrange(128), k, 0) for k in range(60_000)]
    asks = [(k, 1, rng.randrange(86400), rng.randrange(7)) for k in range(60_000)]
    d = spark.createDataFrame(departures, "line_id long, dep_secs long, dow_mask long, trip_id long, line_no long")
    began = time.time()
    got = {r["req_id"]: (r["dep_secs"], r["trip_id"]) for r in transit.next_departure(spark.createDataFrame(asks, "req_id long, line_id long, t_secs long, dow long"), d).collect()}
    assert time.time() - began < 60
    by_day = [sorted((at, trip) for _, at, mask, trip, _ in departures if mask >> day & 1) for day in range(7)]
    import bisect

    for k, _, at, day in asks[:3000]:
        p = bisect.bisect_left(by_day[day], (at, -1))
        assert got.get(k) == (by_day[day][p] if p < len(by_day[day]) else None)


def test_k_best_sequences(spark):
    rng = random.Random(6)
    rows, emission, move = [], {}, {}
    for trace in range(3):
        for t in range(5):
            for s in range(3):
                emission[trace, t, s] = float(rng.randint(0, 9))
                if t == 0:
                    rows.append((trace, t, s, emission[trace, t, s], None, 0.0))
                for b in range(3 if t else 0):
                    if rng.random() < 0.85:
                        move[trace, t, b, s] = float(rng.randint(0, 9))
                        rows.append((trace, t, s, emission[trace, t, s], b, move[trace, t, b, s]))
    df = spark.createDataFrame(rows, "trace_id long, time long, state long, emission double, before long, transition double")
    got = {}
    for r in matching.k_best(df, 4).collect():
        got.setdefault(r["trace_id"], []).append((r["rank"], r["cost"], tuple(r["states"])))
    for trace in range(3):
        ways = []
        for path in itertools.product(range(3), repeat=5):
            if all((trace, t, path[t - 1], path[t]) in move for t in range(1, 5)):
                ways.append((sum(emission[trace, t, s] for t, s in enumerate(path)) + sum(move[trace, t, path[t - 1], path[t]] for t in range(1, 5)), path))
        assert sorted(got.get(trace, [])) == [(n, c, p) for n, (c, p) in enumerate(sorted(ways)[:4], 1)]


def test_matched_sequences_can_be_driven(spark):
    """A parallel road that lies nearer to one point but can't be reached is left out."""
    from pathloom.plans.actor import Actor

    nodes = [(k, 4.0 + 0.001 * k, 52.0) for k in range(5)] + [(10, 4.0015, 52.0003), (11, 4.0025, 52.0003)]
    at = {n: (x, y) for n, x, y in nodes}
    pairs = [(0, 1), (1, 2), (2, 3), (3, 4), (10, 11)]
    edges = [(k, a, b, *at[a], *at[b], 70.0, 50, "s") for k, (a, b) in enumerate(pairs)]
    e = spark.createDataFrame(edges, "edge_id long, src long, dst long, lon1 double, lat1 double, lon2 double, lat2 double, length double, speed long, street string")
    actor = Actor(spark.createDataFrame(nodes, "node_id long, lon double, lat double"), e)
    trace = spark.createDataFrame([(1, k, 4.0005 + 0.001 * k, 52.0 + (0.00016 if k in (1, 2) else 0.0)) for k in range(4)], "trace_id long, seq long, lon double, lat double")
    got = [r["state"] for r in actor.trace_route(trace).orderBy("time").collect()]
    assert got == [0, 1, 2, 3]


def test_gapless_numbers(spark):
    values = [(f"n{k % 37}",) for k in range(200)] + [(None,)]
    got = {r["name"]: r["idx"] for r in etl.dictionary(spark.createDataFrame(values, "name string"), "name").collect()}
    assert got == {v: k for k, v in enumerate(sorted({f"n{k}" for k in range(37)}), 1)}
    assert etl.dictionary(spark.createDataFrame([], "name string"), "name").count() == 0


def test_collapsed_maneuvers(spark):
    rows = [(1, 1, "a", 5.0), (1, 2, "b", 50.0), (1, 3, "c", 4.0), (1, 4, "d", 3.0), (1, 5, "e", 60.0), (2, 1, "x", 1.0), (2, 2, "y", 2.0)]
    got = sorted(tuple(r) for r in guidance.collapse(spark.createDataFrame(rows, "trip_id long, island long, street string, metres double"), 10.0).collect())
    assert got == [(1, 2, "b", 62.0, 4), (1, 5, "e", 60.0, 1), (2, 1, "x", 1.0, 1), (2, 2, "y", 2.0, 1)]


def test_bad_line_texts_give_no_rows(spark):
    df = spark.createDataFrame([(1, '{"type":"LineString","coordinates":[[1.5,2.5],[3,4]]}'), (2, "no json"), (3, '{"type":"Point","coordinates":[1,2]}'), (4, None)], "line long, text string")
    assert sorted(tuple(r) for r in lines.geojson_points(df).collect()) == [(1, 0, 1.5, 2.5), (1, 1, 3.0, 4.0)]
    assert tables.parse_speed_table(spark.createDataFrame([("not json",), (None,)], "text string")).count() == 0


def test_encoded_speeds_decode_again(spark):
    rng = random.Random(3)
    buckets = [float(rng.randint(20, 90)) for _ in range(64)]
    df = spark.createDataFrame([(buckets,)], "b array<double>")
    coefficients = [r["c"] for r in df.selectExpr("b", "explode(sequence(0, 63)) AS k").selectExpr("k", f"{speeds.dct_coefficient('b', 'k')} AS c").orderBy("k").collect()]
    back = [math.sqrt(2 / 64) * sum(c * (0.707106781 if k == 0 else math.cos(math.pi / 64 * (i + 0.5) * k)) for k, c in enumerate(coefficients)) for i in range(64)]
    assert max(abs(a - b) for a, b in zip(back, buckets, strict=True)) < 2


def test_settings_are_merged():
    assert planner.match_config("pedestrian", {"beta": 9.0, "other": 1.0}) == {"sigma_z": 4.07, "beta": 9.0, "breakage_distance": 2000.0, "search_radius": 50.0, "interpolation_distance": 10.0, "turn_penalty_factor": 100.0}
    assert planner.merged({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"c": 5}, "e": 6}) == {"a": {"b": 1, "c": 5}, "d": 3, "e": 6}
    assert planner.merged({"a": {"b": 1}}, {"a": 7}) == {"a": 7}


def test_planar_distance_by_hand(spark):
    row = spark.range(1).selectExpr(f"{geo.planar2('4e0', '60e0', '4.01e0', '60e0')} AS east", f"{geo.planar2('4e0', '60e0', '4e0', '60.02e0')} AS north").first()
    assert row["east"] == pytest.approx((0.01 * 110567 * 0.5) ** 2, rel=1e-9) and row["north"] == pytest.approx((0.02 * 110567) ** 2, rel=1e-9)


def test_noise_is_nearly_normal(spark):
    x, y = geo.noisy("0e0", "0e0", 5.0, "id")
    row = spark.range(20_000).selectExpr(f"{x} * 110567e0 AS x", f"{y} * 110567e0 AS y").agg(F.avg("x"), F.stddev("x"), F.avg("y"), F.stddev("y"), F.corr("x", "y")).first()
    assert abs(row[0]) < 0.2 and abs(row[2]) < 0.2 and 4.5 < row[1] < 5.5 and 4.5 < row[3] < 5.5 and abs(row[4]) < 0.05


@pytest.mark.parametrize("points", [5, 10_000])
def test_traces_matched_in_tasks_are_those_of_the_joins(spark, monkeypatch, points):
    """Gaps, jumps, points off the roads, nulls, edges over the date line and attributes that are null."""
    from pathloom.operators import roads
    from pathloom.plans.actor import Actor

    monkeypatch.setattr(roads, "POINTS", points)
    rng = random.Random(6)
    place = {r * 12 + c: (179.99 + 0.002 * c - (360 if 179.99 + 0.002 * c > 180 else 0), 10.0 + 0.002 * r) for r in range(9) for c in range(12)}
    ends = [(x, y) for x in place for y in (x + 1, x + 12) if y in place and (y != x + 1 or y % 12)]
    rows = []
    for k, (x, y) in enumerate([*ends, *((y, x) for x, y in ends)]):
        if rng.random() < 0.85:
            rows.append((5 * k, x, y, *place[x], *place[y], 222.0 + k % 7, f"s{k % 5}" if k % 6 else None, k % 3))
    edges = spark.createDataFrame(rows, "edge_id long, src long, dst long, lon1 double, lat1 double, lon2 double, lat2 double, length double, street string, road_class int")
    points = []
    for t in range(8):
        for k in range(30):
            lon, lat = 179.99 + 0.0007 * k + rng.uniform(-3e-4, 3e-4), 10.0 + 0.002 * t + rng.uniform(-4e-4, 4e-4)
            if k % 11 == 10:
                lat += 0.5
            if (t, k) not in ((2, 7), (3, 15)):
                points.append((t, k, lon - 360 if lon > 180 else lon, None if (t, k) == (4, 9) else lat))
    traces = spark.createDataFrame(points, "trace_id long, seq long, lon double, lat double")
    actor = Actor(edges, edges)
    joined = actor._joined_route(traces, 100.0, 2000.0).join(edges.selectExpr("edge_id AS state", "street", "road_class"), "state")
    want = {(r["trace_id"], r["time"]): r for r in joined.collect()}
    monkeypatch.setattr(Actor, "_joined_route", lambda *_: pytest.fail("traces were joined"))
    found = actor.trace_attributes(traces, ["street", "road_class"])
    got = {(r["trace_id"], r["time"]): r for r in found.collect()}
    assert found.columns == joined.columns and len(got) > 150 and got.keys() == want.keys()
    for k, r in got.items():
        assert (r["state"], r["street"], r["road_class"]) == (want[k]["state"], want[k]["street"], want[k]["road_class"])
        assert r["cost"] == pytest.approx(want[k]["cost"], abs=1e-6)
