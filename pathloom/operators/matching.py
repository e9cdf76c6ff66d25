"""Map matching: trace splitting, thinning, candidates, emission and transition costs, Viterbi."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions import geo

SIGMA, BETA = 4.07, 3.0  #: fixed values
BREAKAGE, RADIUS, INTERPOLATION = 2000.0, 50.0, 10.0


def split_traces(traces: DataFrame, breakage: float = BREAKAGE) -> DataFrame:
    """``traces`` with ``part``: a jump beyond ``breakage`` metres starts a new part."""
    w = Window.partitionBy("trace_id").orderBy("seq")
    jump = F.expr(geo.haversine("_plon", "_plat", "lon", "lat")) > breakage
    held = traces.withColumns({"_plon": F.lag("lon").over(w), "_plat": F.lag("lat").over(w)}).withColumn("_jump", F.when(jump, 1).otherwise(0))
    return held.withColumn("part", F.sum("_jump").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_plon", "_plat", "_jump")


def emission(metres: str, sigma: float = SIGMA) -> str:
    return f"({metres} * {metres} / {2 * sigma * sigma!r}e0)"


def transition(route: str, straight: str, turn: str = "0e0", beta: float = BETA) -> str:
    return f"(({turn} + abs({route} - {straight})) / {beta}e0)"


def _metres(lon1: float, lat1: float, lon2: float, lat2: float) -> float:
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * geo.EARTH_METERS * math.asin(min(1.0, math.sqrt(a)))


def thin(traces: DataFrame, distance: float = INTERPOLATION) -> DataFrame:
    """(trace_id, seq, kept): the first, the last and every point farther than ``distance`` from the last kept."""

    def fold(points: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("seq")
        kept, at = [], None
        rows = list(points[["lon", "lat"]].itertuples(index=False))
        for k, row in enumerate(rows):
            far = at is None or k == len(rows) - 1 or _metres(*at, *row) > distance
            kept.append(far)
            at = tuple(row) if far else at
        return pd.DataFrame({"trace_id": points["trace_id"], "seq": points["seq"], "kept": kept})

    return traces.select("trace_id", "seq", "lon", "lat").groupBy("trace_id").applyInPandas(fold, "trace_id long, seq long, kept boolean")


def viterbi(steps: DataFrame) -> DataFrame:
    """(trace_id, time, state, cost): the cheapest sequence of states of each trace.

    ``steps`` has (trace_id, time, state, emission, before, transition): one row per state and reachable state
    before it; a row whose before is null tells that a path may begin there. Ties take the smaller state. A time that
    nothing reaches starts a new path, whose costs start from its emissions.
    """

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        out, layers, costs = [], [], {}
        for _, layer in rows.sort_values(["time", "state"]).groupby("time", sort=True):
            now, back = {}, {}
            for r in layer.itertuples(index=False):
                before = None if pd.isna(r.before) else int(r.before)
                if before in costs:
                    cost = costs[before] + r.transition + r.emission
                    if r.state not in now or (cost, before) < (now[r.state], back[r.state]):
                        now[r.state], back[r.state] = cost, before
            if not now:
                out += _traced(layers)
                layers = []
                now = {int(state): float(cost) for state, cost in zip(layer["state"], layer["emission"], strict=True)}
                back = dict.fromkeys(now)
            layers.append((int(layer["time"].iloc[0]), now, back))
            costs = now
        out += _traced(layers)
        return pd.DataFrame([(int(rows["trace_id"].iloc[0]), *x) for x in out], columns=["trace_id", "time", "state", "cost"])

    return steps.groupBy("trace_id").applyInPandas(best, "trace_id long, time long, state long, cost double")


def _traced(layers: list) -> list[tuple[int, int, float]]:
    if not layers:
        return []
    state = min(layers[-1][1], key=lambda s: (layers[-1][1][s], s))
    path = []
    for time, costs, back in reversed(layers):
        path.append((time, int(state), float(costs[state])))
        state = back[state]
    return path[::-1]


def k_best(steps: DataFrame, k: int = 3) -> DataFrame:
    """(trace_id, rank, cost, states): the k cheapest state sequences through all times of each trace.

    ``steps`` as for ``viterbi``. Every state keeps its k cheapest ways to it, which is exact. Equal costs are ordered
    by their states. A trace with a time that nothing reaches has no row.
    """

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        ways: dict[int, list[tuple[float, tuple[int, ...]]]] = {}
        first = True
        for _, layer in rows.sort_values("time").groupby("time", sort=True):
            now: dict[int, list[tuple[float, tuple[int, ...]]]] = {}
            for r in layer.itertuples(index=False):
                state = int(r.state)
                if first:
                    now[state] = [(float(r.emission), (state,))]
                elif not pd.isna(r.before):
                    now.setdefault(state, []).extend((cost + r.transition + r.emission, (*path, state)) for cost, path in ways.get(int(r.before), ()))
            ways = {state: sorted(own)[:k] for state, own in now.items()}
            first = False
        found = sorted(way for own in ways.values() for way in own)[:k]
        return pd.DataFrame([(int(rows["trace_id"].iloc[0]), n, cost, list(path)) for n, (cost, path) in enumerate(found, 1)], columns=["trace_id", "rank", "cost", "states"])

    return steps.groupBy("trace_id").applyInPandas(best, "trace_id long, rank int, cost double, states array<long>")
