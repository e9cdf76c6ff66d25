"""Cost models as portable SQL expressions over an edge's columns.

``edge_cost(model, options, columns)`` gives (cost, secs). Options outside their range fall back to the default.
``columns`` names the expression of each attribute; an attribute without one has the value in ``ATTRIBUTES`` that
stands for "nothing special". ``transit_cost`` prices a departure instead of an edge.
"""

from __future__ import annotations

from dataclasses import dataclass, field

#: Fixed values, by road class, surface, density and turn type.
HIGHWAY = [1.0, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
SURFACE = [0.0, 0.0, 0.0, 0.1, 0.2, 0.5, 1.0, 1.0]
SCOOTER_SURFACE_SPEED = [1.0, 1.0, 0.9, 0.6, 0.1, 0.0, 0.0, 0.0]
SCOOTER_ROAD = [1.0, 0.5, 0.2, 0.1, 0.05, 0.05, 0.0, 0.5]
BICYCLE_ROAD = [1.0, 0.4, 0.2, 0.1, 0.05, 0.05, 0.0, 0.5]
BICYCLE_SPEED = {"road": 25.0, "cross": 20.0, "hybrid": 18.0, "mountain": 16.0}
BICYCLE_SURFACE_SPEED = {
    "road": [1.0, 1.0, 0.9, 0.6, 0.5, 0.3, 0.2, 0.0],
    "cross": [1.0, 1.0, 1.0, 0.8, 0.7, 0.5, 0.4, 0.0],
    "hybrid": [1.0, 1.0, 1.0, 0.8, 0.6, 0.4, 0.25, 0.0],
    "mountain": [1.0, 1.0, 1.0, 1.0, 0.9, 0.75, 0.55, 0.0],
}
BICYCLE_WORST_SURFACE = {"road": 3, "cross": 5, "hybrid": 4, "mountain": 6}
BICYCLE_BAD_SURFACE = [1.0, 2.5, 4.5, 7.0]
DENSITY = [0.85 + 0.025 * k for k in range(16)]
TURN_DENSITY = [1.0, 1.0, 1.0, 1.0, 1.0, 1.1, 1.2, 1.3, 1.4, 1.6, 1.9, 2.2, 2.5, 2.8, 3.1, 3.5]
RIGHT_SIDE_TURN = [0.5, 0.75, 1.0, 1.5, 9.5, 3.5, 2.5, 0.75]
CROSSING = 2.0
FOOTWAY, TURN_CHANNEL, TRACK, SERVICE, ALLEY, CYCLEWAY, STEPS, LIVING_STREET, RAIL_FERRY, FERRY = 1, 2, 3, 4, 5, 8, 9, 10, 11, 12  #: the fixture's uses
#: Fixed values, by weighted grade (-10 to 15 percent) and by hiking scale.
WALK_GRADE_TIME = [1.33, 1.22, 1.08, 0.97, 0.88, 0.92, 1.0, 1.1, 1.2, 1.33, 1.43, 1.57, 1.83, 2.03, 2.23, 2.5]
WALK_HILLS = [2.0, 1.0, 0.5, 0.2, 0.1, 0.0, 0.0, 0.0, 0.1, 0.3, 0.4, 0.5, 0.7, 1.0, 3.0, 5.0]
BICYCLE_GRADE_SPEED = [2.2, 2.0, 1.9, 1.7, 1.4, 1.2, 1.0, 0.95, 0.85, 0.75, 0.65, 0.55, 0.5, 0.45, 0.4, 0.3]
BICYCLE_HILLS = [2.0, 1.0, 0.5, 0.2, 0.1, 0.0, 0.05, 0.1, 0.3, 0.8, 2.0, 3.0, 4.5, 6.5, 10.0, 12.0]
SCOOTER_GRADE_SPEED = [1.25, 1.2, 1.15, 1.1, 1.05, 1.0, 1.0, 1.0, 0.95, 0.75, 0.6, 0.5, 0.45, 0.4, 0.35, 0.25]
SCOOTER_HILLS = [1.0, 0.8, 0.5, 0.2, 0.1, 0.0, 0.05, 0.1, 0.3, 0.8, 2.0, 3.0, 4.5, 6.0, 8.0, 10.0]
SAC_TIME = [1.0, 1.11, 1.25, 1.54, 2.5, 4.0, 6.67]
SAC_COST = [0.0, 0.25, 0.75, 1.25, 2.0, 2.5, 3.0]
TAXI_FACTOR, TRUCK_ROUTE, TURN_CHANNEL_FACTOR, ROUNDABOUT, BICYCLE_STEPS, BICYCLE_NETWORK, DISMOUNT_KPH, TRUCK_STRESS, DESTINATION_ONLY = 0.85, 0.85, 0.6, 2.0, 8.0, 0.95, 5, 0.5, 0.2

#: Attributes of an edge and what stands for none.
ATTRIBUTES = {
    "length": "length", "speed": "speed", "road_class": "road_class", "surface": "surface", "density": "density", "toll": "toll", "use": "use",
    "grade": "6", "sac_scale": "0", "sidewalk": "FALSE", "lit": "TRUE", "roundabout": "FALSE", "closed": "FALSE", "measured": "FALSE",
    "truck_speed": "0", "truck_route": "FALSE", "dest_only": "FALSE", "lanes": "1", "cycle_lane": "0", "shoulder": "FALSE", "use_sidepath": "FALSE",
    "bike_network": "FALSE", "dismount": "FALSE",
}

#: Name to (least, default, most).
RANGES = {
    "use_highways": (0.0, 0.5, 1.0),
    "use_tolls": (0.0, 0.5, 1.0),
    "use_trails": (0.0, 0.0, 1.0),
    "use_distance": (0.0, 0.0, 1.0),
    "use_ferry": (0.0, 0.5, 1.0),
    "use_rail_ferry": (0.0, 0.4, 1.0),
    "use_tracks": (0.0, 0.5, 1.0),
    "use_living_streets": (0.0, 0.1, 1.0),
    "use_lit": (0.0, 0.0, 1.0),
    "use_truck_route": (0.0, 0.0, 1.0),
    "use_primary": (0.0, 0.5, 1.0),
    "use_hills": (0.0, 0.5, 1.0),
    "use_roads": (0.0, 0.25, 1.0),
    "use_bus": (0.0, 0.3, 1.0),
    "use_rail": (0.0, 0.6, 1.0),
    "avoid_bad_surfaces": (0.0, 0.25, 1.0),
    "fixed_speed": (1.0, 0.0, 252.0),
    "top_speed": (10.0, 140.0, 252.0),
    "speed_penalty_factor": (0.0, 0.05, 1.0),
    "service_factor": (0.1, 1.0, 100000.0),
    "alley_factor": (0.1, 1.0, 100000.0),
    "walkway_factor": (0.1, 1.0, 100000.0),
    "sidewalk_factor": (0.1, 1.0, 100000.0),
    "closure_factor": (1.0, 9.0, 10.0),
    "maneuver_penalty": (0.0, 5.0, 43200.0),
    "toll_booth_cost": (0.0, 15.0, 43200.0),
    "ferry_cost": (0.0, 300.0, 43200.0),
    "country_crossing_cost": (0.0, 600.0, 43200.0),
    "service_penalty": (0.0, 15.0, 43200.0),
    "alley_penalty": (0.0, 5.0, 43200.0),
    "low_class_factor": (0.0, 1.5, 10.0),
    "walking_speed": (0.5, 5.1, 25.0),
}
#: Defaults that a model has for itself.
DEFAULTS = {
    "auto": {"use_tracks": 0.0},
    "truck": {"use_tracks": 0.0, "use_living_streets": 0.0},
    "motor_scooter": {"top_speed": 45.0},
    "bicycle": {"use_hills": 0.25, "use_living_streets": 0.5},
    "pedestrian": {"use_ferry": 1.0, "use_living_streets": 0.6, "alley_factor": 2.0},
}
DEFAULTS["bus"] = DEFAULTS["taxi"] = DEFAULTS["auto"]


@dataclass(frozen=True)
class Options:
    values: dict[str, float] = field(default_factory=dict)
    shortest: bool = False
    bicycle: str = "hybrid"

    def get(self, name: str, model: str = "") -> float:
        low, default, high = RANGES[name]
        default = DEFAULTS.get(model, {}).get(name, default)
        value = self.values.get(name, default)
        return value if low <= value <= high else default


def pick(table: list[float], index: str) -> str:
    """Table lookup as CASE; the last entry stands for all beyond."""
    cases = " ".join(f"WHEN {k} THEN {v!r}e0" for k, v in enumerate(table[:-1]))
    return f"(CASE {index} {cases} ELSE {table[-1]!r}e0 END)"


def _highway_factor(use: float, most: float = 8.0) -> float:
    return (0.5 - use) ** 3 if use >= 0.5 else most * (1 - 2 * use) ** 2


def _toll_factor(use: float, most: float = 4.0) -> float:
    return most - 2 * most * use if use < 0.5 else (0.5 - use) * 0.03


def _ferry_factor(use: float) -> float:
    return 10.0 - 18.0 * use if use < 0.5 else 1.5 - use


def _leaning(use: float, most: float, least: float) -> float:
    """From ``most`` at 0 over 1 at a half to ``least`` at 1."""
    return most - 2 * use * (most - 1) if use < 0.5 else least + 2 * (1 - use) * (1 - least)


def _rising(use: float) -> float:
    """1 at 0, 2 at a half, 8 at 1."""
    return 1 + 2 * use if use < 0.5 else 12 * use - 4


class _Edge:
    """Expressions of one model's edge: attributes by name, and the parts that models share."""

    def __init__(self, model: str, o: Options, columns: dict[str, str]):
        self.model, self.o, self.at = model, o, ATTRIBUTES | columns

    def __getattr__(self, name: str) -> str:
        return f"({self.at[name]})"

    def option(self, name: str) -> float:
        return self.o.get(name, self.model)

    def kph(self) -> str:
        fixed = self.option("fixed_speed")
        return f"{fixed!r}e0" if fixed else f"({self.speed} * 1e0)"

    def seconds(self, kph: str) -> str:
        return f"({self.length} * 3.6e0 / {kph})"

    def speed_penalty(self) -> str:
        top = self.option("top_speed")
        return f"(CASE WHEN {self.kph()} > {top!r}e0 THEN ({self.kph()} - {top!r}e0) * {self.option('speed_penalty_factor')!r}e0 ELSE 0e0 END)"

    def by_use(self, alley: bool = False, channel: bool = False) -> str:
        cases = f"WHEN {TRACK} THEN {_leaning(self.option('use_tracks'), 4.0, 0.8)!r}e0 WHEN {LIVING_STREET} THEN {_leaning(self.option('use_living_streets'), 3.0, 0.8)!r}e0 WHEN {SERVICE} THEN {self.option('service_factor')!r}e0"
        if alley:
            cases += f" WHEN {ALLEY} THEN {self.option('alley_factor')!r}e0"
        if channel:
            cases += f" WHEN {TURN_CHANNEL} THEN (CASE WHEN {self.measured} THEN {TURN_CHANNEL_FACTOR!r}e0 ELSE 1e0 END)"
        return f"(CASE {self.use} {cases} ELSE 1e0 END)"

    def closure(self) -> str:
        return f"(CASE WHEN {self.closed} THEN {self.option('closure_factor')!r}e0 ELSE 1e0 END)"

    def base(self) -> str:
        """Ferries by preference, all else by density."""
        return f"(CASE {self.use} WHEN {FERRY} THEN {_ferry_factor(self.option('use_ferry'))!r}e0 WHEN {RAIL_FERRY} THEN {_ferry_factor(self.option('use_rail_ferry'))!r}e0 ELSE {pick(DENSITY, self.density)} END)"

    def tolled(self, most: float = 4.0) -> str:
        return f"(CASE WHEN {self.toll} THEN {_toll_factor(self.option('use_tolls'), most)!r}e0 ELSE 0e0 END)"


def _car(e: _Edge) -> tuple[str, str, str]:
    secs = e.seconds(f"least({e.kph()}, {e.option('top_speed')!r}e0)")
    factor = f"({e.base()} + {_highway_factor(e.option('use_highways'))!r}e0 * {pick(HIGHWAY, e.road_class)} + {pick(SURFACE, e.surface)} + {e.speed_penalty()} + {e.tolled()})"
    part = e.option("use_distance")
    times = TAXI_FACTOR if e.model == "taxi" else 1.0
    return f"({secs} * {1 - part!r}e0 + {e.length} * {part / 16!r}e0)", f"({factor} * {e.by_use(alley=True, channel=True)} * {e.closure()} * {times!r}e0)", secs


def _truck(e: _Edge) -> tuple[str, str, str]:
    top = e.option("top_speed")
    secs = e.seconds(f"least({e.kph()}, CASE WHEN {e.truck_speed} > 0 THEN least({e.truck_speed} * 1e0, {top!r}e0) ELSE {top!r}e0 END)")
    road = f"({pick(DENSITY, e.density)} + {_highway_factor(e.option('use_highways'))!r}e0 * {pick(HIGHWAY, e.road_class)} + {pick(SURFACE, e.surface)} + {e.speed_penalty()} + (CASE WHEN {e.road_class} >= 6 THEN {e.option('low_class_factor')!r}e0 ELSE 0e0 END))"
    base = f"(CASE {e.use} WHEN {FERRY} THEN {_ferry_factor(e.option('use_ferry'))!r}e0 WHEN {RAIL_FERRY} THEN {_ferry_factor(e.option('use_rail_ferry'))!r}e0 ELSE {road} END)"
    routed = f"(CASE WHEN {e.truck_route} THEN {TRUCK_ROUTE!r}e0 ELSE {_rising(e.option('use_truck_route'))!r}e0 END)"
    return secs, f"(({base} * {routed} + {e.tolled(2.0)}) * {e.by_use()} * {e.closure()})", secs


def _motorcycle(e: _Edge) -> tuple[str, str, str]:
    secs = e.seconds(f"least({e.kph()}, {e.option('top_speed')!r}e0)")
    rough = _highway_factor(e.option("use_trails"))
    rough = float(int(rough)) if e.option("use_trails") < 0.5 else rough
    factor = f"({pick(DENSITY, e.density)} + {_highway_factor(e.option('use_highways'))!r}e0 * {pick(HIGHWAY, e.road_class)} + {rough!r}e0 * {pick(SURFACE, e.surface)} + {e.speed_penalty()} + {e.tolled(2.0)}) * {e.by_use()} * {e.closure()}"
    return secs, f"(CASE {e.use} WHEN {FERRY} THEN {_ferry_factor(e.option('use_ferry'))!r}e0 ELSE {factor} END)", secs


def _scooter(e: _Edge) -> tuple[str, str, str]:
    slowed = f"floor(greatest(1e0, least({e.option('top_speed')!r}e0, {e.kph()}) * {pick(SCOOTER_SURFACE_SPEED, e.surface)} * {pick(SCOOTER_GRADE_SPEED, e.grade)}))"
    secs = f"(CASE {e.use} WHEN {FERRY} THEN {e.seconds(e.kph())} ELSE {e.seconds(slowed)} END)"
    primary, hills = e.option("use_primary"), 1 - e.option("use_hills")
    road = 1.5 - primary if primary >= 0.5 else 3.0 - 5 * primary
    factor = f"(1e0 + {pick(DENSITY, e.density)} - 0.85e0 + {road!r}e0 * {pick(SCOOTER_ROAD, e.road_class)} + {hills!r}e0 * {pick(SCOOTER_HILLS, e.grade)} + {e.speed_penalty()} + (CASE WHEN {e.dest_only} THEN {DESTINATION_ONLY!r}e0 ELSE 0e0 END)) * {e.by_use()} * {e.closure()}"
    return secs, f"(CASE {e.use} WHEN {FERRY} THEN {_ferry_factor(e.option('use_ferry'))!r}e0 ELSE {factor} END)", secs


def _bicycle(e: _Edge) -> tuple[str, str, str]:
    kind, roads, hills = e.o.bicycle, e.option("use_roads"), 1 - e.option("use_hills")
    pedalled = f"floor({BICYCLE_SPEED[kind]!r}e0 * {pick(BICYCLE_SURFACE_SPEED[kind], e.surface)} * {pick(BICYCLE_GRADE_SPEED, e.grade)} + 0.5e0)"
    kph = f"(CASE WHEN {e.use} = {STEPS} THEN 1e0 WHEN {e.use} = {FERRY} THEN {e.speed} * 1e0 WHEN {e.dismount} THEN {DISMOUNT_KPH}e0 ELSE greatest(1e0, {pedalled}) END)"
    secs = e.seconds(kph)
    road = 1.5 - roads if roads >= 0.5 else 2.0 - 2 * roads
    lanes = [1.0, 0.9 + 0.05 * roads, 0.4 + 0.45 * roads, 0.15 + 0.6 * roads, 0.7 + 0.2 * roads, 0.9 + 0.05 * roads, 0.4 + 0.45 * roads, 0.15 + 0.6 * roads]
    path = [0.2 + roads, 0.2 + roads, 0.1 + 0.9 * roads, 0.8 * roads]
    is_path = f"{e.use} IN ({FOOTWAY}, {CYCLEWAY})"
    quiet = f"{e.use} IN ({LIVING_STREET}, {TRACK})"
    room = f"(CASE WHEN {is_path} THEN {pick(path, e.cycle_lane)} WHEN {quiet} THEN 1e0 ELSE {pick(lanes, f'((CASE WHEN {e.shoulder} THEN 4 ELSE 0 END) + {e.cycle_lane})')} END)"
    room = f"(({room} + (CASE WHEN {e.use_sidepath} THEN {3 * (1 - roads)!r}e0 ELSE 0e0 END)) * (CASE WHEN {e.bike_network} THEN {BICYCLE_NETWORK!r}e0 ELSE 1e0 END))"
    avoid = (1 - roads) * 0.75 + 0.25
    fast = f"(1e0 + ((CASE WHEN {e.speed} <= 40 THEN {e.speed} / 40e0 WHEN {e.speed} <= 65 THEN {e.speed} / 25e0 - 0.6e0 ELSE {e.speed} / 50e0 + 0.7e0 END) - 1e0) * {avoid!r}e0)"
    busy = f"((1e0 + (CASE WHEN {e.lanes} > 1 THEN ({e.lanes} - 1) * {0.05 * road!r}e0 ELSE 0e0 END) + (CASE WHEN {e.truck_route} THEN {TRUCK_STRESS!r}e0 ELSE 0e0 END) + {road!r}e0 * {pick(BICYCLE_ROAD, e.road_class)}) * {fast})"
    stress = f"(CASE WHEN {is_path} THEN 1e0 WHEN {e.use} = {LIVING_STREET} THEN {0.2 + 0.8 * roads!r}e0 WHEN {e.use} = {TRACK} THEN {0.5 + roads!r}e0 ELSE {busy} END)"
    worst = BICYCLE_WORST_SURFACE[kind]
    rough = f"(CASE WHEN {e.surface} >= {worst} THEN {e.option('avoid_bad_surfaces')!r}e0 * {pick(BICYCLE_BAD_SURFACE, f'({e.surface} - {worst})')} ELSE 0e0 END)"
    factor = f"(1e0 + {hills!r}e0 * {pick(BICYCLE_HILLS, e.grade)} + {room} * {stress} + {rough})"
    return secs, f"(CASE {e.use} WHEN {STEPS} THEN {BICYCLE_STEPS!r}e0 WHEN {FERRY} THEN {_ferry_factor(e.option('use_ferry'))!r}e0 ELSE {factor} END)", secs


def _pedestrian(e: _Edge) -> tuple[str, str, str]:
    walked = f"({e.seconds(repr(e.option('walking_speed')) + 'e0')} * {pick(SAC_TIME, e.sac_scale)} * {pick(WALK_GRADE_TIME, e.grade)})"
    secs = f"(CASE {e.use} WHEN {FERRY} THEN {e.seconds(f'({e.speed} * 1e0)')} ELSE {walked} END)"
    hills = 1 - e.option("use_hills")
    way = f"(CASE {e.use} WHEN {FOOTWAY} THEN {e.option('walkway_factor')!r}e0 WHEN {ALLEY} THEN {e.option('alley_factor')!r}e0 WHEN {TRACK} THEN {_leaning(e.option('use_tracks'), 4.0, 0.8)!r}e0 WHEN {LIVING_STREET} THEN {_leaning(e.option('use_living_streets'), 3.0, 0.8)!r}e0 WHEN {SERVICE} THEN {e.option('service_factor')!r}e0 ELSE (CASE WHEN {e.sidewalk} THEN {e.option('sidewalk_factor')!r}e0 WHEN {e.roundabout} THEN {ROUNDABOUT!r}e0 ELSE 1e0 END) END)"
    factor = f"((1e0 + {pick(SAC_COST, e.sac_scale)} + {hills!r}e0 * {pick(WALK_HILLS, e.grade)}) * {way} * (CASE WHEN {e.lit} THEN 1e0 ELSE {_rising(e.option('use_lit'))!r}e0 END))"
    return secs, f"(CASE {e.use} WHEN {FERRY} THEN {_ferry_factor(e.option('use_ferry'))!r}e0 ELSE {factor} END)", secs


_MODELS = {"auto": _car, "bus": _car, "taxi": _car, "truck": _truck, "motorcycle": _motorcycle, "motor_scooter": _scooter, "bicycle": _bicycle, "pedestrian": _pedestrian}


def edge_cost(model: str, o: Options | None = None, columns: dict[str, str] | None = None) -> tuple[str, str]:
    """(cost, secs) of traversing an edge."""
    o = o or Options()
    if model == "none":
        return "0e0", "0e0"
    if model not in _MODELS:
        raise ValueError(f"unknown cost model {model}")
    e = _Edge(model, o, columns or {})
    amount, factor, secs = _MODELS[model](e)
    return (f"({e.length} * 1e0)" if o.shortest else f"({amount} * {factor})"), secs


def transit_cost(wait: str, elapsed: str, vehicle: str, o: Options | None = None) -> tuple[str, str]:
    """(cost, secs) of waiting for a departure and riding on it; ``vehicle`` is 'bus', 'rail' or another text.

    Preferences weigh the ride, from 5 at 0 over 1 at a half to 0.5 at 1; the liked vehicle counts once, the other one
    by its weight times the ratio of both.
    """
    o = o or Options()
    weight = {name: (5.0 - 8 * o.get(f"use_{name}") if o.get(f"use_{name}") < 0.5 else 1.5 - o.get(f"use_{name}")) for name in ("bus", "rail")}
    liked, other = sorted(weight, key=lambda name: (weight[name], name))
    weight = {liked: 1.0, other: weight[other] * weight[other] / weight[liked]}
    ride = f"(CASE {vehicle} WHEN 'bus' THEN {weight['bus']!r}e0 WHEN 'rail' THEN {weight['rail']!r}e0 ELSE 1e0 END)"
    return f"({wait} + {elapsed} * {ride})", f"({wait} + {elapsed} * 1e0)"


def turn_seconds(degree: str, right: bool = True) -> str:
    """Seconds of a turn by its degree: a sigmoid, steeper towards the crossing side; u-turns cost 20 more."""
    bias = 1.075
    crossing, near = (1 / bias, bias) if right else (bias, 1 / bias)
    first = f"7.5e0 / (1e0 + exp(-({13 * crossing!r}e0 * {degree} / 180e0 - {6.5 * near!r}e0)))"
    second = f"7.5e0 / (1e0 + exp(-({13 * near!r}e0 * (360 - {degree}) / 180e0 - {6.5 * crossing!r}e0)))"
    return f"((CASE WHEN {degree} <= 180 THEN {first} ELSE {second} END) + (CASE WHEN {degree} BETWEEN 160 AND 200 THEN 20e0 ELSE 0e0 END))"


def transition_cost(o: Options | None = None, e: str = "e", p: str = "p", impact: str = "3") -> tuple[str, str]:
    """(cost, secs) of going from edge ``p`` onto edge ``e``, whose headings give the turn."""
    from pathloom.functions import geo

    o = o or Options()
    degree = geo.turn_degree(f"{p}.heading", f"{e}.heading")
    secs = f"({turn_seconds(degree)} + (CASE WHEN {e}.toll AND NOT {p}.toll THEN {o.get('toll_booth_cost')!r}e0 ELSE 0e0 END) + (CASE WHEN {e}.use = {FERRY} AND {p}.use <> {FERRY} THEN {o.get('ferry_cost')!r}e0 ELSE 0e0 END) + (CASE WHEN {e}.admin_id <> {p}.admin_id THEN {o.get('country_crossing_cost')!r}e0 ELSE 0e0 END))"
    penalties = f"((CASE WHEN {e}.street <> {p}.street THEN {o.get('maneuver_penalty')!r}e0 ELSE 0e0 END) + (CASE WHEN {e}.use = {SERVICE} AND {p}.use <> {SERVICE} THEN {o.get('service_penalty')!r}e0 ELSE 0e0 END) + (CASE WHEN {e}.use = {ALLEY} AND {p}.use <> {ALLEY} THEN {o.get('alley_penalty')!r}e0 ELSE 0e0 END))"
    turn = f"({pick(RIGHT_SIDE_TURN, geo.turn_type(degree))} * {impact} * {pick(TURN_DENSITY, f'{e}.density')})"
    return ("0e0" if o.shortest else f"({secs} + {penalties} + {turn})"), secs
