"""Geometry as SQL expressions that Spark and other SQL engines read alike.

Every function takes and returns expression text; pass it to ``functions.expr``. Coordinates are degrees in double.
"""

from __future__ import annotations

EARTH_METERS = 6378160.187
METERS_PER_DEGREE = 110567.0


def haversine(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """Great-circle metres, the difference in longitude wrapped at the date line."""
    dlon = f"(abs({lon1} - {lon2}) - 360e0 * CAST(abs({lon1} - {lon2}) > 180e0 AS INT))"
    inner = f"pow(sin(radians({lat2} - {lat1}) / 2e0), 2e0) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({dlon}) / 2e0), 2e0)"
    return f"(2e0 * {EARTH_METERS}e0 * asin(least(1e0, sqrt(greatest(0e0, {inner})))))"


def planar2(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """Squared metres on the local plane at the mean latitude."""
    return f"(pow(({lat1} - {lat2}) * {METERS_PER_DEGREE}e0, 2e0) + pow(({lon1} - {lon2}) * {METERS_PER_DEGREE}e0 * cos(radians(({lat1} + {lat2}) * 0.5e0)), 2e0))"


def heading(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """Degrees from north, 0 to 360; 0 for equal points."""
    y = f"sin(radians({lon2} - {lon1})) * cos(radians({lat2}))"
    x = f"cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2})) * cos(radians({lon2} - {lon1}))"
    return f"(CASE WHEN {lon1} = {lon2} AND {lat1} = {lat2} THEN 0e0 WHEN atan2({y}, {x}) < 0e0 THEN degrees(atan2({y}, {x})) + 360e0 ELSE degrees(atan2({y}, {x})) END)"


def along(lon1: str, lat1: str, lon2: str, lat2: str, part: str) -> tuple[str, str]:
    """(lon, lat) at a share of the great circle between two different points."""
    d = f"acos(least(1e0, sin(radians({lat1})) * sin(radians({lat2})) + cos(radians({lat1})) * cos(radians({lat2})) * cos(radians({lon1} - {lon2}))))"
    a, b = f"(sin({d} * (1e0 - {part})) / sin({d}))", f"(sin({d} * {part}) / sin({d}))"
    x = f"({a} * cos(radians({lat1})) * cos(radians({lon1})) + {b} * cos(radians({lat2})) * cos(radians({lon2})))"
    y = f"({a} * cos(radians({lat1})) * sin(radians({lon1})) + {b} * cos(radians({lat2})) * sin(radians({lon2})))"
    z = f"({a} * sin(radians({lat1})) + {b} * sin(radians({lat2})))"
    return f"degrees(atan2({y}, {x}))", f"degrees(atan2({z}, sqrt({x} * {x} + {y} * {y})))"


def circumradius(a: str, b: str, c: str) -> str:
    """Radius of the circle through a triangle with these sides; the largest double if they are in line."""
    s = f"(({a} + {b} + {c}) * 0.5e0)"
    k = f"sqrt(greatest(0e0, {s} * ({s} - {a}) * ({s} - {b}) * ({s} - {c})))"
    return f"(CASE WHEN {k} = 0e0 THEN 1.7976931348623157e308 ELSE ({a} * {b} * {c}) / (4e0 * {k}) END)"


def project_share(px: str, py: str, ux: str, uy: str, vx: str, vy: str) -> str:
    """Where a point falls on a segment, as a share from 0 to 1, longitudes scaled at the point's latitude."""
    k = f"cos(radians({py}))"
    bx, by = f"(({vx} - {ux}) * {k})", f"({vy} - {uy})"
    sq = f"({bx} * {bx} + {by} * {by})"
    return f"(CASE WHEN {sq} = 0e0 THEN 0e0 ELSE least(1e0, greatest(0e0, (({px} - {ux}) * {k} * {bx} + ({py} - {uy}) * {by}) / {sq})) END)"


def segments_cross(ax: str, ay: str, bx: str, by: str, cx: str, cy: str, dx: str, dy: str) -> str:
    """Whether two segments share a point that is inside both or an end."""
    def side(px, py, qx, qy, rx, ry):
        return f"sign(({qx} - {px}) * ({ry} - {py}) - ({qy} - {py}) * ({rx} - {px}))"

    return f"({side(ax, ay, bx, by, cx, cy)} * {side(ax, ay, bx, by, dx, dy)} <= 0e0 AND {side(cx, cy, dx, dy, ax, ay)} * {side(cx, cy, dx, dy, bx, by)} <= 0e0)"


def in_triangle(px: str, py: str, ax: str, ay: str, bx: str, by: str, cx: str, cy: str) -> str:
    def cross(ux, uy, vx, vy):
        return f"(({vx} - {ux}) * ({py} - {uy}) - ({vy} - {uy}) * ({px} - {ux}))"

    one, two, three = cross(ax, ay, bx, by), cross(bx, by, cx, cy), cross(cx, cy, ax, ay)
    return f"(({one} >= 0e0 AND {two} >= 0e0 AND {three} >= 0e0) OR ({one} <= 0e0 AND {two} <= 0e0 AND {three} <= 0e0))"


def turn_degree(from_heading: str, to_heading: str) -> str:
    return f"(CAST(floor({to_heading} - {from_heading} + 720e0) AS BIGINT) % 360)"


def turn_type(degree: str) -> str:
    """0 straight, 1 slight right, 2 right, 3 sharp right, 4 reverse, 5 sharp left, 6 left, 7 slight left."""
    return f"(CASE WHEN {degree} <= 10 OR {degree} >= 350 THEN 0 WHEN {degree} <= 44 THEN 1 WHEN {degree} <= 135 THEN 2 WHEN {degree} <= 159 THEN 3 WHEN {degree} <= 200 THEN 4 WHEN {degree} <= 224 THEN 5 WHEN {degree} <= 315 THEN 6 ELSE 7 END)"


def circular_clamp(x: str, low: float, high: float) -> str:
    span = high - low
    return f"({x} - {span}e0 * floor(({x} - {low}e0) / {span}e0))"


def boxes_meet(a: tuple[str, str, str, str], b: tuple[str, str, str, str]) -> str:
    """Boxes as (min x, min y, max x, max y)."""
    return f"({a[0]} <= {b[2]} AND {a[2]} >= {b[0]} AND {a[1]} <= {b[3]} AND {a[3]} >= {b[1]})"


def mercator_tile(lon: str, lat: str, zoom: int) -> tuple[str, str]:
    """Column and row of the web-mercator tile."""
    n = float(2**zoom)
    y = f"(1e0 - ln(tan(radians({lat})) + 1e0 / cos(radians({lat}))) / pi()) / 2e0"
    return f"CAST(floor(({lon} + 180e0) / 360e0 * {n}e0) AS BIGINT)", f"CAST(floor({y} * {n}e0) AS BIGINT)"


def azimuthal(lon: str, lat: str, lon0: str, lat0: str) -> tuple[str, str]:
    """Azimuthal equidistant metres east and north of a centre."""
    cosc = f"least(1e0, sin(radians({lat0})) * sin(radians({lat})) + cos(radians({lat0})) * cos(radians({lat})) * cos(radians({lon} - {lon0})))"
    k = f"(CASE WHEN {cosc} >= 1e0 THEN 1e0 ELSE acos({cosc}) / sin(acos({cosc})) END)"
    return (
        f"({EARTH_METERS}e0 * {k} * cos(radians({lat})) * sin(radians({lon} - {lon0})))",
        f"({EARTH_METERS}e0 * {k} * (cos(radians({lat0})) * sin(radians({lat})) - sin(radians({lat0})) * cos(radians({lat})) * cos(radians({lon} - {lon0}))))",
    )


def _uniform(key: str, draw: int) -> str:
    """A number under 1 made of a whole number and a draw by squaring and multiplying modulo a prime."""
    first = f"(({key} * 7919 + {draw * 104729 + 1}) % 2147483647)"
    return f"(({first} * {first} % 2147483647 * 69621) % 2147483647 / 2147483647e0)"


def noisy(lon: str, lat: str, metres: float, key: str) -> tuple[str, str]:
    """A place moved by a nearly normal error of so many metres each way, the same for the same key."""
    east, north = (f"(({' + '.join(_uniform(key, first + k) for k in range(12))}) - 6e0)" for first in (0, 12))
    degree = f"{metres / METERS_PER_DEGREE:.15f}e0"
    return f"({lon} + {east} * {degree} / cos(radians({lat})))", f"({lat} + {north} * {degree})"
