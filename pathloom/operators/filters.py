"""Edge filters as predicates (SQL expression text) over an edge ``e`` and, where needed, its predecessor ``p``."""

from __future__ import annotations

AUTO, BUS, TRUCK, PEDESTRIAN = 1, 2, 4, 8  #: fixed values of the fixture's access mask
UTURN_USE, FERRY_USE = 7, 12
IMPASSABLE = 7


def accessible(mask: int, access: str = "access") -> str:
    return f"(({access} & {mask}) <> 0)"


def allowed(mask: int, e: str = "e", p: str = "p", allow_uturn: bool = False) -> str:
    """Edge ``e`` may follow ``p``: access, no u-turn onto the opposing edge, passable surface."""
    back = "" if allow_uturn else f" AND NOT ({e}.src = {p}.dst AND {e}.dst = {p}.src)"
    return f"({accessible(mask, f'{e}.access')} AND {e}.surface <> {IMPASSABLE}{back})"


def entering(flag: str, e: str = "e", p: str = "p") -> str:
    """A hard exclusion: the edge has the property and its predecessor had not."""
    return f"({e}.{flag} AND NOT {p}.{flag})"


def heading_near(heading: str, wanted: str, tolerance: float = 60.0) -> str:
    return f"(least(abs({heading} - {wanted}), 360e0 - abs({heading} - {wanted})) <= {tolerance}e0)"


def side_of(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    """1 left of the segment, -1 right of it, 0 on it."""
    return f"CAST(sign(round(({bx} - {ax}) * ({py} - {ay}) - ({by} - {ay}) * ({px} - {ax}), 12)) AS INT)"


def fits(limits: dict[str, float], columns: dict[str, str]) -> str:
    """Vehicle dimensions under the limits of an edge, where 0 stands for none; limits in hundredths."""
    return "(" + " AND ".join(f"({columns[k]} = 0 OR {v}e0 <= {columns[k]} * 0.01e0)" for k, v in limits.items()) + ")"


def in_time(kind: str, begin: str, end: str, minute: str) -> str:
    """A timed restriction lets pass: 'allowed' inside its hours, 'denied' outside; without a time it is ignored."""
    inside = f"(CASE WHEN {begin} <= {end} THEN {minute} >= {begin} AND {minute} <= {end} ELSE {minute} >= {begin} OR {minute} <= {end} END)"
    return f"(CASE WHEN {minute} IS NULL THEN TRUE WHEN {kind} = 'allowed' THEN {inside} ELSE NOT {inside} END)"
