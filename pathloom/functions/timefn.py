"""Date and time helpers as portable SQL expressions over naive timestamps (UTC)."""

from __future__ import annotations

PIVOT = "2014-01-01"  #: fixed value: day 0
WEEK = 604800


def dow(date: str, sunday: int) -> str:
    """Weekday with Sunday 0; ``sunday`` is what the engine's dayofweek gives for a Sunday."""
    return f"(dayofweek({date}) - {sunday})"


def dow_mask(weekday: str) -> str:
    return f"CAST(pow(2e0, {weekday}) AS BIGINT)"


def second_of_day(ts: str) -> str:
    return f"(hour({ts}) * 3600 + minute({ts}) * 60 + CAST(floor(second({ts})) AS BIGINT))"


def second_of_week(ts: str, sunday: int) -> str:
    return f"({dow(ts, sunday)} * 86400 + {second_of_day(ts)})"


def in_daily_window(minute: str, begin: str, end: str) -> str:
    """Minute of the day inside [begin, end]; over midnight if begin is later."""
    return f"(CASE WHEN {begin} <= {end} THEN {minute} >= {begin} AND {minute} <= {end} ELSE {minute} >= {begin} OR {minute} <= {end} END)"


def in_yearly_window(month: str, day: str, bm: str, bd: str, em: str, ed: str) -> str:
    """Month and day inside an inclusive range that may wrap over the new year."""
    at, b, e = f"({month} * 100 + {day})", f"({bm} * 100 + {bd})", f"({em} * 100 + {ed})"
    return f"(CASE WHEN {b} <= {e} THEN {at} >= {b} AND {at} <= {e} ELSE {at} >= {b} OR {at} <= {e} END)"


def nth_weekday_day(first_weekday: str, weekday: str, n: str, days_in_month: str) -> str:
    """Day of the month of the n-th weekday (Sunday 0); a fifth that isn't there falls back to the fourth."""
    day = f"(1 + ({weekday} - {first_weekday} + 7) % 7 + ({n} - 1) * 7)"
    return f"(CASE WHEN {day} > {days_in_month} THEN {day} - 7 ELSE {day} END)"
