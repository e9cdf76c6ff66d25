"""Edge speeds: live traffic records, layered blending and predicted-speed buckets, as portable SQL expressions."""

from __future__ import annotations

UNKNOWN = 127  #: raw value of an unknown live speed
MAX_CONGESTION = 63
BUCKETS, COEFFICIENTS = 2016, 200
NORM = 0.031497039  #: fixed value: sqrt(2 / 2016)


def valid(bp1: str, overall: str) -> str:
    return f"({bp1} <> 0 AND {overall} <> {UNKNOWN})"


def closed(bp1: str, overall: str) -> str:
    return f"({bp1} <> 0 AND {overall} = 0)"


def coverage(bp1: str, bp2: str, s1: str, s2: str, s3: str) -> str:
    """Share of the edge that live speeds cover."""
    parts = f"(CASE WHEN {s1} <> {UNKNOWN} THEN {bp1} ELSE 0 END) + (CASE WHEN {s2} <> {UNKNOWN} THEN {bp2} - {bp1} ELSE 0 END) + (CASE WHEN {s3} <> {UNKNOWN} THEN 255 - {bp2} ELSE 0 END)"
    return f"(CASE WHEN {bp1} = 255 THEN 1e0 ELSE ({parts}) / 255e0 END)"


def fade(seconds_from_now: str) -> str:
    """Weight of live traffic, falling to nothing over an hour."""
    return f"(1e0 - least({seconds_from_now} / 3600e0, 1e0))"


def blended(live: str, share: str, predicted: str, constrained: str, free: str, base: str, second_of_day: str, truck: str = "0") -> str:
    """Speed in kph: live for its share, the rest from the first layer that has one for the time of day.

    Null or 0 marks a missing layer. A null second of the day is 'no time': live and predicted layers are left out
    and the constrained layer counts as daytime.
    """
    day = f"({second_of_day} IS NULL OR ({second_of_day} > 25200 AND {second_of_day} < 68400))"
    night = f"({second_of_day} IS NULL OR NOT ({second_of_day} > 25200 AND {second_of_day} < 68400))"
    part = f"(CASE WHEN {second_of_day} IS NULL OR coalesce({live}, 0) = 0 THEN 0e0 ELSE {share} END)"
    rest = f"(CASE WHEN {second_of_day} IS NOT NULL AND coalesce({predicted}, 0e0) > 0e0 THEN greatest({predicted}, 0.5e0) + 0.5e0 WHEN {day} AND coalesce({constrained}, 0) > 0 THEN {constrained} * 1e0 WHEN {night} AND coalesce({free}, 0) > 0 THEN {free} * 1e0 ELSE {base} * 1e0 END)"
    speed = f"floor(coalesce({live}, 0) * {part} + (1e0 - {part}) * {rest})"
    return f"CAST(CASE WHEN {truck} > 0 THEN least({speed}, {truck}) ELSE {speed} END AS BIGINT)"


def ferry_speed(length: str, duration_secs: str) -> str:
    return f"CAST(greatest(1e0, least(floor({length} * 3.6e0 / {duration_secs} + 0.5e0), 254e0)) AS BIGINT)"


def dct_coefficient(buckets: str, k: str) -> str:
    """The k-th coefficient, rounded to a whole number, of an array of bucket speeds (a DCT-II with unit norm)."""
    n = f"size({buckets})"
    total = f"aggregate(transform({buckets}, (x, i) -> x * cos(pi() / {n} * (i + 0.5e0) * {k})), 0e0, (s, v) -> s + v)"
    return f"CAST(round(sqrt(2e0 / {n}) * (CASE WHEN {k} = 0 THEN 0.707106781e0 ELSE 1e0 END) * {total}) AS BIGINT)"
