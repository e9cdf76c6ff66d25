"""Packed ids and tile arithmetic as portable SQL expressions.

An id packs 3 bits of level, 22 of tile and 21 of index: level + tile * 8 + index * 2**25.
"""

from __future__ import annotations

LEVEL_DEGREES = {0: 4.0, 1: 1.0, 2: 0.25}  #: fixed values: tile size of each level
BINS = 5  #: bins of a tile side
INVALID = 0x3FFFFFFFFFFF


def pack(level: str, tile: str, index: str) -> str:
    return f"(CAST({level} AS BIGINT) + CAST({tile} AS BIGINT) * 8 + CAST({index} AS BIGINT) * 33554432)"


def level_of(gid: str) -> str:
    return f"({gid} & 7)"


def tile_of(gid: str) -> str:
    return f"(({gid} & 33554431) - ({gid} & 7)) / 8"


def index_of(gid: str) -> str:
    return f"({gid} - ({gid} & 33554431)) / 33554432"


def row_of(lat: str, size: float) -> str:
    return f"CAST(floor(({lat} + 90e0) / {size}e0) AS BIGINT)"


def col_of(lon: str, size: float) -> str:
    return f"CAST(floor(({lon} + 180e0) / {size}e0) AS BIGINT)"


def columns(size: float) -> int:
    return round(360 / size)


def tile_id(lon: str, lat: str, size: float) -> str:
    return f"({row_of(lat, size)} * {columns(size)} + {col_of(lon, size)})"
