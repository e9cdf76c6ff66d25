"""All queries of the library, registered when their modules are loaded."""

from __future__ import annotations

from importlib import import_module

from pathloom import registry

MODULES = ("network", "relational", "scalars", "streams", "actions", "building", "further")


def load() -> dict[str, registry.Build]:
    for name in MODULES:
        import_module(f"pathloom.queries.{name}")
    return dict(registry.QUERIES)


def checks() -> dict[str, str]:
    load()
    return dict(registry.ORACLES)
