"""Choice of method from sizes and options, as the driver program makes it before any job runs."""

from __future__ import annotations

from dataclasses import dataclass, field

CSR_EDGES = 1_000_000
MATCH_DEFAULTS = {"sigma_z": 4.07, "beta": 3.0, "breakage_distance": 2000.0, "search_radius": 50.0, "interpolation_distance": 10.0}
#: Service limits by model, (metres, locations, matrix pairs).
LIMITS = {"auto": (5_000_000, 20, 2500), "bus": (5_000_000, 50, 2500), "taxi": (5_000_000, 20, 2500), "truck": (5_000_000, 20, 2500), "bicycle": (500_000, 50, 2500), "pedestrian": (250_000, 50, 2500)}


@dataclass(frozen=True)
class Request:
    """What a caller asks for; unknown models raise when a plan is made."""

    action: str
    model: str = "auto"
    locations: int = 2
    targets: int = 0
    metres: float = 0.0
    timed: bool = False
    shape_match: str = "walk_or_snap"
    options: dict[str, float] = field(default_factory=dict)


ERRORS = {150: "too many locations", 154: "path distance exceeds the limit", 125: "no such cost model", 120: "too few locations", 443: "exact shape match failed"}


def validate(request: Request) -> int:
    """0, or the number of the error."""
    if request.model not in LIMITS:
        return 125
    metres, locations, pairs = LIMITS[request.model]
    if request.action in ("route", "optimized_route") and request.locations < 2:
        return 120
    if request.locations > locations or request.locations * max(1, request.targets) > pairs:
        return 150
    return 154 if request.metres > metres else 0


def path_method(request: Request, edges: int) -> str:
    """'csr' while the graph fits a task, else 'frontier'; timed multimodal requests take the product graph."""
    if request.model in ("transit", "multimodal", "bikeshare"):
        return "product"
    return "csr" if edges <= CSR_EDGES else "frontier"


def matrix_method(request: Request, edges: int) -> str:
    """One search a source while targets are many, or from both ends when the graph needs the frontier."""
    if edges <= CSR_EDGES:
        return "csr"
    return "one_to_many" if request.timed or request.targets > 5 * request.locations else "both_ends"


def match_method(shape_match: str, exact: bool) -> str:
    """Edge walk for exact shapes, snapping for traces; 'walk_or_snap' walks first."""
    if shape_match == "edge_walk":
        return "edge_walk"
    if shape_match == "map_snap":
        return "map_snap"
    return "edge_walk" if exact else "map_snap"


#: Matching parameters that a mode has for itself.
MATCH_MODES = {"auto": {"turn_penalty_factor": 200.0, "search_radius": 50.0}, "pedestrian": {"turn_penalty_factor": 100.0, "search_radius": 50.0}, "bicycle": {"turn_penalty_factor": 140.0}, "multimodal": {"turn_penalty_factor": 70.0}}


def match_config(mode: str, given: dict[str, float] | None = None) -> dict[str, float]:
    """Parameters of a matching request: the defaults, what the mode sets, then what the request does; unknown names fall away."""
    known = {**MATCH_DEFAULTS, "turn_penalty_factor": 0.0}
    return {**known, **{k: v for layer in (MATCH_MODES.get(mode, {}), given or {}) for k, v in layer.items() if k in known}}


def merged(defaults: dict, given: dict) -> dict:
    """Nested settings: what is given wins, groups are merged key by key."""
    return {k: merged(v, given[k]) if isinstance(v, dict) and isinstance(given.get(k), dict) else given.get(k, v) for k, v in defaults.items()} | {k: v for k, v in given.items() if k not in defaults}


def path_methods(requests, edges: int):
    """``requests`` with ``method``: what ``path_method`` gives for each row's model."""
    from pyspark.sql import functions as F

    product = F.col("model").isin("transit", "multimodal", "bikeshare")
    return requests.withColumn("method", F.when(product, "product").otherwise("csr" if edges <= CSR_EDGES else "frontier"))
