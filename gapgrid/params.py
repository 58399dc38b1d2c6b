"""Thresholds and constants in one place; every operator takes a ``Params`` or explicit arguments."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Labels written into result tables.
ACTION_MAP, ACTION_REVIEW, ACTION_NONE = "mapear", "revisar", "sin_brecha"
UNKNOWN_LABEL = "desconocido"
NO_NEIGHBOURS, NOT_SIGNIFICANT = "sin vecinas", "no significativo"
PART_TRAIN, PART_TEST = "entrenamiento", "prueba"
BATCH_NEW, BATCH_ORIGINAL = "lote_2024", "lote_original"
FIELD_RESULTS = ("ruta_no_mapeada", "ruta_mapeada_correcta", "sin_transporte", "sin_visitar")
LADDER = ("B0", "B1", "B2", "B3", "M1", "M2", "M3")

# Columns that say where a row came from; never part of a duplicate key or a null profile.
LINEAGE = ("source_file", "source_batch", "source_encoding")

PREDICTION_FLOOR = 1e-6


# The box, thresholds and settings below.

@dataclass(frozen=True)
class BBox:
    lat_min: float = -23.0
    lat_max: float = -9.0
    lon_min: float = -70.0
    lon_max: float = -56.0


@dataclass(frozen=True)
class UserThresholds:
    volume: float = 1000
    per_active_day: float = 50
    origin_cells: float = 200
    burst: float = 100
    repeated_share: float = 0.05
    repeated_min_queries: int = 100
    fast_seconds: float = 60
    min_signals: int = 2


@dataclass(frozen=True)
class Params:
    seed: int = 42
    bbox: BBox = field(default_factory=BBox)
    users: UserThresholds = field(default_factory=UserThresholds)
    # reference point for distances and for the grid origin
    centre_lat: float = -17.393583
    centre_lon: float = -66.157014
    utm_central_meridian: float = -69.0
    # hexagon edge in metres: 0.737 km2 per zone, 0.92 km between neighbours
    edge_m: float = 532.7
    zone_res: int = 8
    block_res: int = 6
    block_factor: int = 7
    dist_max_m: float = 50_000.0
    buffer_m: float = 1_000.0
    component_k: int = 1
    pop_min: int = 10
    pop_min_sensitivity: int = 50
    mixed_threshold: float = 90.0
    coverage_m: float = 500.0
    network_step_m: float = 50.0
    correlogram_k: int = 5
    permutations: int = 499
    lisa_alpha: float = 0.05
    unit_sample: int | None = None  # every row
    test_fraction: float = 0.20
    n_rings: int = 4
    predictors: tuple[str, ...] = ("dist_centre_km", "pop_ring1")
    contrast: tuple[str, ...] = ("dist_network_m", "covered")
    folds: int = 5
    inner_folds: int = 3
    tolerance_se: float = 1.0
    neighbours_min: int = 3
    neighbours_k_max: int = 10
    label_k_max: int = 30
    boosting_max_iter: int = 300
    boosting_depth: int = 5  # levels of a tree where a setting names no limit
    boosting_reserve: float = 0.10
    boosting_grid: tuple = tuple(
        {"max_depth": d, "min_leaf": m, "learning_rate": r}
        for d in (3, None) for m in (20, 50) for r in (0.05, 0.1))
    leak_draws: int = 200
    top_k: int = 20
    only_uncovered: bool = True
    shrink: float = 1.0

    def but(self, **changes) -> "Params":
        return replace(self, **changes)


DEFAULT = Params()
