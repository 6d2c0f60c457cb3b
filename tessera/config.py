"""Parameters of an analysis in one place."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from tessera import fixed_values as fv


@dataclass(frozen=True)
class Params:
    """Defaults give the published definitions; override per data set."""

    tiles: tuple[int, ...] = fv.TILE_COUNTS
    minimums: tuple[float, ...] = tuple(fv.MINIMUM_SHARES)
    excluded_states: tuple[str, ...] = fv.EXCLUDED_STATES
    excluded_metros: tuple[str, ...] = fv.EXCLUDED_METROS_NATIONAL
    years: tuple[int, int] = (2010, 2015)
    key_levels: Mapping[str, int] = field(default_factory=lambda: dict(fv.KEY_LEVELS))
