"""Settings, state codes and constants of a coverage analysis."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Segment states.
STOPPED, WORKING, TRANSPORT, AT_BASE, SILENT = 0, 1, 2, 3, 4
#: WGS84 semi-major axis in metres, flattening, first eccentricity squared; m2 per hectare.
EARTH_A, EARTH_F = 6378137.0, 1 / 298.257223563
EARTH_E2 = EARTH_F * (2 - EARTH_F)
M2_PER_HA = 10_000.0
#: A position jump faster than this is a spike; shorter detours (m) are not.
SPIKE_MS, SPIKE_SLACK_M = 40.0, 1.0
#: Most grid cells, coarsest cell (m), most patches listed, cells from which an outline is a hull.
MOST_CELLS, COARSEST_M, MOST_PATCHES, HULL_CELLS = 12_000_000, 50.0, 50, 20_000


#: What settings must be, compared with a number or with another setting.
RULES = (("swath_width_m", ">", 0), ("tank_capacity_l", ">", 0), ("cell_size_m", ">", 0), ("max_gap_s", ">", 0), ("min_speed_kmh", ">=", 0), ("max_speed_kmh", ">", "min_speed_kmh"))


@dataclass(frozen=True)
class Settings:
    """How wide the treated band is, and what counts as work. Speeds in km/h."""

    swath_width_m: float = 1.0
    tank_capacity_l: float = 18.0
    min_speed_kmh: float = 0.4
    max_speed_kmh: float = 4.5
    max_gap_s: float = 45.0
    max_accuracy_m: float = 25.0
    reentry_gap_s: float = 0.0  #: 0: three times the median interval, 10 s at least
    cell_size_m: float = 0.25
    min_gap_area_m2: float = 2.0
    field_close_factor: float = 2.0

    def __post_init__(self) -> None:
        for name, sign, other in RULES:
            bound = getattr(self, other) if isinstance(other, str) else other
            if not (getattr(self, name) > bound or sign == ">=" and getattr(self, name) == bound):
                raise ValueError(f"{name} must be {sign} {other}")

    @classmethod
    def merged(cls, old: Settings, changes: dict) -> Settings:
        """``old`` with the known keys of ``changes``; unknown keys and nulls are ignored, bad values raise ValueError."""
        known = {f.name for f in fields(cls)}
        return cls(**{f.name: getattr(old, f.name) for f in fields(cls)} | {k: float(v) for k, v in changes.items() if k in known and v is not None})

    @classmethod
    def merged_columns(cls, changes: Column) -> tuple[Column, Column]:
        """The defaults with ``changes`` (a map of names to numbers) as a struct, and whether that is valid: rules for a table of projects.

        Unknown keys and nulls are ignored, as by ``merged``.
        """
        each = {f.name: F.coalesce(F.try_element_at(changes, F.lit(f.name)).cast("double"), F.lit(float(f.default))) for f in fields(cls)}
        valid = F.lit(True)
        for name, sign, other in RULES:
            bound = each[other] if isinstance(other, str) else F.lit(float(other))
            valid = valid & (each[name] > bound if sign == ">" else each[name] >= bound) & ~F.isnan(each[name])
        return F.struct(*(c.alias(n) for n, c in each.items())), valid

    @classmethod
    def from_environment(cls, environ: Mapping[str, str], prefix: str = "FIELDSPAN_") -> Settings:
        """Defaults for a new project: a setting's variable is the prefix and its name in capitals; what is no number is ignored."""
        return cls.merged(cls(), {f.name: _number(environ.get(prefix + f.name.upper())) for f in fields(cls)})


def _number(text: str | None) -> float | None:
    try:
        return float(text) if text else None
    except ValueError:
        return None


@dataclass(frozen=True)
class Base:
    """Where tanks are refilled."""

    lat: float
    lon: float
    radius_m: float = 8.0
    min_dwell_s: float = 60.0
    name: str = "Base"

    @classmethod
    def from_environment(cls, environ: Mapping[str, str], prefix: str = "FIELDSPAN_BASE_") -> Base | None:
        """The base of a new project; none where latitude and longitude are unset or both zero."""
        given = {f.name: _number(environ.get(prefix + f.name.upper())) for f in fields(cls) if f.name != "name"}
        if abs(given["lat"] or 0.0) < 1e-9 and abs(given["lon"] or 0.0) < 1e-9:
            return None
        return cls(**{"lat": 0.0, "lon": 0.0} | {k: v for k, v in given.items() if v is not None})
