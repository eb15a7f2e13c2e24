"""Header keys of fields: code flags, units of time, origins of staggered grids, level coefficients."""

from __future__ import annotations

from collections.abc import Sequence
from enum import IntEnum
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from isobar.field import Field


class UnitOfTime(IntEnum):
    """Code of the unit that forecast times are given in. Fixed values."""

    MINUTE = 0
    HOUR = 1
    DAY = 2
    HOURS_3 = 10
    HOURS_6 = 11
    HOURS_12 = 12
    SECOND = 13

    @property
    def seconds(self) -> int:
        return {"MINUTE": 60, "HOUR": 3600, "DAY": 86400, "HOURS_3": 10800, "HOURS_6": 21600, "HOURS_12": 43200, "SECOND": 1}[self.name]


def _mask(place: int) -> int:
    if not 1 <= place <= 8:
        raise ValueError("flags have the places 1 to 8")
    return 0x80 >> (place - 1)


def code_flags(places: Sequence[int]) -> int:
    """The octet that has the bits at ``places`` set, 1 the most significant."""
    return sum({_mask(p) for p in places})


def flags_at(octet: int, places: Sequence[int]) -> list[bool]:
    """Which of ``places`` are set."""
    if octet not in range(256):
        raise ValueError("flags are one octet")
    return [octet & _mask(p) > 0 for p in places]


def origin(keys: dict, reference: dict) -> tuple[float, float]:
    """Shift of a field's first point from that of ``reference``, in grid steps, to a tenth."""
    lon, lat = "longitudeOfFirstGridPointInDegrees", "latitudeOfFirstGridPointInDegrees"
    dx = (keys[lon] % 360 - reference[lon] % 360) / keys["iDirectionIncrementInDegrees"]
    return round(dx, 1), round((keys[lat] - reference[lat]) / keys["jDirectionIncrementInDegrees"], 1)


def with_origins(fields: dict[str, Field], reference: str) -> dict[str, Field]:
    """``fields`` with their origins relative to one of them; unstructured grids have none."""
    if reference not in fields:
        raise KeyError(f"no field {reference}")
    keys = fields[reference].meta.keys
    if keys.get("gridType") == "unstructured_grid":
        return fields
    out = {}
    for name, f in fields.items():
        x, y = origin(f.meta.keys, keys)
        out[name] = f.derive(f.df, origin_x=x, origin_y=y)
    return out


def level_coefficients(keys: dict) -> tuple[list[float], list[float]] | None:
    """``ak`` and ``bk`` of hybrid half levels from the header's ``pv``, None without."""
    pv = keys.get("pv")
    return None if pv is None else (list(pv[: len(pv) // 2]), list(pv[len(pv) // 2:]))
