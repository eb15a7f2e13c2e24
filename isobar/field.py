"""Fields: a DataFrame in long layout, one row per grid point and level, with metadata beside it.

Dimensions are the columns of ``DIMS`` that a frame has. ``k`` counts model levels from the top;
``target`` is the value of a level of another kind, in its own unit (Pa, K, m). NULL is undefined.
Operators take frames with a column per parameter and windows over their dimensions.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from isobar.grid import GRID_KEYS, RegularGrid

DIMS = ("eps", "ref_time", "lead_s", "k", "target", "y", "x", "cell")


@dataclass(frozen=True)
class FieldMeta:
    """What a field's values do not say: name, units, level type, staggering, grid, header keys."""

    name: str
    units: str = ""
    vcoord_type: str = "model_level"
    origin_x: float | None = None
    origin_y: float | None = None
    origin_z: float = 0.0
    vref: str = "native"
    grid_id: str = ""
    keys: dict = field(default_factory=dict)

    def override(self, **values) -> FieldMeta:
        """A copy with attributes or header keys replaced."""
        own = {k: v for k, v in values.items() if k in self.__dataclass_fields__}
        rest = {k: v for k, v in values.items() if k not in own}
        return replace(self, **own, keys=self.keys | rest)

    @property
    def grid(self) -> RegularGrid:
        """The grid that the header keys say."""
        return RegularGrid.from_header(self.keys)

    def on_grid(self, grid: RegularGrid, **values) -> FieldMeta:
        """A copy for the same field on another grid: all keys that follow from a grid are replaced,
        and points are not shifted. Vectors are along geographic axes unless the grid is rotated."""
        rest = {k: v for k, v in self.keys.items() if k not in GRID_KEYS}
        own = {"origin_x": 0.0, "origin_y": 0.0, "grid_id": "", "vref": "native" if grid.pole else "geo"} | values
        return replace(self, keys=rest | grid.keys()).override(**own)

    @property
    def is_staggered_horizontal(self) -> bool:
        """Unstructured grids are not; others have to have their origin set."""
        if self.keys.get("gridType") == "unstructured_grid":
            return False
        if self.origin_x is None or self.origin_y is None:
            raise ValueError(f"the origin of {self.name} is not set")
        return bool(self.origin_x or self.origin_y)


@dataclass(frozen=True)
class Field:
    df: DataFrame
    meta: FieldMeta

    def derive(self, df: DataFrame, **values) -> Field:
        return Field(df, self.meta.override(**values))


def dims(df: DataFrame, without: str = "") -> list[str]:
    return [c for c in DIMS if c in df.columns and c != without]


def along(df: DataFrame, dim: str) -> WindowSpec:
    """Rows that differ in ``dim`` only, in its order."""
    if dim not in df.columns:
        raise ValueError(f"no dimension {dim}")
    return Window.partitionBy(*dims(df, dim)).orderBy(dim)


def align(a: DataFrame, b: DataFrame) -> DataFrame:
    """Equi-join on the shared dimensions: label alignment, and broadcasting over absent ones."""
    return a.join(b, [c for c in dims(a) if c in b.columns])


def missing_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Combinations of the values seen of each key for which ``df`` has no row. The product is of
    distinct key values (members, times, levels), never of points."""
    grid = None
    for key in keys:
        values = df.select(key).distinct()
        grid = values if grid is None else grid.crossJoin(values)
    return grid.join(df.select(*keys).distinct(), keys, "left_anti")


def require_dense(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``, or RuntimeError that names up to ten of the missing combinations."""
    if df.isEmpty():
        raise RuntimeError("no values")
    gaps = missing_keys(df, keys).limit(10).collect()
    if gaps:
        raise RuntimeError("missing: " + ", ".join(str(tuple(r)) for r in gaps))
    return df


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n``: keys of more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
