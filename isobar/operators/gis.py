"""Grids, coordinates, cropping, clipping and regridding.

Every target point finds its few source points by arithmetic or by a weight table; an equi-join
on their indices gathers the values. Grid tables are generated, not collected.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar.field import dims
from isobar.grid import RegularGrid, north_pole  # noqa: F401

from .projections import geographic_to_rotated, geographic_to_swiss, rotate_vector, rotated_to_geographic  # noqa: F401


def crop(df: DataFrame, xmin: int, xmax: int, ymin: int, ymax: int, nx: int, ny: int) -> DataFrame:
    """Points between indices, bounds included; indices start from 0 again."""
    if not (0 <= xmin <= xmax < nx and 0 <= ymin <= ymax < ny):
        raise ValueError("bounds lie in the grid, the lower first")
    inside = df.where(F.col("x").between(xmin, xmax) & F.col("y").between(ymin, ymax))
    return inside.withColumns({"x": F.col("x") - xmin, "y": F.col("y") - ymin})


def clip_strip(df: DataFrame, cells: DataFrame, n: int) -> DataFrame:
    """Cells whose boundary strip index in ``cells(cell, strip)`` is not in 1..n."""
    return df.join(cells.where(~F.coalesce(F.col("strip").between(1, n), F.lit(False))).select("cell"), "cell", "left_semi")


def clipped_grid_uuid(grid_uuid: str, n: int) -> str:
    """Identifier of a grid whose first ``n`` boundary strips are gone."""
    return str(uuid.uuid5(uuid.UUID(grid_uuid), str(n)))


def _cubic(d: Column) -> Column:
    """Weight at distance ``d`` in grid steps; convolution with a = -0.5."""
    a = -0.5
    near = (a + 2) * d * d * d - (a + 3) * d * d + 1
    far = a * d * d * d - 5 * a * d * d + 8 * a * d - 4 * a
    return F.when(d <= 1, near).when(d < 2, far).otherwise(0.0)


def regrid(df: DataFrame, column: str, source: RegularGrid, target: RegularGrid, method: str = "bilinear", out: str = "value") -> DataFrame:
    """``column`` of a field on ``source`` at the points of ``target``: nearest, bilinear or cubic.

    Undefined and missing source points are left out and the other weights scaled up; targets
    outside the source grid give no row (:func:`dense` adds them).
    """
    if method not in ("nearest", "bilinear", "cubic"):
        raise ValueError(f"unknown method {method}")
    at = target.points(df.sparkSession)
    gx, gy = source.system.from_geographic(*target.system.to_geographic(F.col("gx"), F.col("gy")))
    if source.system.name == "geolatlon":
        gx = F.pmod(gx - source.x0, F.lit(360.0)) + source.x0
    at = at.select("y", "x", F.round((gx - source.x0) / source.dx, 9).alias("_i"), F.round((gy - source.y0) / source.dy, 9).alias("_j"))
    at = at.where(F.col("_i").between(0, source.nx - 1) & F.col("_j").between(0, source.ny - 1))
    if method == "nearest":
        taps = at.select("y", "x", F.floor(F.col("_i") + 0.5).cast("int").alias("sx"), F.floor(F.col("_j") + 0.5).cast("int").alias("sy"), F.lit(1.0).alias("w"))
    else:
        reach = (0, 1) if method == "bilinear" else (-1, 0, 1, 2)
        weight = (lambda d: 1 - d) if method == "bilinear" else _cubic
        tap = lambda name: F.explode(F.array(*[(F.floor(name) + o).cast("int") for o in reach]))
        taps = at.withColumn("sx", tap("_i")).withColumn("sy", tap("_j"))
        taps = taps.withColumns({"_wx": weight(F.abs(F.col("_i") - F.col("sx"))), "_wy": weight(F.abs(F.col("_j") - F.col("sy")))})
        taps = taps.select("y", "x", "sx", "sy", (F.col("_wx") * F.col("_wy")).alias("w")).where("w <> 0")
    rest = [d for d in dims(df) if d not in ("x", "y")]
    values = df.select(*rest, F.col("x").alias("sx"), F.col("y").alias("sy"), F.col(column).alias("_v")).where("_v is not null")
    return taps.join(values, ["sx", "sy"]).groupBy(*rest, "y", "x").agg((F.sum(F.col("w") * F.col("_v")) / F.sum("w")).alias(out))


def dense(df: DataFrame, grid: RegularGrid, like: DataFrame) -> DataFrame:
    """``df`` with a row for every point of ``grid`` and every member, time and level of ``like``,
    undefined where it has none. Of ``like`` only the distinct values beside places are sent around."""
    rest = [d for d in dims(like) if d not in ("x", "y", "cell")]
    every = grid.points(df.sparkSession).select("y", "x")
    if rest:
        every = every.crossJoin(F.broadcast(like.select(*rest).distinct()))
    return every.join(df, [*rest, "y", "x"], "left").select(*rest, "y", "x", *[c for c in df.columns if c not in (*rest, "y", "x")])


def remap(df: DataFrame, column: str, weights: DataFrame, out: str = "value") -> DataFrame:
    """Weighted sums over stencils: ``weights(dst, slot, cell, w, found)``. A row for every target and
    every member, time and level of the field; a target is undefined if it is not found or any of
    its cells is undefined or missing. Results stay within the stencil's values.
    """
    rest = [d for d in dims(df) if d != "cell"]
    values = df.select(*rest, "cell", F.col(column).alias("_v"))  # a filter by _v would compute the column twice
    sums = weights.join(values, "cell").groupBy(*rest, "dst").agg(
        F.sum(F.col("w") * F.col("_v")).alias("_s"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("_v").alias("_have"))
    targets = weights.groupBy("dst").agg(F.count("*").alias("_need"), F.bool_and("found").alias("_found"))
    if rest:  # members, times and levels, never points
        targets = targets.crossJoin(F.broadcast(df.select(*rest).distinct()))
    whole = F.col("_found") & (F.col("_have") == F.col("_need"))
    return targets.join(sums, [*rest, "dst"], "left").select(*rest, "dst", F.when(whole, F.greatest("_low", F.least("_high", "_s"))).alias(out))


def coefficients(table: DataFrame, grid_id: str) -> DataFrame:
    """Of a table of weights for many source grids (``grid_id`` and the columns of :func:`remap`),
    those of one grid; KeyError if it has none."""
    own = table.where(F.col("grid_id") == grid_id).drop("grid_id")
    if own.isEmpty():
        raise KeyError(f"no weights for grid {grid_id}")
    return own
