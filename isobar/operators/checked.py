"""Operators on fields with metadata: they check that a field fits before a plan is built, and
say in the result what has changed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.field import Field, align, dims
from isobar.functions import atmo
from isobar.grid import RegularGrid
from isobar.metadata import level_coefficients

from . import dynamics, gis, stagger, timeops, vertical
from .projections import rotate_vector, rotated_to_geographic

#: Components of wind. Fixed values.
WIND = ("U", "V", "U_10M", "V_10M")


def destagger(field: Field, dim: str, value: str = "value") -> Field:
    """:func:`stagger.destagger`; ValueError unless the field is staggered along ``dim``."""
    if dim in ("x", "y"):
        if getattr(field.meta, f"origin_{dim}") != 0.5:
            raise ValueError(f"{field.meta.name} is not staggered along {dim}")
        first, step = (("longitude", "i") if dim == "x" else ("latitude", "j"))
        keys = dict(field.meta.keys)
        inc = keys.get(f"{step}DirectionIncrementInDegrees")
        moved = {k: keys[k] - 0.5 * inc for k in (f"{first}OfFirstGridPointInDegrees", f"{first}OfLastGridPointInDegrees") if inc and k in keys}
        return field.derive(stagger.destagger(field.df, dim, [value]), **{f"origin_{dim}": 0.0}, **moved)
    if dim != "k":
        raise ValueError(f"unknown dimension {dim}")
    if field.meta.origin_z != -0.5:
        raise ValueError(f"{field.meta.name} is not on half levels")
    layers = {"typeOfLevel": "generalVerticalLayer"} if field.meta.keys.get("typeOfLevel") == "generalVertical" else {}
    return field.derive(stagger.destagger(field.df, "k", [value]), origin_z=0.0, **layers)


def _wind(u: Field, v: Field) -> DataFrame:
    return align(u.df.withColumnRenamed("value", "_u"), v.df.withColumnRenamed("value", "_v"))


def to_geographic_axes(u: Field, v: Field) -> tuple[Field, Field]:
    """Wind along rotated axes to geographic ones; ValueError for staggered components and for
    grids that are not rotated."""
    if u.meta.is_staggered_horizontal or v.meta.is_staggered_horizontal:
        raise ValueError("the wind is staggered")
    pole, grid = gis.north_pole(u.meta.keys), gis.RegularGrid.from_header(u.meta.keys)
    at = _wind(u, v)
    lon, lat = rotated_to_geographic(grid.x0 + F.col("x") * grid.dx, grid.y0 + F.col("y") * grid.dy, pole)
    ug, vg = rotate_vector(F.col("_u"), F.col("_v"), lon, lat, pole)
    return tuple(f.derive(at.select(*dims(f.df), e.alias("value")), vref="geo", uvRelativeToGrid=0) for f, e in ((u, ug), (v, vg)))


def wind_direction(u: Field, v: Field) -> Field:
    """Degrees from which the wind blows; native components are rotated first. ValueError if they
    refer to different axes."""
    if u.meta.vref != v.meta.vref:
        raise ValueError("the components refer to different axes")
    if u.meta.vref == "native":
        u, v = to_geographic_axes(u, v)
    return u.derive(_wind(u, v).select(*dims(u.df), atmo.wind_direction(F.col("_u"), F.col("_v")).alias("value")), name="DD", units="degrees")


def wind_speed(u: Field, v: Field) -> Field:
    """ValueError for staggered components and for other fields than wind."""
    if u.meta.is_staggered_horizontal or v.meta.is_staggered_horizontal:
        raise ValueError("the wind is staggered")
    if u.meta.name not in ("U", "U_10M"):
        raise ValueError(f"{u.meta.name} is no wind component")
    return u.derive(_wind(u, v).select(*dims(u.df), atmo.wind_speed(F.col("_u"), F.col("_v")).alias("value")), name="FF", units="m s-1")


def interpolate_k2p(field: Field, pressure: Field, targets: Sequence[float], mode: str, unit: str = "Pa") -> Field:
    """:func:`vertical.interpolate_k2p`; ValueError unless both fields are on full model levels and
    share their dimensions."""
    for f in (field, pressure):
        if f.meta.vcoord_type != "model_level" or f.meta.origin_z != 0.0:
            raise ValueError(f"{f.meta.name} is not on full model levels")
    if dims(field.df) != dims(pressure.df):
        raise ValueError("the fields differ in their dimensions")
    both = align(field.df, pressure.df.withColumnRenamed("value", "_p"))
    return field.derive(vertical.interpolate_k2p(both, "value", "_p", targets, mode, unit), vcoord_type="pressure")


def crop(field: Field, xmin: int, xmax: int, ymin: int, ymax: int) -> Field:
    """:func:`gis.crop`, with the header's corners and counts following."""
    grid, meta = field.meta.grid, field.meta
    df = gis.crop(field.df, xmin, xmax, ymin, ymax, grid.nx, grid.ny)
    own = replace(grid, nx=xmax - xmin + 1, ny=ymax - ymin + 1, x0=grid.x0 + xmin * grid.dx, y0=grid.y0 + ymin * grid.dy)
    return Field(df, meta.on_grid(own, origin_x=meta.origin_x, origin_y=meta.origin_y, vref=meta.vref, grid_id=meta.grid_id))


def clip(field: Field, cells: DataFrame, n: int, grid_id: str | None = None) -> Field:
    """:func:`gis.clip_strip` of a field on cells, with a new grid identifier; ValueError for other
    grids and for cells of another grid than the field's."""
    if field.meta.keys.get("gridType") != "unstructured_grid":
        raise ValueError("only unstructured grids are clipped")
    if grid_id is not None and grid_id != field.meta.grid_id:
        raise ValueError("the cells belong to another grid")
    return field.derive(gis.clip_strip(field.df, cells, n), grid_id=gis.clipped_grid_uuid(field.meta.grid_id, n))


def on_new_levels(field: Field, targets: Sequence[float], vcoord_type: str, fill: float | None = None) -> Field:
    """A field of one value on other levels, at the points and times of ``field``."""
    points = field.df.select(*dims(field.df, "k")).distinct()
    rows = points.select("*", F.explode(F.array(*[F.lit(float(t)) for t in targets])).alias("target"), F.lit(fill).cast("double").alias("value"))
    return field.derive(rows, vcoord_type=vcoord_type)


def regrid(field: Field, target: RegularGrid, method: str = "bilinear") -> Field:
    """:func:`gis.regrid` with a row for every point of ``target`` and a header that says so. Wind
    components have to be along geographic axes before (:func:`to_geographic_axes`)."""
    meta = field.meta
    if meta.name in WIND and meta.vref == "native" and meta.keys.get("gridType") == "rotated_ll" and not target.pole:
        raise ValueError(f"{meta.name} is along the axes of its own grid")
    df = gis.regrid(field.df, "value", meta.grid, target, method)
    return Field(gis.dense(df, target, field.df), meta.on_grid(target))


def _time_range(dtime_s: int, processing: int | None) -> dict:
    out = {"lengthOfTimeRange": dtime_s // 60, "indicatorOfUnitForTimeRange": 0}
    return out if processing is None else out | {"typeOfStatisticalProcessing": processing}


def time_rate(field: Field, dtime_s: int) -> Field:
    """:func:`timeops.time_rate`; the header no longer names a statistic."""
    return field.derive(timeops.time_rate(field.df, "value", dtime_s), typeOfStatisticalProcessing=255)


def delta(field: Field, dtime_s: int) -> Field:
    """:func:`timeops.delta`, a difference over the range."""
    return field.derive(timeops.delta(field.df, "value", dtime_s), **_time_range(dtime_s, 4))


def resample_average(field: Field, dtime_s: int) -> Field:
    """:func:`timeops.resample_average`, an average over the range."""
    return field.derive(timeops.resample_average(field.df, "value", dtime_s), **_time_range(dtime_s, 0))


def resample(field: Field, dtime_s: int) -> Field:
    """:func:`timeops.resample`; the range is the new step."""
    return field.derive(timeops.resample(field.df, dtime_s), **_time_range(dtime_s, None))


def _on_full_levels(*fields: Field) -> DataFrame:
    """The fields side by side, as columns ``_0``, ``_1`` and so on; ValueError unless all are on full
    model levels and share their dimensions."""
    for f in fields:
        if f.meta.vcoord_type != "model_level" or f.meta.origin_z != 0.0:
            raise ValueError(f"{f.meta.name} is not on full model levels")
        if dims(f.df) != dims(fields[0].df):
            raise ValueError("the fields differ in their dimensions")
    return reduce(align, [f.df.select(*dims(f.df), F.col("value").alias(f"_{i}")) for i, f in enumerate(fields)])


def interpolate_k2theta(field: Field, theta: Field, targets: Sequence[float], height: Field, mode: str, unit: str = "K") -> Field:
    """:func:`vertical.interpolate_k2theta` with its checks."""
    return field.derive(vertical.interpolate_k2theta(_on_full_levels(field, theta, height), "_0", "_1", targets, "_2", mode, unit), vcoord_type="theta")


def interpolate_k2any(field: Field, target_field: Field, targets: Sequence[float], height: Field, mode: str) -> Field:
    """:func:`vertical.interpolate_k2any` with its checks; the levels are values of ``target_field``."""
    return field.derive(vertical.interpolate_k2any(_on_full_levels(field, target_field, height), "_0", "_1", targets, "_2", mode), vcoord_type=target_field.meta.name.lower())


def _bounds(both: DataFrame, bottom: Field | float, top: Field | float) -> DataFrame:
    for name, bound in (("_b", bottom), ("_t", top)):
        both = align(both, bound.df.select(*dims(bound.df), F.col("value").alias(name))) if isinstance(bound, Field) else both.withColumn(name, F.lit(float(bound)))
    return both


def minmax_k(field: Field, height: Field, bottom: Field | float, top: Field | float, operator: str) -> Field:
    """:func:`vertical.minmax_k` with its checks; a bound is a height or a field of heights."""
    both = _bounds(_on_full_levels(field, height), bottom, top)
    return field.derive(vertical.minmax_k(both, "_0", "_1", "_b", "_t", operator), vcoord_type="surface")


def integrate_k(field: Field, half_height: Field, bottom: Field | float, top: Field | float, operator: str = "integral") -> Field:
    """:func:`vertical.integrate_k` of a field on full levels over heights of half levels."""
    if half_height.meta.origin_z != -0.5 or field.meta.origin_z != 0.0:
        raise ValueError("a field on full levels and heights of half levels are wanted")
    both = half_height.df.select(*dims(half_height.df), F.col("value").alias("_1"))
    both = both.join(field.df.select(*dims(field.df), F.col("value").alias("_0")), dims(field.df), "left")
    return field.derive(vertical.integrate_k(_bounds(both, bottom, top), "_0", "_1", "_b", "_t", operator), vcoord_type="surface")


def zero_isotherm(t: Field, height: Field, extrapolate: bool = False) -> Field:
    """:func:`vertical.zero_isotherm` with its checks."""
    return t.derive(vertical.zero_isotherm(_on_full_levels(t, height), "_0", "_1", extrapolate), name="HZEROCL", units="m", vcoord_type="surface")


def bulk_richardson(theta_v: Field, u: Field, v: Field, height: Field, surface: Field) -> Field:
    """:func:`dynamics.bulk_richardson`; ValueError for wind that is not on mass points."""
    for f in (u, v):
        if f.meta.is_staggered_horizontal:
            raise ValueError("the wind is staggered")
    both = align(_on_full_levels(theta_v, u, v, height), surface.df.select(*dims(surface.df), F.col("value").alias("_4")))
    return theta_v.derive(dynamics.bulk_richardson(both, "_0", "_1", "_2", "_3", "_4").select(*dims(both), "value"), name="BRN", units="1")


def _cube(full: dict[str, Field], half: dict[str, Field]) -> DataFrame:
    """Fields on full and on half levels side by side, a row for each half level. ValueError unless they
    are on the levels said, on mass points of one grid, and share their dimensions."""
    first = next(iter(half.values()))
    for fields, z in ((full, 0.0), (half, -0.5)):
        for f in fields.values():
            if f.meta.vcoord_type != "model_level" or f.meta.origin_z != z:
                raise ValueError(f"{f.meta.name} is not on {'full' if z == 0 else 'half'} model levels")
            if f.meta.is_staggered_horizontal:
                raise ValueError(f"{f.meta.name} is staggered")
            if dims(f.df) != dims(first.df):
                raise ValueError("the fields differ in their dimensions")
    column = lambda n, f: f.df.select(*dims(f.df), F.col("value").alias(f"_{n}"))
    below = reduce(align, [column(n, f) for n, f in half.items()])
    return reduce(lambda a, b: a.join(b, dims(first.df), "left"), [column(n, f) for n, f in full.items()], below)


def _with_latitudes(df: DataFrame, grid: RegularGrid) -> DataFrame:
    """``_rlat`` along the grid's own axis and ``_lat`` on the globe, in radians."""
    gx, gy = grid.x0 + F.col("x") * grid.dx, grid.y0 + F.col("y") * grid.dy
    return df.withColumns({"_rlat": F.radians(gy), "_lat": F.radians(grid.system.to_geographic(gx, gy)[1])})


def curl(u: Field, v: Field, w: Field, hhl: Field) -> dict[str, Field]:
    """:func:`dynamics.curl` on the grid of ``u``: fields ``curl_1``, ``curl_2`` and ``curl_3`` on full
    levels. ValueError for wind that is staggered or along geographic axes."""
    if "geo" in (u.meta.vref, v.meta.vref):
        raise ValueError("the wind is along geographic axes")
    grid = u.meta.grid
    df = dynamics.curl(_with_latitudes(_cube({"u": u, "v": v}, {"w": w, "h": hhl}), grid), "_u", "_v", "_w", "_h", "_rlat", grid.dx, grid.dy)
    names = ("curl_1", "curl_2", "curl_3")
    return {n: u.derive(df.select(*dims(df), F.col(n).alias("value")), name=n.upper(), units="s-1") for n in names}


def potential_vorticity(u: Field, v: Field, w: Field, theta: Field, rho: Field, hhl: Field) -> Field:
    """:func:`dynamics.potential_vorticity` with the checks of :func:`curl`."""
    if "geo" in (u.meta.vref, v.meta.vref):
        raise ValueError("the wind is along geographic axes")
    grid = u.meta.grid
    cube = _with_latitudes(_cube({"u": u, "v": v, "th": theta, "rho": rho}, {"w": w, "h": hhl}), grid)
    df = dynamics.potential_vorticity(cube, "_u", "_v", "_w", "_th", "_rho", "_h", "_rlat", "_lat", grid.dx, grid.dy)
    return theta.derive(df.select(*dims(df), "value"), name="POT_VORTIC", units="K m2 kg-1 s-1")


def omega_slope(etadot: Field, ps: Field) -> Field:
    """:func:`dynamics.omega_slope`, with the level coefficients of the header's ``pv``. ValueError for
    fields that are not on half levels or whose header has no coefficients."""
    if etadot.meta.vcoord_type != "model_level" or etadot.meta.origin_z != -0.5:
        raise ValueError(f"{etadot.meta.name} is not on half model levels")
    found = level_coefficients(etadot.meta.keys)
    if found is None:
        raise ValueError("the header has no level coefficients")
    ak, bk = (F.get(F.array(*[F.lit(float(x)) for x in own]), F.col("k") - 1) for own in found)
    both = align(etadot.df, ps.df.select(*dims(ps.df), F.col("value").alias("_ps"))).withColumns({"_ak": ak, "_bk": bk})
    df = dynamics.omega_slope(both, "value", "_ps", "_ak", "_bk", "_out")
    return etadot.derive(df.select(*dims(etadot.df), F.col("_out").alias("value")), name="OMEGA", units="Pa s-1", origin_z=0.0)


def remap_to_grid(field: Field, goal: str, weights: DataFrame, grids: DataFrame) -> Field:
    """A field on cells on one of the regular grids that weights have been made for.

    ``weights(grid_id, goal, dst, slot, cell, w, found)`` with ``dst`` = y * nx + x, and ``grids(grid_id,
    goal, nx, ny, xmin, ymin, xmax, ymax, pole_lon, pole_lat)``, poles null for geographic grids, by the
    identifier of the field's own grid. ValueError for other fields, KeyError without such a grid.
    """
    if field.meta.keys.get("gridType") != "unstructured_grid":
        raise ValueError("only unstructured grids are remapped by cells")
    own = (F.col("grid_id") == field.meta.grid_id) & (F.col("goal") == goal)
    g = grids.where(own).first()  # one row
    if g is None:
        raise KeyError(f"no grid {goal} for {field.meta.grid_id}")
    steps = [(high - low) / (n - 1) if n > 1 else 1.0 for low, high, n in ((g.xmin, g.xmax, g.nx), (g.ymin, g.ymax, g.ny))]
    target = RegularGrid(g.nx, g.ny, g.xmin, g.ymin, *steps, None if g.pole_lon is None else (g.pole_lon, g.pole_lat))
    done = gis.remap(field.df, "value", weights.where(own).drop("grid_id", "goal"))
    y, x = F.floor(F.col("dst") / g.nx).cast("int"), (F.col("dst") % g.nx).cast("int")
    rest = [d for d in dims(field.df) if d != "cell"]
    return Field(done.select(*rest, y.alias("y"), x.alias("x"), "value"), field.meta.on_grid(target, vref=field.meta.vref))
