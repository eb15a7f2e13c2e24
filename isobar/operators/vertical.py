"""Vertical interpolation, reduction, integration and the zero isotherm.

All work in columns of the cube: one window over a column's levels and, where levels are reduced,
one aggregation by the same keys, so that a plan has a single exchange, whatever the number of
target levels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar import constants as c
from isobar.field import along, dims

P_UNITS = {"Pa": 1.0, "hPa": 100.0}
THETA_UNITS = {"K": 1.0, "cK": 0.01}


def _targets(values: Sequence[float], unit: str, units: dict[str, float], low: float, high: float) -> list[float]:
    if unit not in units:
        raise RuntimeError(f"units are {', '.join(units)}, not {unit}")
    out = [v * units[unit] for v in values]
    if any(not low <= v <= high for v in out):
        raise RuntimeError(f"targets lie between {low} and {high}")
    return out


def _per_target(df: DataFrame, targets: Sequence[float], found, out: str) -> DataFrame:
    """One row for each column and target: ``found(target)`` is an aggregate."""
    wide = df.groupBy(*dims(df, "k")).agg(*[found(t).alias(f"_{i}") for i, t in enumerate(targets)])
    rows = F.array(*[F.struct(F.lit(float(t)).alias("target"), F.col(f"_{i}").alias(out)) for i, t in enumerate(targets)])
    return wide.select(*dims(df, "k"), F.explode(rows).alias("_row")).select(*dims(df, "k"), "_row.*")


def interpolate_k2p(df: DataFrame, field: str, pressure: str, targets: Sequence[float], mode: str, unit: str = "Pa", out: str = "value") -> DataFrame:
    """``field`` on pressure levels: ``target`` in Pa, ascending.

    The bracket is the level of least pressure greater than the target whose upper neighbour has
    at most the target; none gives NULL. Modes: linear_in_p, linear_in_lnp, nearest_sfc.
    """
    if mode not in ("linear_in_p", "linear_in_lnp", "nearest_sfc"):
        raise RuntimeError(f"unknown mode {mode}")
    levels = sorted(_targets(targets, unit, P_UNITS, 1.0, 120000.0))
    w = along(df, "k")
    near = df.select(*dims(df), F.col(field).alias("f2"), F.col(pressure).alias("p2"), F.lag(field).over(w).alias("f1"), F.lag(pressure).over(w).alias("p1"))

    def found(p0: float) -> Column:
        inside = (F.col("p2") > p0) & (F.col("p1") <= p0)
        if mode == "nearest_sfc":
            ratio = F.when(F.abs(p0 - F.col("p1")) >= F.abs(p0 - F.col("p2")), 1.0).otherwise(0.0)
        elif mode == "linear_in_p":
            ratio = (p0 - F.col("p1")) / (F.col("p2") - F.col("p1"))
        else:
            ratio = (F.ln(F.lit(p0)) - F.ln("p1")) / (F.ln("p2") - F.ln("p1"))
        return F.min_by((1 - ratio) * F.col("f1") + ratio * F.col("f2"), F.when(inside, F.struct("p2", "k")))

    return _per_target(near, levels, found, out)


def interpolate_k2any(df: DataFrame, field: str, target_field: str, targets: Sequence[float], height: str, mode: str, out: str = "value") -> DataFrame:
    """``field`` where ``target_field`` has the target values. Several crossings in a column:
    ``low_fold`` takes the lowest, ``high_fold`` the highest, ``undef_fold`` gives NULL."""
    if mode not in ("low_fold", "high_fold", "undef_fold"):
        raise ValueError(f"unknown mode {mode}")
    w = along(df, "k")
    near = df.select(*dims(df), F.col(field).alias("f2"), F.col(target_field).alias("t2"), F.col(height).alias("h2"),
                     F.lag(field).over(w).alias("f1"), F.lag(target_field).over(w).alias("t1"))

    def found(t0: float) -> Column:
        inside = ((F.col("t2") >= t0) & (F.col("t1") <= t0)) | ((F.col("t2") <= t0) & (F.col("t1") >= t0))
        ratio = F.when(F.col("t2") == F.col("t1"), 0.0).otherwise((t0 - F.col("t1")) / F.nullif(F.col("t2") - F.col("t1"), F.lit(0.0)))
        value = (1 - ratio) * F.col("f1") + ratio * F.col("f2")
        if mode == "high_fold":
            return F.max_by(value, F.when(inside, F.struct("h2", (-F.col("k")).alias("k"))))
        lowest = F.min_by(value, F.when(inside, F.struct("h2", "k")))
        return lowest if mode == "low_fold" else F.when(F.count_if(inside) == 1, lowest)

    return _per_target(near, [float(t) for t in targets], found, out)


def interpolate_k2theta(df: DataFrame, field: str, theta: str, targets: Sequence[float], height: str, mode: str, unit: str = "K", out: str = "value") -> DataFrame:
    """:func:`interpolate_k2any` on potential temperature, 1 to 1000 K; targets keep their order."""
    return interpolate_k2any(df, field, theta, _targets(targets, unit, THETA_UNITS, 1.0, 1000.0), height, mode, out)


def extrapolate_k2p(df: DataFrame, field: str, target: float, out: str = "value") -> DataFrame:
    """The lowest level's values at the pressure ``target``."""
    return df.groupBy(*dims(df, "k")).agg(F.max_by(field, "k").alias(out)).withColumn("target", F.lit(float(target)))


def minmax_k(df: DataFrame, field: str, height: str, bottom: str, top: str, operator: str, mode: str = "z2z", out: str = "value") -> DataFrame:
    """Extremum between two heights (columns): of the levels inside, bounds included, and of the
    values at both bounds, linear in height between the levels around them."""
    if operator not in ("minimum", "maximum"):
        raise RuntimeError(f"unknown operator {operator}")
    if mode not in ("z2z", "h2z", "z2h", "h2h"):
        raise RuntimeError(f"unknown mode {mode}")
    if mode != "z2z":
        raise NotImplementedError(f"mode {mode}")
    w = along(df, "k")
    f, h = F.col(field), F.col(height)
    f_low, h_low = F.lead(field).over(w), F.lead(height).over(w)
    rows = df.select(*dims(df), f.alias("f"), h.alias("h"), f_low.alias("f_low"), h_low.alias("h_low"), F.col(bottom).alias("bottom"), F.col(top).alias("top"))
    inside = F.when(F.col("h").between(F.col("bottom"), F.col("top")), F.col("f"))
    at = lambda b: F.when((F.col("h") > F.col(b)) & (F.col("h_low") < F.col(b)),
                          F.col("f") + (F.col("f") - F.col("f_low")) / F.nullif(F.col("h") - F.col("h_low"), F.lit(0.0)) * (F.col(b) - F.col("h")))
    whole, pick = (F.max, F.greatest) if operator == "maximum" else (F.min, F.least)
    return rows.groupBy(*dims(df, "k")).agg(whole(pick(inside, at("bottom"), at("top"))).alias(out))


def integrate_k(df: DataFrame, field: str, half_height: str, bottom: str, top: str, operator: str = "integral", mode: str = "z2z", out: str = "value") -> DataFrame:
    """Integral of ``field`` (full levels; the row of the lowest half level has no value) over height.

    A layer counts if its middle lies between the bounds, with the part of its depth that the
    bounds leave, the bottom overriding the top; ``normed_integral`` divides by top less bottom.
    """
    if operator not in ("integral", "normed_integral"):
        raise RuntimeError(f"unknown operator {operator}")
    if mode != "z2z":
        raise NotImplementedError(f"mode {mode}")
    w = along(df, "k")
    rows = df.select(*dims(df), F.col(field).alias("f"), F.col(half_height).alias("up"), F.lead(half_height).over(w).alias("low"), F.col(bottom).alias("b"), F.col(top).alias("t"))
    depth = (F.when((F.col("low") < F.col("b")) & (F.col("up") > F.col("b")), F.col("up") - F.col("b"))
             .when((F.col("up") > F.col("t")) & (F.col("low") < F.col("t")), F.col("t") - F.col("low")).otherwise(F.col("up") - F.col("low")))
    counts = (0.5 * (F.col("up") + F.col("low"))).between(F.col("b"), F.col("t"))
    total = F.sum(F.when(counts, F.col("f") * depth))
    if operator == "normed_integral":
        total = total / F.nullif(F.max(F.col("t") - F.col("b")), F.lit(0.0))
    return rows.groupBy(*dims(df, "k")).agg(total.alias(out))


def zero_isotherm(df: DataFrame, t: str, height: str, extrapolate: bool = False, out: str = "value") -> DataFrame:
    """Height of 273.15 K: between the highest level at or above it and its colder upper neighbour.

    With ``extrapolate``, columns frozen throughout go on downwards from their two lowest levels
    where temperature increases downwards and the height found is positive.
    """
    w = along(df, "k")
    rows = df.select(*dims(df), F.col(t).alias("t2"), F.col(height).alias("h2"), F.lag(t).over(w).alias("t1"), F.lag(height).over(w).alias("h1"))
    value = F.col("h1") + (F.col("h2") - F.col("h1")) * (c.T_FREEZE - F.col("t1")) / F.nullif(F.col("t2") - F.col("t1"), F.lit(0.0))
    crossing = F.when((F.col("t2") >= c.T_FREEZE) & (F.col("t1") < c.T_FREEZE), F.col("k"))
    found = F.min_by(value, crossing)
    if extrapolate:
        frozen = F.bool_and(F.coalesce(F.col("t2") < c.T_FREEZE, F.lit(False)))
        down = F.max_by(F.when((F.col("t2") - F.col("t1") > 1e-10) & (value > 0), value), "k")
        found = F.when(frozen, down).otherwise(found)
    return rows.groupBy(*dims(df, "k")).agg(found.alias(out))
