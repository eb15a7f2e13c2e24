"""The vertical operators on columns: one row for each member, time and place, levels as arrays.

Arrays run from the top, as ``k`` does. A column is whole in its row, so nothing is shuffled and no
window is sorted; results are those of :mod:`vertical`. :func:`to_columns` costs one shuffle, which
pays for several operators on one cube; tables that hold columns, as model output by point does, need
none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar import constants as c
from isobar.field import dims

from .vertical import P_UNITS, _targets


def to_columns(df: DataFrame, *columns: str) -> DataFrame:
    """Levels of long rows gathered into arrays, in the order of ``k``; a missing level is not there."""
    rows = F.sort_array(F.collect_list(F.struct("k", *columns)))
    return df.groupBy(*dims(df, "k")).agg(rows.alias("_rows")).select(*dims(df, "k"), *[F.col("_rows")[name].alias(name) for name in columns])


def to_levels(df: DataFrame, *columns: str) -> DataFrame:
    """Long rows again, with ``k`` from 1."""
    rows = F.posexplode(F.arrays_zip(*columns)).alias("_i", "_row")
    return df.select(*dims(df), rows).select(*dims(df), (F.col("_i") + 1).alias("k"), *[F.col("_row")[name].alias(name) for name in columns])


def neighbours(**arrays: Column) -> Column:
    """For each level but the first a struct of its place ``k`` and, of each array, the value above
    (``name1``) and its own (``name2``)."""
    n = F.size(next(iter(arrays.values())))
    return F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.struct((i + 1).alias("k"), *[
        F.get(a, i - 1 + own).alias(f"{name}{own + 1}") for name, a in arrays.items() for own in (0, 1)]))


def midpoints(a: Column) -> Column:
    """Half levels to the full levels between them."""
    n = F.size(a)
    return F.zip_with(F.slice(a, F.lit(1), n - 1), F.slice(a, F.lit(2), n - 1), lambda x, y: 0.5 * (x + y))


def interpolate_k2p(df: DataFrame, field: str, pressure: str, targets: Sequence[float], mode: str, unit: str = "Pa", out: str = "value") -> DataFrame:
    """As :func:`vertical.interpolate_k2p`: a row for each column and ``target``."""
    if mode not in ("linear_in_p", "linear_in_lnp", "nearest_sfc"):
        raise RuntimeError(f"unknown mode {mode}")
    near = df.select(*dims(df), neighbours(f=F.col(field), p=F.col(pressure)).alias("_near"))

    def value(x: Column, p0: float) -> Column:
        if mode == "nearest_sfc":
            ratio = F.when(F.abs(p0 - x["p1"]) >= F.abs(p0 - x["p2"]), 1.0).otherwise(0.0)
        elif mode == "linear_in_p":
            ratio = (p0 - x["p1"]) / (x["p2"] - x["p1"])
        else:
            ratio = (F.ln(F.lit(p0)) - F.ln(x["p1"])) / (F.ln(x["p2"]) - F.ln(x["p1"]))
        return (1 - ratio) * x["f1"] + ratio * x["f2"]

    def found(p0: float) -> Column:
        inside = F.filter("_near", lambda x: (x["p2"] > p0) & (x["p1"] <= p0))
        return F.array_min(F.transform(inside, lambda x: F.struct(x["p2"].alias("p"), x["k"].alias("k"), value(x, p0).alias("value"))))["value"]

    levels = sorted(_targets(targets, unit, P_UNITS, 1.0, 120000.0))
    rows = F.array(*[F.struct(F.lit(float(t)).alias("target"), found(t).alias(out)) for t in levels])
    return near.select(*dims(df), F.explode(rows).alias("_row")).select(*dims(df), "_row.*")


def integrate_k(df: DataFrame, field: str, half_height: str, bottom: Column, top: Column, operator: str = "integral", out: str = "value") -> DataFrame:
    """As :func:`vertical.integrate_k`: ``field`` has a level less than ``half_height``."""
    if operator not in ("integral", "normed_integral"):
        raise RuntimeError(f"unknown operator {operator}")
    h = F.col(half_height)
    rows = df.select(*dims(df), bottom.cast("double").alias("_b"), top.cast("double").alias("_t"), F.transform(
        field, lambda f, i: F.struct(f.alias("f"), F.get(h, i).alias("up"), F.get(h, i + 1).alias("low"))).alias("_layers"))
    b, t = F.col("_b"), F.col("_t")

    def part(x: Column) -> Column:
        depth = F.when((x["low"] < b) & (x["up"] > b), x["up"] - b).when((x["up"] > t) & (x["low"] < t), t - x["low"]).otherwise(x["up"] - x["low"])
        return F.when((0.5 * (x["up"] + x["low"])).between(b, t), x["f"] * depth)

    parts = F.filter(F.transform("_layers", part), lambda v: v.isNotNull())
    total = F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, v: a + v))
    return rows.select(*dims(df), (total / F.nullif(t - b, F.lit(0.0)) if operator == "normed_integral" else total).alias(out))


def zero_isotherm(df: DataFrame, t: str, height: str, extrapolate: bool = False, out: str = "value") -> DataFrame:
    """As :func:`vertical.zero_isotherm`."""
    near = df.select(*dims(df), F.col(t).alias("_t"), neighbours(t=F.col(t), h=F.col(height)).alias("_near"))

    def value(x: Column) -> Column:
        return x["h1"] + (x["h2"] - x["h1"]) * (c.T_FREEZE - x["t1"]) / F.nullif(x["t2"] - x["t1"], F.lit(0.0))

    crossing = F.get(F.filter("_near", lambda x: (x["t2"] >= c.T_FREEZE) & (x["t1"] < c.T_FREEZE)), F.lit(0))
    found = value(crossing)
    if extrapolate:
        frozen = F.forall("_t", lambda v: F.coalesce(v < c.T_FREEZE, F.lit(False)))
        last = F.element_at("_near", -1)
        found = F.when(frozen, F.when((last["t2"] - last["t1"] > 1e-10) & (value(last) > 0), value(last))).otherwise(found)
    return near.select(*dims(df), found.alias(out))


def minmax_k(df: DataFrame, field: str, height: str, bottom: Column, top: Column, operator: str, out: str = "value") -> DataFrame:
    """As :func:`vertical.minmax_k`."""
    if operator not in ("minimum", "maximum"):
        raise RuntimeError(f"unknown operator {operator}")
    f, h = F.col(field), F.col(height)
    rows = df.select(*dims(df), bottom.cast("double").alias("_b"), top.cast("double").alias("_t"), F.transform(
        f, lambda v, i: F.struct(v.alias("f"), F.get(h, i).alias("h"), F.get(f, i + 1).alias("f_low"), F.get(h, i + 1).alias("h_low"))).alias("_levels"))
    whole = F.array_max if operator == "maximum" else F.array_min

    def at(x: Column, bound: Column) -> Column:
        return F.when((x["h"] > bound) & (x["h_low"] < bound), x["f"] + (x["f"] - x["f_low"]) / F.nullif(x["h"] - x["h_low"], F.lit(0.0)) * (bound - x["h"]))

    values = F.transform("_levels", lambda x: whole(F.array(F.when(x["h"].between(F.col("_b"), F.col("_t")), x["f"]), at(x, F.col("_b")), at(x, F.col("_t")))))
    return rows.select(*dims(df), whole(values).alias(out))
