"""Operators on terrain-following cubes: metric terms, curl, potential vorticity, bulk Richardson
number, omega slope.

Differences along x, y and k need one exchange each. Those along x and y do not touch the levels, so
all of them are taken first, each direction once; everything along k follows in one window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobar import constants as c
from isobar.field import along, dims

from .stagger import central


def metric_terms(df: DataFrame, hhl: str, dlon: float, dlat: float) -> DataFrame:
    """``sqrtg, dzeta_dlam, dzeta_dphi`` on full levels from half-level heights; increments in
    degrees. The rows of the lowest half level go."""
    dlam, dphi = math.radians(dlon), math.radians(dlat)
    out = df.withColumn("_hx", central(df, "x", hhl))
    out = out.withColumn("_hy", central(out, "y", hhl))
    w = along(out, "k")
    s = -1 / F.nullif(F.lead(hhl).over(w) - F.col(hhl), F.lit(0.0))
    mid = lambda col: 0.5 * (F.col(col) + F.lead(col).over(w))
    out = out.withColumns({"sqrtg": s, "_mx": mid("_hx"), "_my": mid("_hy"), "_more": F.lead(F.lit(1)).over(w)}).where("_more = 1")
    return out.withColumns({"dzeta_dlam": F.col("sqrtg") / dlam * F.col("_mx"), "dzeta_dphi": F.col("sqrtg") / dphi * F.col("_my")}).drop("_hx", "_hy", "_mx", "_my", "_more")


def _prepared(df: DataFrame, fields: dict[str, str], dlon: float, dlat: float) -> DataFrame:
    """Derivatives of a cube of half levels whose row k also has the full level below: ``lam_``,
    ``phi_`` and ``zeta_`` of each field of ``fields`` (name here to column), and the fields. ``h`` and
    ``w`` are on half levels; ``w`` comes out on full ones. The rows of the lowest half level go."""
    dlam, dphi = math.radians(dlon), math.radians(dlat)
    full = [n for n in fields if n not in ("h", "w") and not n.startswith("at_")]
    level = [*full, "h", "w"]
    out = df.select(*dims(df), *[F.col(c).alias(n) for n, c in fields.items()])
    for d in ("x", "y"):
        out = out.withColumns({f"{d}_{n}": central(out, d, n) for n in level})
    k = along(out, "k")
    below = lambda n: F.lead(n).over(k)
    mid = lambda n: 0.5 * (F.col(n) + below(n))
    last = F.lead(F.lit(1), 2).over(k).isNull()  # of the full levels
    z = {n: F.when(F.row_number().over(k) == 1, below(n) - F.col(n)).when(last, F.col(n) - F.lag(n).over(k)).otherwise(0.5 * (below(n) - F.lag(n).over(k))) for n in full}
    z["w"] = below("w") - F.col("w")
    columns = {f"z_{n}": e for n, e in z.items()} | {"w": mid("w"), "x_w": mid("x_w"), "y_w": mid("y_w"), "x_h": mid("x_h"), "y_h": mid("y_h"),
                                                     "s": -1 / F.nullif(below("h") - F.col("h"), F.lit(0.0)), "more": F.lead(F.lit(1)).over(k)}
    out = out.withColumns(columns).where("more = 1")
    slope = {"lam": F.col("s") / dlam * F.col("x_h"), "phi": F.col("s") / dphi * F.col("y_h")}
    total = {}
    for n in (*full, "w"):
        total |= {f"lam_{n}": F.col(f"x_{n}") / dlam + F.col(f"z_{n}") * slope["lam"], f"phi_{n}": F.col(f"y_{n}") / dphi + F.col(f"z_{n}") * slope["phi"],
                  f"zeta_{n}": F.col(f"z_{n}") * F.col("s")}
    return out.select(*dims(df), *full, *[n for n in fields if n.startswith("at_")], *[e.alias(n) for n, e in total.items()])


def _curl() -> dict:
    """Components from the prepared derivatives: sums of coefficient times term, on a sphere."""
    r, across = 1 / c.RADIUS, 1 / (c.RADIUS * F.cos("at_rlat"))
    terms = {"curl_1": ((across * r, "phi_w"), (across, "zeta_v"), (-across * r, "v")),
             "curl_2": ((-r, "zeta_u"), (-r * across, "lam_w"), (r * r, "u")),
             "curl_3": ((across, "lam_v"), (-r, "phi_u"), (r * F.tan("at_rlat"), "u"))}
    return {name: sum((k * F.col(t) for k, t in own[1:]), own[0][0] * F.col(own[0][1])) for name, own in terms.items()}


def curl(df: DataFrame, u: str, v: str, w: str, hhl: str, rlat: str, dlon: float, dlat: float) -> DataFrame:
    """``curl_1, curl_2, curl_3`` of the wind; u, v on mass points, w and ``hhl`` on half levels,
    ``rlat`` the rotated latitude in radians."""
    ready = _prepared(df, {"u": u, "v": v, "w": w, "h": hhl, "at_rlat": rlat}, dlon, dlat)
    return ready.select(*dims(df), *[e.alias(n) for n, e in _curl().items()])


def potential_vorticity(df: DataFrame, u: str, v: str, w: str, theta: str, rho: str, hhl: str, rlat: str, lat: str, dlon: float, dlat: float, out: str = "value") -> DataFrame:
    """Ertel's potential vorticity; ``rlat`` rotated and ``lat`` geographic latitude in radians."""
    ready = _prepared(df, {"u": u, "v": v, "th": theta, "w": w, "h": hhl, "at_rho": rho, "at_rlat": rlat, "at_lat": lat}, dlon, dlat)
    turn = _curl()
    north, up = (2 * c.OMEGA * f("at_lat") for f in (F.cos, F.sin))
    pv = F.col("lam_th") * turn["curl_1"] + F.col("phi_th") * (turn["curl_2"] + north / c.RADIUS) - F.col("zeta_th") * (turn["curl_3"] + up)
    return ready.select(*dims(df), (pv / F.col("at_rho")).alias(out))


def gradient(df: DataFrame, dim: str, column: str) -> Column:
    """Change by step along ``dim``: half the difference of the neighbours, at the ends that to the one."""
    w = along(df, dim)
    before, after = F.lag(column).over(w), F.lead(column).over(w)
    first, last = F.lag(F.lit(1)).over(w).isNull(), F.lead(F.lit(1)).over(w).isNull()
    return F.when(first, after - F.col(column)).when(last, F.col(column) - before).otherwise(0.5 * (after - before))


def curl_alt(df: DataFrame, u: str, v: str, w: str, hhl: str, rlat: str, dlon: float, dlat: float) -> DataFrame:
    """:func:`curl` written out from its definition, one derivative at a time; inside the grid it gives
    the same, at its sides one-sided derivatives. It is for checking and takes a window for each."""
    k = along(df, "k")
    rows = df.select(*dims(df), F.col(u).alias("__u"), F.col(v).alias("__v"), F.col(rlat).alias("__lat"), F.col(hhl).alias("__h"),
                     (0.5 * (F.col(w) + F.lead(w).over(k))).alias("__w"), (F.lead(w).over(k) - F.col(w)).alias("__w_k"))
    rows = metric_terms(rows, "__h", dlon, dlat)
    for name, dim, step in (("u", "y", dlat), ("u", "k", None), ("v", "x", dlon), ("v", "k", None), ("w", "x", dlon), ("w", "y", dlat)):
        change = gradient(rows, dim, f"__{name}")
        rows = rows.withColumn(f"__{name}_{dim}", change / math.radians(step) if step else change)
    f = lambda name: F.col(f"__{name}")
    r, cr = 1 / c.RADIUS, 1 / (c.RADIUS * F.cos("__lat"))
    east, north, up = F.col("dzeta_dlam"), F.col("dzeta_dphi"), F.col("sqrtg")
    one = cr * (r * (f("w_y") + north * f("w_k")) + up * f("v_k") - r * f("v"))
    two = r * (r * f("u") - up * f("u_k") - cr * (f("w_x") + east * f("w_k")))
    three = cr * (f("v_x") + east * f("v_k")) - r * (f("u_y") + north * f("u_k")) + r * F.tan("__lat") * f("u")
    return rows.select(*dims(df), one.alias("curl_1"), two.alias("curl_2"), three.alias("curl_3"))


def bulk_richardson(df: DataFrame, theta_v: str, u: str, v: str, height: str, surface: str, out: str = "value") -> DataFrame:
    """Bulk Richardson number from the ground to each full level."""
    w = along(df, "k")
    below = w.rowsBetween(0, Window.unboundedFollowing)
    n, total = F.count(F.lit(1)).over(below), F.sum(theta_v).over(below)
    lowest = F.last(theta_v).over(below)
    wind = F.col(u) * F.col(u) + F.col(v) * F.col(v)
    return df.withColumn(out, c.G * (F.col(height) - F.col(surface)) * (F.col(theta_v) - lowest) * n / F.nullif(total * wind, F.lit(0.0)))


def alternating_sum(df: DataFrame, column: str, out: str) -> DataFrame:
    """r_1 = a_1, r_k = a_k - r_(k-1), as one running sum with alternating signs."""
    w = along(df, "k")
    rows = df.withColumn("_sign", F.when(F.row_number().over(w) % 2 == 0, 1.0).otherwise(-1.0))
    return rows.withColumn(out, F.col("_sign") * F.sum(F.col("_sign") * F.col(column)).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_sign")


def omega_slope(df: DataFrame, etadot: str, ps: str, ak: str, bk: str, out: str = "value") -> DataFrame:
    """Vertical velocity in pressure from that in the hybrid coordinate; ``ak``, ``bk`` on half
    levels, of which the lowest row goes."""
    w = along(df, "k")
    rows = df.withColumns({"_a": F.lead(ak).over(w) - F.col(ak), "_b": F.lead(bk).over(w) - F.col(bk)}).where("_a is not null")
    term = 2 * F.col(etadot) * F.col(ps) * (F.col("_a") / F.col(ps) + F.col("_b")) / F.nullif(F.col("_a") / c.P_REF + F.col("_b"), F.lit(0.0))
    return alternating_sum(rows.withColumn("_t", term), "_t", out).drop("_a", "_b", "_t")
