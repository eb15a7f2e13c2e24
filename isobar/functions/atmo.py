"""Meteorological functions of columns. NULL in gives NULL out; all compile to plain expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from isobar import constants as c


def vapour_pressure_water(t: Column) -> Column:
    """Saturation over water."""
    return c.B1 * F.exp(c.B2_WATER * (t - c.B3) / (t - c.B4_WATER))


def vapour_pressure_ice(t: Column) -> Column:
    """Saturation over ice."""
    return c.B1 * F.exp(c.B2_ICE * (t - c.B3) / (t - c.B4_ICE))


def vapour_pressure_mixed(t: Column) -> Column:
    """Saturation over water above 273.16 K, over ice below 250.16 K, a blend between."""
    share = F.pow((t - (c.B3 - 23.0)) / 23.0, 2.0)
    water, ice = vapour_pressure_water(t), vapour_pressure_ice(t)
    return F.when(t > c.B3, water).when(t < c.B3 - 23.0, ice).otherwise(share * water + (1 - share) * ice)


SATURATION = {"water": vapour_pressure_water, "ice": vapour_pressure_ice, "water+ice": vapour_pressure_mixed}


def specific_humidity(pv: Column, p: Column) -> Column:
    """From the partial pressure of vapour; the denominator is 1 Pa at least."""
    rest = p - c.O_RDV * pv
    return c.RDV * pv / F.when(rest < 1.0, 1.0).otherwise(rest)


def vapour_pressure(qv: Column, p: Column) -> Column:
    return qv * p / (c.RDV + c.O_RDV * qv)


def potential_temperature(t: Column, p: Column, kappa: float = c.KAPPA) -> Column:
    return t * F.pow(1e5 / p, F.lit(kappa))


def potential_temperature_internal(t: Column, p: Column) -> Column:
    """As :func:`potential_temperature`, with R/cp of dry air."""
    return potential_temperature(t, p, c.RDOCP)


def virtual_potential_temperature(t: Column, p: Column, qv: Column) -> Column:
    return potential_temperature(t, p) * (1 + (1 - c.EPSILON) / c.EPSILON * qv)


def density(t: Column, p: Column, qv: Column, qc: Column, qi: Column | None = None, qp: Column | None = None) -> Column:
    """Total density of moist air with its condensate."""
    load = qc
    for more in (qi, qp):
        load = load if more is None else load + more
    return p / (c.R_D * t * (1 + c.RVD_O * qv - load))


def relative_humidity(qv: Column, t: Column, p: Column, clipping: bool = True, phase: str = "water") -> Column:
    """Percent, 0 at least and with ``clipping`` 100 at most, over water, ice or water+ice."""
    if phase not in SATURATION:
        raise ValueError(f"phase is one of {', '.join(SATURATION)}, not {phase}")
    q = qv / (1 + qv)
    out = 100 * (q * p / (c.EPSILON + (1 - c.EPSILON) * q)) / SATURATION[phase](t)
    out = F.when(out < 0, 0.0).otherwise(out)
    return F.when(out > 100, 100.0).otherwise(out) if clipping else out


def thermal_down(net: Column, t_ground: Column) -> Column:
    """Downward thermal radiation at the ground from the net one."""
    return net / c.EMISSIVITY + c.STEFAN_BOLTZMANN * F.pow(t_ground, 4.0)


def shortwave_down(diffuse: Column, direct: Column) -> Column:
    total = diffuse + direct
    return F.when(total < 0, 0.0).otherwise(total)


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def wind_direction(u: Column, v: Column) -> Column:
    """Degrees from which the wind blows, u and v along geographic axes."""
    return F.degrees(F.atan2(u, v)) + 180.0


def _lapse(t: Column, h: Column) -> Column:
    """Rate of temperature with height below ground for extrapolation."""
    base = t + c.LAPSE * h
    least = F.when(base > 298.0, 298.0).otherwise(base)
    chosen = F.when(h > 2500.0, least).otherwise((least + base) / 2)
    drop = chosen - t
    return F.when(h < 2000.0, c.LAPSE).otherwise(F.when(drop < 0, 0.0).otherwise(drop) / F.nullif(h, F.lit(0.0)))


def extrapolated_temperature(t: Column, ps: Column, h: Column, p: Column | float) -> Column:
    """Temperature at pressure ``p`` below ground from that at the surface."""
    y = _lapse(t, h) * c.R_D / c.G * F.ln(p / ps)
    return t * (1 + y + y * y / 2 + y * y * y / 6)


def extrapolated_geopotential(t: Column, ps: Column, h: Column, p: Column | float) -> Column:
    """Geopotential at pressure ``p`` below ground, with a constant lapse rate."""
    y = c.LAPSE * c.R_D / c.G * F.ln(p / ps)
    return h * c.G - c.R_D * t * F.ln(p / ps) * (1 + y / 2 + y * y / 6)
