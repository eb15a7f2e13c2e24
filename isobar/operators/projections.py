"""Coordinate reference systems as column expressions: geographic, rotated, UTM, Swiss and Italian.

Every system converts to and from geographic degrees (WGS84). Transverse Mercator follows the
Krueger series to the third order (millimetres within a zone), the Swiss systems the published
approximate polynomials (about a metre).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the systems that a target grid may have, with their EPSG numbers. Fixed values.
CRS = {"geolatlon": 4326, "swiss": 21781, "swiss03": 21781, "swiss95": 2056, "boaga-west": 3003, "boaga-east": 3004, "utm32n": 32632}
#: WGS84 and UTM. Fixed values.
AXIS, FLATTENING, SCALE, FALSE_EASTING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0


def _pole(pole: tuple[float, float]) -> tuple[float, float, float]:
    return math.radians(pole[0]), math.sin(math.radians(pole[1])), math.cos(math.radians(pole[1]))


def rotated_to_geographic(rlon: Column, rlat: Column, pole: tuple[float, float]) -> tuple[Column, Column]:
    """Longitude in [0, 360) and latitude of points given on a rotated sphere, all in degrees."""
    lon0, s, k = _pole(pole)
    b, low = F.radians(rlat), F.radians(rlon)
    q = k * F.sin(b) - s * F.cos(low) * F.cos(b)
    side = F.sin(low) * F.cos(b)
    lon = F.degrees(F.atan2(math.sin(lon0) * q - math.cos(lon0) * side, math.cos(lon0) * q + math.sin(lon0) * side))
    return F.pmod(lon, F.lit(360.0)), F.degrees(F.asin(k * F.cos(b) * F.cos(low) + s * F.sin(b)))


def geographic_to_rotated(lon: Column, lat: Column, pole: tuple[float, float]) -> tuple[Column, Column]:
    """The inverse; longitude in (-180, 180]."""
    lon0, s, k = _pole(pole)
    d, b = F.radians(lon) - lon0, F.radians(lat)
    q = F.cos(b) * F.cos(d)
    return F.degrees(F.atan2(-F.cos(b) * F.sin(d), k * F.sin(b) - s * q)), F.degrees(F.asin(s * F.sin(b) + k * q))


def rotate_vector(u: Column, v: Column, lon: Column, lat: Column, pole: tuple[float, float]) -> tuple[Column, Column]:
    """Wind along rotated axes to geographic axes at points given in geographic degrees: a turn by
    the angle between the two norths."""
    lon0, s, k = _pole(pole)
    d, b = lon0 - F.radians(lon), F.radians(lat)
    angle = F.atan2(k * F.sin(d), s * F.cos(b) - k * F.sin(b) * F.cos(d))
    return F.cos(angle) * u + F.sin(angle) * v, F.cos(angle) * v - F.sin(angle) * u


def geographic_to_swiss(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Swiss LV03 coordinates by the published polynomial, good to about a metre."""
    phi = (3.6 * lat - 169.02866) / 10
    lam = (3.6 * (F.pmod(lon + 180.0, F.lit(360.0)) - 180.0) - 26.7825) / 10
    x = 600072.37 + lam * (211455.93 - 10938.51 * phi - 0.36 * phi * phi - 44.54 * lam * lam)
    y = 200147.07 + 3745.25 * lam * lam + phi * (308807.95 + 76.63 * phi - 194.56 * lam * lam + 119.79 * phi * phi)
    return x, y


def swiss_to_geographic(x: Column, y: Column) -> tuple[Column, Column]:
    """From LV03 by the published polynomial."""
    e, n = (x - 600000.0) / 1e6, (y - 200000.0) / 1e6
    lon = 2.6779094 + 4.728982 * e + 0.791484 * e * n + 0.1306 * e * n * n - 0.0436 * e * e * e
    lat = 16.9023892 + 3.238272 * n - 0.270978 * e * e - 0.002528 * n * n - 0.0447 * e * e * n - 0.0140 * n * n * n
    return lon * 100 / 36, lat * 100 / 36


@dataclass(frozen=True)
class Mercator:
    """A transverse Mercator projection, northern hemisphere, in metres."""

    axis: float
    flattening: float
    meridian: float
    scale: float
    false_easting: float

    @property
    def n(self) -> float:
        return self.flattening / (2 - self.flattening)

    @property
    def radius(self) -> float:
        return self.scale * self.axis / (1 + self.n) * (1 + self.n**2 / 4 + self.n**4 / 64)

    @property
    def forth(self) -> tuple[float, float, float]:
        n = self.n
        return n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240

    @property
    def back(self) -> tuple[float, float, float]:
        n = self.n
        return n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480

    @property
    def latitude(self) -> tuple[float, float, float]:
        n = self.n
        return 2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15

    def from_geographic(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        d = F.radians(F.pmod(lon - self.meridian + 180.0, F.lit(360.0)) - 180.0)
        e = 2 * math.sqrt(self.n) / (1 + self.n)
        s = F.sin(F.radians(lat))
        t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
        xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
        east = eta + sum(c * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, c in enumerate(self.forth, 1))
        north = xi + sum(c * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, c in enumerate(self.forth, 1))
        return self.false_easting + self.radius * east, self.radius * north

    def to_geographic(self, x: Column, y: Column) -> tuple[Column, Column]:
        xi0, eta0 = y / self.radius, (x - self.false_easting) / self.radius
        xi = xi0 - sum(c * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0) for j, c in enumerate(self.back, 1))
        eta = eta0 - sum(c * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0) for j, c in enumerate(self.back, 1))
        chi = F.asin(F.sin(xi) / F.cosh(eta))
        lat = chi + sum(c * F.sin(2 * j * chi) for j, c in enumerate(self.latitude, 1))
        return self.meridian + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(lat)


_UTM32 = Mercator(AXIS, FLATTENING, 9, SCALE, FALSE_EASTING)
_N, _RADIUS, _FORTH = _UTM32.n, _UTM32.radius, _UTM32.forth

#: The Italian grids: International ellipsoid of 1924, central meridians and false eastings of the two
#: zones. Fixed values.
HAYFORD_AXIS, HAYFORD_FLATTENING = 6378388.0, 1 / 297
BOAGA = {"boaga-west": Mercator(HAYFORD_AXIS, HAYFORD_FLATTENING, 9.0, 0.9996, 1500000.0), "boaga-east": Mercator(HAYFORD_AXIS, HAYFORD_FLATTENING, 15.0, 0.9996, 2520000.0)}
#: From the datum of Monte Mario to WGS84: shifts in metres, turns in arc seconds (position vector),
#: scale in millionths. Fixed values.
MONTE_MARIO = (-104.1, -49.1, -9.9, 0.971, -2.917, 0.714, -11.68)


def _cartesian(lon: Column, lat: Column, axis: float, flattening: float) -> tuple[Column, Column, Column]:
    e2 = flattening * (2 - flattening)
    a, b = F.radians(lon), F.radians(lat)
    n = axis / F.sqrt(1 - e2 * F.sin(b) * F.sin(b))
    return n * F.cos(b) * F.cos(a), n * F.cos(b) * F.sin(a), n * (1 - e2) * F.sin(b)


def _geodetic(x: Column, y: Column, z: Column, axis: float, flattening: float) -> tuple[Column, Column]:
    """Near the ellipsoid, by the parametric latitude once (well below a millimetre)."""
    e2 = flattening * (2 - flattening)
    p = F.sqrt(x * x + y * y)
    u = F.atan2(z, p * (1 - flattening))
    return F.degrees(F.atan2(y, x)), F.degrees(F.atan2(z + e2 / (1 - flattening) * axis * F.pow(F.sin(u), 3), p - e2 * axis * F.pow(F.cos(u), 3)))


def _turned(x: Column, y: Column, z: Column, shift: tuple[float, ...], back: bool) -> tuple[Column, ...]:
    """Seven parameters of a datum, or their exact inverse."""
    move, (rx, ry, rz), m = shift[:3], (math.radians(v / 3600) for v in shift[3:6]), 1 + shift[6] * 1e-6
    rows = ((1.0, -rz, ry), (rz, 1.0, -rx), (-ry, rx, 1.0))
    if not back:
        return tuple(t + m * (a * x + b * y + c * z) for t, (a, b, c) in zip(move, rows))
    r, norm = (rx, ry, rz), m * (1 + rx * rx + ry * ry + rz * rz)
    own = (x - move[0], y - move[1], z - move[2])  # the inverse of 1 + S is (1 - S + r r') / (1 + r'r)
    return tuple(sum(((2.0 if i == j else 0.0) - rows[i][j] + r[i] * r[j]) / norm * own[j] for j in range(3)) for i in range(3))


def _chain(columns: tuple[Column, ...], *steps) -> tuple[Column, Column]:
    """Functions of columns, one after the other; what a step gives is computed once, however often
    the next one uses it."""
    names, count = "abc", len(columns)
    one = F.struct(*[c.alias(n) for c, n in zip(columns, names)])

    def after(step):
        def applied(s: Column) -> Column:
            nonlocal count
            found = step(*[s[n] for n in names[:count]])
            count = len(found)
            return F.struct(*[c.alias(n) for c, n in zip(found, names)])
        return applied

    for step in steps:
        one = F.transform(F.array(one), after(step))[0]
    return one["a"], one["b"]


def geographic_to_boaga(lon: Column, lat: Column, zone: str) -> tuple[Column, Column]:
    """WGS84 degrees to an Italian grid; the datum's parameters hold to a few metres."""
    return _chain((lon, lat), lambda a, b: _cartesian(a, b, AXIS, FLATTENING), lambda *p: _turned(*p, MONTE_MARIO, True),
                  lambda *p: _geodetic(*p, HAYFORD_AXIS, HAYFORD_FLATTENING), BOAGA[zone].from_geographic)


def boaga_to_geographic(x: Column, y: Column, zone: str) -> tuple[Column, Column]:
    return _chain((x, y), BOAGA[zone].to_geographic, lambda a, b: _cartesian(a, b, HAYFORD_AXIS, HAYFORD_FLATTENING),
                  lambda *p: _turned(*p, MONTE_MARIO, False), lambda *p: _geodetic(*p, AXIS, FLATTENING))


def central_meridian(zone: int) -> int:
    """Of a UTM zone, in degrees."""
    if not 1 <= zone <= 60:
        raise ValueError(f"no UTM zone {zone}")
    return 6 * zone - 183


def utm(zone: int) -> Mercator:
    return Mercator(AXIS, FLATTENING, central_meridian(zone), SCALE, FALSE_EASTING)


def geographic_to_utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing in metres, northern hemisphere."""
    return utm(zone).from_geographic(lon, lat)


def utm_to_geographic(x: Column, y: Column, zone: int) -> tuple[Column, Column]:
    return utm(zone).to_geographic(x, y)


@dataclass(frozen=True)
class System:
    """A coordinate reference system: ``geolatlon``, ``rotlatlon`` with the ``pole`` (longitude and
    latitude of its north pole), or another of :data:`CRS`."""

    name: str = "geolatlon"
    pole: tuple[float, float] | None = None

    def __post_init__(self):
        if self.name not in (*CRS, "rotlatlon") or (self.name == "rotlatlon") != (self.pole is not None):
            raise ValueError(f"no coordinate reference system {self.name}")

    def to_geographic(self, x: Column, y: Column) -> tuple[Column, Column]:
        if self.name == "geolatlon":
            return x, y
        if self.name == "rotlatlon":
            return rotated_to_geographic(x, y, self.pole)
        if self.name == "utm32n":
            return utm_to_geographic(x, y, 32)
        if self.name in ("swiss", "swiss03"):
            return swiss_to_geographic(x, y)
        if self.name == "swiss95":
            return swiss_to_geographic(x - 2e6, y - 1e6)
        return boaga_to_geographic(x, y, self.name)

    def from_geographic(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        if self.name == "geolatlon":
            return lon, lat
        if self.name == "rotlatlon":
            return geographic_to_rotated(lon, lat, self.pole)
        if self.name == "utm32n":
            return geographic_to_utm(lon, lat, 32)
        if self.name in ("swiss", "swiss03"):
            return geographic_to_swiss(lon, lat)
        if self.name == "swiss95":
            x, y = geographic_to_swiss(lon, lat)
            return x + 2e6, y + 1e6
        return geographic_to_boaga(lon, lat, self.name)
