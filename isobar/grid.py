"""Regular grids: their points, their headers, and what a header says of a grid."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.metadata import code_flags
from isobar.operators.projections import System, central_meridian

#: Header keys that follow from a field's grid, and go when it gets another. Fixed values.
GRID_KEYS = frozenset("""
gridType Ni Nj longitudeOfFirstGridPointInDegrees longitudeOfLastGridPointInDegrees latitudeOfFirstGridPointInDegrees latitudeOfLastGridPointInDegrees
iDirectionIncrementInDegrees jDirectionIncrementInDegrees longitudeOfSouthernPoleInDegrees latitudeOfSouthernPoleInDegrees angleOfRotationInDegrees
iScansNegatively jScansPositively numberOfDataPoints numberOfOctectsForNumberOfPoints sourceOfGridDefinition interpretationOfNumberOfPoints
gridDefinitionTemplateNumber shapeOfTheEarth scanningMode resolutionAndComponentFlags latitudeOfFirstGridPoint longitudeOfFirstGridPoint
latitudeOfLastGridPoint longitudeOfLastGridPoint iDirectionIncrement jDirectionIncrement latitudeOfSouthernPole longitudeOfSouthernPole angleOfRotation
falseEasting falseNorthing scaleFactorAtReferencePoint longitudeOfReferencePoint Di Dj X1 X2 Y1 Y2 uuidOfHGrid numberOfGridUsed numberOfGridInReference
""".split())


@dataclass(frozen=True)
class RegularGrid:
    """Points ``x0 + i dx``, ``y0 + j dy`` of a coordinate reference system; ``pole`` (lon, lat of
    the north pole) stands for the system of rotated degrees."""

    nx: int
    ny: int
    x0: float
    y0: float
    dx: float
    dy: float
    pole: tuple[float, float] | None = None
    crs: str = "geolatlon"

    @property
    def system(self) -> System:
        return System("rotlatlon", self.pole) if self.pole else System(self.crs)

    @classmethod
    def parse(cls, text: str) -> RegularGrid:
        """``crs,xmin,ymin,xmax,ymax,dx,dy``; ValueError unless the counts are whole."""
        crs, *numbers = text.split(",")
        System(crs)
        xmin, ymin, xmax, ymax, dx, dy = map(float, numbers)
        counts = []
        for low, high, step in ((xmin, xmax, dx), (ymin, ymax, dy)):
            if abs(step) < 1e-10:
                raise ValueError("increments are too small")
            n = (high - low) / step
            if abs(n - round(n)) > 1e-10 * max(1, abs(n)):
                raise ValueError("the extent is not a whole number of increments")
            counts.append(round(n) + 1)
        return cls(counts[0], counts[1], xmin, ymin, dx, dy, crs=crs)

    @classmethod
    def from_header(cls, keys: dict) -> RegularGrid:
        """Of a rotated or regular field in degrees, from its header keys; ValueError if increments and
        corners differ."""
        if keys.get("gridType") not in ("rotated_ll", "regular_ll"):
            raise NotImplementedError(f"grid type {keys.get('gridType')}")
        near = lambda v: (v + 180.0) % 360.0 - 180.0
        x0, x1 = near(keys["longitudeOfFirstGridPointInDegrees"]), near(keys["longitudeOfLastGridPointInDegrees"])
        y0, y1 = keys["latitudeOfFirstGridPointInDegrees"], keys["latitudeOfLastGridPointInDegrees"]
        dx, dy = ((b - a) / (n - 1) if n > 1 else step for a, b, n, step in (
            (x0, x1, keys["Ni"], keys["iDirectionIncrementInDegrees"]), (y0, y1, keys["Nj"], keys["jDirectionIncrementInDegrees"])))
        if abs(dx - keys["iDirectionIncrementInDegrees"]) > 1e-5 or abs(dy - keys["jDirectionIncrementInDegrees"]) > 1e-5:
            raise ValueError("increments do not fit the corners")
        return cls(keys["Ni"], keys["Nj"], x0, y0, dx, dy, north_pole(keys) if keys["gridType"] == "rotated_ll" else None)

    @property
    def last(self) -> tuple[float, float]:
        return self.x0 + (self.nx - 1) * self.dx, self.y0 + (self.ny - 1) * self.dy

    @property
    def transform(self) -> tuple[float, float, float, float, float, float]:
        """Affine coefficients from column and row, rows downwards from the north-west corner."""
        return self.dx, 0.0, self.x0 - self.dx / 2, 0.0, -self.dy, self.last[1] + self.dy / 2

    def points(self, spark: SparkSession) -> DataFrame:
        """``y, x, gx, gy``: index and coordinate of every point."""
        out = spark.range(self.nx * self.ny).select((F.col("id") / self.nx).cast("int").alias("y"), (F.col("id") % self.nx).cast("int").alias("x"))
        return out.withColumns({"gx": F.round(self.x0 + F.col("x") * self.dx, 6), "gy": F.round(self.y0 + F.col("y") * self.dy, 6)})

    def to_crs(self, spark: SparkSession, crs: str, pole: tuple[float, float] | None = None) -> RegularGrid:
        """The grid of another system that covers this one, with as many points along its diagonal.

        The extent is that of the edges of this grid's pixels, 21 points on each.
        """
        goal = System(crs, pole)
        (x1, y1), half = self.last, (self.dx / 2, self.dy / 2)
        low, high = (self.x0 - half[0], self.y0 - half[1]), (x1 + half[0], y1 + half[1])
        at = [k / 20 for k in range(21)]
        edge = [(low[0] + (high[0] - low[0]) * t, y) for t in at for y in (low[1], high[1])] + [(x, low[1] + (high[1] - low[1]) * t) for t in at for x in (low[0], high[0])]
        table = spark.createDataFrame(edge, "x double, y double")
        gx, gy = goal.from_geographic(*self.system.to_geographic(F.col("x"), F.col("y")))
        if crs == "geolatlon":
            gx = F.pmod(gx + 180.0, F.lit(360.0)) - 180.0
        x0, xn, y0, yn = table.select(gx.alias("x"), gy.alias("y")).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        step = math.hypot(xn - x0, yn - y0) / math.hypot(self.nx, self.ny)
        nx, ny = max(1, round((xn - x0) / step)), max(1, round((yn - y0) / step))
        return RegularGrid(nx, ny, x0 + step / 2, y0 + step / 2, step, step, pole, "geolatlon" if pole else crs)

    def keys(self) -> dict:
        """All header keys of a field on this grid: those of :meth:`header`, and for grids in degrees
        those from which :meth:`from_header` makes the same grid again."""
        if self.system.name not in ("geolatlon", "rotlatlon"):
            return self.header()
        x1, y1 = self.last
        out = {"gridType": "rotated_ll" if self.pole else "regular_ll", "Ni": self.nx, "Nj": self.ny, "iScansNegatively": 0, "jScansPositively": 1,
               "longitudeOfFirstGridPointInDegrees": round(self.x0, 9), "longitudeOfLastGridPointInDegrees": round(x1, 9), "latitudeOfFirstGridPointInDegrees": round(self.y0, 9),
               "latitudeOfLastGridPointInDegrees": round(y1, 9), "iDirectionIncrementInDegrees": round(self.dx, 9), "jDirectionIncrementInDegrees": round(self.dy, 9)}
        if self.pole:
            out |= {"longitudeOfSouthernPoleInDegrees": (self.pole[0] + 180.0) % 360.0, "latitudeOfSouthernPoleInDegrees": -self.pole[1], "angleOfRotationInDegrees": 0.0}
        return self.header() | out

    def header(self) -> dict:
        """Header keys of a field on this grid: angles in microdegrees, lengths in centimetres."""
        out = {"numberOfDataPoints": self.nx * self.ny, "numberOfOctectsForNumberOfPoints": 0}
        kind = self.system.name
        template = {"geolatlon": 0, "rotlatlon": 1, "utm32n": 12}.get(kind)
        if template is None:
            return out | {"sourceOfGridDefinition": 255}
        out |= {"sourceOfGridDefinition": 0, "interpretationOfNumberOfPoints": 0, "gridDefinitionTemplateNumber": template, "shapeOfTheEarth": 5,
                "Ni": self.nx, "Nj": self.ny, "scanningMode": code_flags([2]), "resolutionAndComponentFlags": code_flags([3, 4, 5] if template == 12 else [3, 4])}
        (x1, y1), micro, centi = self.last, (lambda v: round(v * 1e6)), (lambda v: round(v * 100))
        if template == 12:
            return out | {"falseEasting": centi(500000), "falseNorthing": 0, "scaleFactorAtReferencePoint": 0.9996, "longitudeOfReferencePoint": central_meridian(32),
                          "Di": centi(self.dx), "Dj": centi(self.dy), "X1": centi(self.x0), "X2": centi(x1), "Y1": centi(self.y0), "Y2": centi(y1)}
        out |= {"latitudeOfFirstGridPoint": micro(self.y0), "longitudeOfFirstGridPoint": micro(self.x0), "latitudeOfLastGridPoint": micro(y1),
                "longitudeOfLastGridPoint": micro(x1), "iDirectionIncrement": micro(self.dx), "jDirectionIncrement": micro(self.dy)}
        if self.pole:
            out |= {"latitudeOfSouthernPole": micro(-self.pole[1]), "longitudeOfSouthernPole": micro(self.pole[0] % 360 - 180), "angleOfRotation": 0.0}
        return out


def north_pole(keys: dict) -> tuple[float, float]:
    """Of a rotated grid, from the header's southern pole; ValueError for grids that are not
    rotated, turned about the pole, or scanned otherwise than eastwards and northwards."""
    if keys.get("gridType") != "rotated_ll":
        raise ValueError("the grid is not rotated")
    if keys.get("angleOfRotationInDegrees", 0.0) != 0.0:
        raise ValueError("the grid is turned about its pole")
    if keys.get("iScansNegatively", 0) or not keys.get("jScansPositively", 1):
        raise ValueError("the grid is not scanned eastwards and northwards")
    return (keys["longitudeOfSouthernPoleInDegrees"] - 180.0) % 360.0, -keys["latitudeOfSouthernPoleInDegrees"]
