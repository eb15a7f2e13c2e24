"""Barycentric remapping from scattered cells to a regular grid.

Both point sets are projected to UTM 32N and dealt to square tiles; a tile gets the cells in a
margin as wide as itself too, so each cell goes to nine tiles at most. In a tile all targets together
look for the Delaunay triangles around them. If its circumcircle lies in what the tile has seen, no cell
elsewhere can be inside, and the triangle is one of the whole set. Targets without one, where cells
are sparse, try again with tiles twice as wide. Targets outside the convex hull of all cells are
not found; the hull is reduced in the tasks first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.field import dims

from .gis import RegularGrid, remap
from .projections import System

PLANE = System("utm32n")
WEIGHTS = "dst long, cell_0 long, cell_1 long, cell_2 long, w_0 double, w_1 double, w_2 double"
#: Points times cells that are compared at once, and how many times the cells' distance a tile is wide.
CHUNK, WIDE = 1 << 20, 4.0


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]


def hull_of(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def chain(rows: np.ndarray) -> list:
        out: list = []
        for q in rows:
            while len(out) > 1 and _cross(out[-1] - out[-2], q - out[-2]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def _hull(points: DataFrame) -> np.ndarray:
    """Hull of ``points(px, py)``: each task sends the corners of its own."""
    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [hull_of(p[["px", "py"]].to_numpy()) for p in parts if len(p)]
        if own:
            yield pd.DataFrame(hull_of(np.concatenate(own)), columns=["px", "py"])

    found = points.select("px", "py").mapInPandas(of, "px double, py double").toPandas()
    return hull_of(found.to_numpy(np.float64)) if len(found) else np.zeros((0, 2))


def _inside(hull: np.ndarray):
    """A function of ``px, py``: whether that point lies in the hull, its edges included. It is one
    search among the corners, while a condition in columns would grow with them."""
    top = int(np.lexsort((hull[:, 1], hull[:, 0]))[-1]) if len(hull) > 2 else 0
    low, high = hull[: top + 1], np.concatenate((hull[top:], hull[:1]))[::-1]
    low, high = low[: len(low) - int(top > 0 and low[-1, 0] == low[-2, 0])], high[int(top > 0 and high[0, 0] == high[1, 0]):]

    def of(px: pd.Series, py: pd.Series) -> pd.Series:
        if not top:
            return pd.Series(np.zeros(len(px), bool))
        x, y, off = px.to_numpy(np.float64), py.to_numpy(np.float64), 1e-6
        return pd.Series((x >= hull[0, 0] - off) & (x <= hull[top, 0] + off) & (y >= np.interp(x, *low.T) - off) & (y <= np.interp(x, *high.T) + off))
    return F.pandas_udf(of, "boolean")


def delaunay_around(cells: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each of the points ``q``: whether it lies in the hull of ``cells`` and, if so, corners,
    weights and circumcircle (x, y, radius) of the Delaunay triangle around it.

    Lifted to a paraboloid, that triangle is the lowest one above a point: the least sum of weights
    times heights whose weighted points give it, a linear programme in two dimensions. It is solved by
    simplex steps from three far corners that stand for no cell, of all points at once.
    """
    origin, n = (cells.min(0) + cells.max(0)) / 2, len(cells)
    scale = np.sqrt(max(((cells - origin) ** 2).sum(1).max(), ((q - origin) ** 2).sum(1).max(initial=0.0))) or 1.0
    far = 8.0 * np.array([[0.0, 1.0], [-0.87, -0.5], [0.87, -0.5]])
    p = np.concatenate(((cells - origin) / scale, far))
    z = np.concatenate(((p[:n] ** 2).sum(1), np.full(3, 1e7)))
    p = np.column_stack((p, np.ones(n + 3)))
    goal = np.column_stack(((q - origin) / scale, np.ones(len(q))))
    base = np.tile(np.arange(n, n + 3), (len(q), 1))
    weights = np.zeros((len(q), 3))
    left = np.arange(len(q))
    for step in range(200):
        own = base[left]
        turn = np.linalg.inv(p[own])
        gap = z - np.einsum("qij,qj->qi", turn, z[own]) @ p.T
        j = gap.argmin(1)
        w = weights[left] = np.einsum("qi,qij->qj", goal[left], turn)
        more = gap[np.arange(len(left)), j] < -1e-10 * np.where(own.max(1) >= n, 1e7, 1.0)
        left, j, w, turn = left[more], j[more], w[more], turn[more]
        if step == 199 or not len(left):
            break
        mu = np.einsum("qi,qij->qj", p[j], turn)
        ratio = np.where(mu > 1e-12, w / np.where(mu > 1e-12, mu, 1.0), np.inf)
        base[left, ratio.argmin(1)] = j
    found = base.max(1) < n
    base, weights = base[found], weights[found]
    a, b, c = (cells[base[:, k]] for k in range(3))
    area = _cross(b - a, c - a)
    norm = ((b - a) ** 2).sum(1), ((c - a) ** 2).sum(1)
    centre = a + np.column_stack(((c - a)[:, 1] * norm[0] - (b - a)[:, 1] * norm[1], (b - a)[:, 0] * norm[1] - (c - a)[:, 0] * norm[0])) / (2 * area)[:, None]
    return found, base, np.clip(weights, 0, 1), np.column_stack((centre, np.sqrt(((a - centre) ** 2).sum(1))))


def _tiles(size: float, low: np.ndarray, high: np.ndarray):
    """Triangles that a tile's own cells and those in its margin prove; ``low`` and ``high`` bound all cells."""
    def of(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own, goal = pdf[pdf["dst"].isna()], pdf[pdf["dst"].notna()]
        points, ids = own[["px", "py"]].to_numpy(), own["cell"].to_numpy()
        begin = np.maximum((np.array(key) - 1) * size, low)
        end = np.minimum((np.array(key) + 2) * size, high)
        dst, q = goal["dst"].to_numpy(np.int64), goal[["px", "py"]].to_numpy()
        rows = []
        step = max(1, CHUNK // (len(points) + 3))
        for at in range(0, len(q), step) if len(points) > 2 else ():
            found, corners, w, circle = delaunay_around(points, q[at: at + step])
            centre, r = circle[:, :2], circle[:, 2:]
            known = ((np.maximum(centre - r, low) >= begin) & (np.minimum(centre + r, high) <= end)).all(1)
            rows.append(pd.DataFrame({"dst": dst[at: at + step][found][known]} | {f"cell_{k}": ids[corners[known, k]].astype(np.int64) for k in range(3)} | {f"w_{k}": w[known, k] for k in range(3)}))
        return pd.concat(rows) if rows else pd.DataFrame({c.split()[0]: [] for c in WEIGHTS.split(", ")})
    return of


def barycentric_weights(cells: DataFrame, target: RegularGrid) -> DataFrame:
    """``dst, slot, cell, w, found`` for :func:`gis.remap` from ``cells(cell, lon, lat)``, with ``dst``
    = y * nx + x of the target. A target that is not found has one row without a cell.

    Cells at one place are one point, the least cell of them.
    """
    px, py = PLANE.from_geographic(F.col("lon"), F.col("lat"))
    source = cells.where("lon is not null and lat is not null").select("cell", px.alias("px"), py.alias("py")).groupBy("px", "py").agg(F.min("cell").alias("cell")).cache()
    tx, ty = PLANE.from_geographic(*target.system.to_geographic(F.col("gx"), F.col("gy")))
    every = target.points(cells.sparkSession).select((F.col("y").cast("long") * target.nx + F.col("x")).alias("dst"), tx.alias("px"), ty.alias("py"))
    every = every.withColumn("inside", _inside(_hull(source))("px", "py")).cache()
    box = source.agg(F.min("px"), F.max("px"), F.min("py"), F.max("py"), F.count("*")).first()
    left = every.where("inside").drop("inside")
    found = None
    if box[4] > 2:
        size = max(1.0, WIDE * ((box[1] - box[0]) * (box[3] - box[2]) / box[4]) ** 0.5)
        reach = max(box[1] - box[0], box[3] - box[2])
        while True:  # until a tile has seen everything
            tile = lambda c, size=size: F.floor(F.col(c) / size)
            steps = F.array(*[F.lit(d) for d in (-1, 0, 1)])
            around = source.select("cell", F.lit(None).cast("long").alias("dst"), "px", "py", F.explode(F.transform(steps, lambda d: tile("px") + d)).alias("i"), tile("py").alias("_j"))
            around = around.select("cell", "dst", "px", "py", "i", F.explode(F.transform(steps, lambda d: F.col("_j") + d)).alias("j"))
            goal = left.select(F.lit(None).cast(cells.schema["cell"].dataType).alias("cell"), "dst", "px", "py", tile("px").alias("i"), tile("py").alias("j"))
            around = around.join(goal.select("i", "j").distinct(), ["i", "j"], "left_semi").select(*goal.columns)
            new = around.unionByName(goal).groupBy("i", "j").applyInPandas(_tiles(size, np.array([box[0], box[2]]), np.array([box[1], box[3]])), WEIGHTS).cache()
            found = new if found is None else found.unionByName(new)
            left = left.join(new.select("dst"), "dst", "left_anti")
            size *= 2
            if size > 4 * reach or left.isEmpty():
                break
    if found is None:
        return every.select("dst", F.lit(0).alias("slot"), F.lit(None).cast(cells.schema["cell"].dataType).alias("cell"), F.lit(0.0).alias("w"), F.lit(False).alias("found"))
    slots = F.array(*[F.struct(F.lit(s).alias("slot"), F.col(f"cell_{s}").alias("cell"), F.col(f"w_{s}").alias("w")) for s in range(3)])
    rows = found.select("dst", F.explode(slots).alias("s")).select("dst", "s.*", F.lit(True).alias("found"))
    lost = every.select("dst").join(found.select("dst"), "dst", "left_anti")
    return rows.unionByName(lost.select("dst", F.lit(0).alias("slot"), F.lit(None).cast("long").alias("cell"), F.lit(0.0).alias("w"), F.lit(False).alias("found")))


def weights_key(cells: DataFrame, target: RegularGrid) -> str:
    """A name for the weights between these cells and points: a digest of what they follow from. The
    cells are summed up by Spark, in whatever order they come."""
    row = F.xxhash64("cell", "lon", "lat")
    seen = cells.agg(F.count("*"), F.sum(row.cast("decimal(38, 0)")), F.bit_xor(row), F.sum(F.xxhash64("lat", "cell", "lon").cast("decimal(38, 0)"))).first()
    return hashlib.sha256(repr((tuple(seen), target)).encode()).hexdigest()[:32]


def stored_weights(cells: DataFrame, target: RegularGrid, store: str) -> DataFrame:
    """:func:`barycentric_weights`, made once for the same cells and points and kept as a table in the
    folder ``store``. One that was not written to its end is made anew."""
    spark, path = cells.sparkSession, f"{store.rstrip('/')}/{weights_key(cells, target)}"
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        barycentric_weights(cells, target).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def iconremap(df: DataFrame, column: str, cells: DataFrame, target: RegularGrid, method: str = "byc", out: str = "value", store: str | None = None) -> DataFrame:
    """``column`` of a field on cells at the points of ``target``, with ``y, x, lon, lat``: linear in
    the triangle of cells around each point, undefined outside. With ``store``, weights are kept there
    and used again (:func:`stored_weights`)."""
    if method != "byc":
        raise NotImplementedError(f"method {method}")
    at = target.points(df.sparkSession)
    lon, lat = target.system.to_geographic(F.col("gx"), F.col("gy"))
    at = at.select((F.col("y").cast("long") * target.nx + F.col("x")).alias("dst"), "y", "x", lon.alias("lon"), lat.alias("lat"))
    done = remap(df, column, stored_weights(cells, target, store) if store else barycentric_weights(cells, target), out)
    return done.join(at, "dst").select(*[d for d in dims(df) if d != "cell"], "y", "x", "lon", "lat", out)
