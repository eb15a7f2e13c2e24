"""Fields in storage: a Parquet table of slabs, one row for each horizontal field.

A slab has its parameter, member, reference and lead time, level and header, and its values packed
as a gridded message has them: integers of so many bits above a reference value. Tables are
partitioned by parameter, so a request reads only what it names.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Sequence
from dataclasses import asdict, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isobar.field import Field, FieldMeta, dims, require_dense
from isobar.metadata import UnitOfTime

from . import files as files_
from . import gridmsg
from .catalog import VCOORD_TYPES, Request

#: Keys of a slab and their types.
KEYS = {"eps": "int", "ref_time": "timestamp", "lead_s": "long", "k": "int", "target": "double", "tile": "long"}
#: Bounds of a slab's points in degrees, longitudes from -180.
BOUNDS = ("west", "south", "east", "north")
TILE_BITS = 24


def to_slabs(field: Field, value: str = "value", bits: int = 16, tile: tuple[int, int] | None = None) -> DataFrame:
    """Slabs of one field. Points are packed with their place; undefined ones have no number.

    ``tile`` (rows, columns) cuts a slab into rectangles of so many points, so that a request for a box
    reads what lies there. Bounds are those of the points on grids in degrees, else the whole globe.
    NotImplementedError for a field of several time ranges.
    """
    if not 1 <= bits <= 48:
        raise ValueError("1 to 48 bits a value")
    if field.meta.keys.get("numberOfTimeRange", 1) != 1:
        raise NotImplementedError("several time ranges")
    df, keys = field.df, [d for d in dims(field.df) if d in KEYS]
    places = [d for d in dims(df) if d not in KEYS]
    if tile:
        df, keys = df.withColumn("tile", F.shiftleft(F.floor(F.col("y") / tile[0]), TILE_BITS) + F.floor(F.col("x") / tile[1])), [*keys, "tile"]
    points = F.struct(*places, F.col(value).cast("double").alias("v"))
    lon, lat = (F.lit(None).cast("double"),) * 2
    if field.meta.keys.get("gridType") in ("rotated_ll", "regular_ll"):
        grid = field.meta.grid
        lon, lat = grid.system.to_geographic(grid.x0 + F.col("x") * grid.dx, grid.y0 + F.col("y") * grid.dy)
        lon = F.pmod(lon + 180.0, F.lit(360.0)) - 180.0
    ends = [F.coalesce(f(c), F.lit(whole)).alias(name) for name, f, c, whole in zip(BOUNDS, (F.min, F.min, F.max, F.max), (lon, lat, lon, lat), (-180.0, -90.0, 180.0, 90.0))]
    slabs = df.groupBy(*keys).agg(F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high"), F.sort_array(F.collect_list(points)).alias("points"), *ends)
    step = F.coalesce((F.col("high") - F.col("low")) / (2.0 ** bits - 1), F.lit(0.0))
    packed = F.transform("points", lambda p: F.struct(*[p[d].alias(d) for d in places], F.when(F.col("step") > 0, F.round((p["v"] - F.col("low")) / F.col("step"))).when(
        p["v"].isNotNull(), 0).cast("long").alias("n")))
    every = [(F.col(k) if k in keys else F.lit(None)).cast(kind).alias(k) for k, kind in KEYS.items()]
    kind = VCOORD_TYPES.get(field.meta.vcoord_type, field.meta.vcoord_type)
    return slabs.withColumn("step", step).select(F.lit(field.meta.name).alias("param"), *every, F.lit(kind).alias("levtype"), *_times(field, keys), *BOUNDS, F.lit(header(field.meta)).alias("header"), "low", "step", packed.alias("points"))


def header(meta: FieldMeta) -> str:
    return json.dumps(asdict(meta), sort_keys=True)


def _times(field: Field, keys: list[str]) -> list[Column]:
    """``begin_min, end_min``: of the time range that values are of, in minutes since the reference
    time. It ends at the lead time; its length is the header's."""
    if "lead_s" not in keys:
        return [F.lit(None).cast("double").alias(n) for n in ("begin_min", "end_min")]
    unit = field.meta.keys.get("indicatorOfUnitForTimeRange", 255)
    length = field.meta.keys.get("lengthOfTimeRange", 0) * (UnitOfTime(unit).seconds / 60 if unit != 255 else 0)
    return [(F.col("lead_s") / 60 - length).alias("begin_min"), (F.col("lead_s") / 60).alias("end_min")]


def save(fields: Sequence[Field], path: str, value: str = "value", bits: int = 16, tile: tuple[int, int] | None = None) -> None:
    """Write fields that have the same horizontal dimensions. Tiles of one place lie together, so that
    the bounds of files and row groups tell which to read."""
    table = reduce(DataFrame.unionByName, [to_slabs(f, value, bits, tile) for f in fields])
    if tile:
        table = table.repartitionByRange("param", "tile").sortWithinPartitions("param", "tile")
    table.write.partitionBy("param").parquet(path)


def from_slabs(slabs: DataFrame) -> DataFrame:
    """A row for each point, with ``value``, and the keys that slabs have."""
    places = [f.name for f in slabs.schema["points"].dataType.elementType.fields if f.name != "n"]
    keys = [k for k in KEYS if k in slabs.columns and k != "tile"]
    rows = slabs.select(*keys, "low", "step", F.explode("points").alias("p"))
    return rows.select(*keys, *[f"p.{d}" for d in places], (F.col("low") + F.col("p.n") * F.col("step")).alias("value"))


def once(slabs: DataFrame, order: str | None = None) -> DataFrame:
    """One slab for each parameter and its keys. Equal ones are one. Of others, the one with the
    greatest ``order`` counts (a column, such as the time of writing; of equals the one whose values
    hash to more); without an order they are an error, which :func:`load` raises."""
    keys = ["param", *[k for k in KEYS if k in slabs.columns]]
    digest = F.xxhash64("low", "step", "points")
    if order:
        best = F.max_by(F.struct(*[c for c in slabs.columns if c not in keys]), F.struct(F.col(order), digest.alias("digest"))).alias("s")
        return slabs.groupBy(*keys).agg(best).select(*keys, "s.*")
    return slabs.withColumn("__digest", digest).dropDuplicates([*keys, "__digest"]).drop("__digest")


def load(source: DataSource | DataFrame, request: Request | dict | str | tuple, order: str | None = None, cells: DataFrame | None = None, coordinates: bool = False) -> dict[str, Field]:
    """Fields of a request by parameter, each dense in its members, times and levels.

    RuntimeError names what is missing; ValueError is raised for a parameter with two different
    headers and for slabs that differ but have the same keys, unless ``order`` says which counts (see
    :func:`once`). With ``coordinates``, points have ``lon`` and ``lat`` (see :func:`located`; ``cells``
    are those of unstructured grids). One aggregate looks at all parameters; their headers, one for
    each parameter, come to the driver.
    """
    slabs = source.retrieve(request) if isinstance(source, DataSource) else source
    keys = [k for k in KEYS if k in slabs.columns]
    slabs = once(slabs, order)
    seen = slabs.groupBy("param").agg(F.collect_set("header").alias("h"), F.count("*").alias("n"), F.count_distinct(F.struct(*keys)).alias("own"),
                                      *[F.size(F.collect_set(k)).alias(f"n_{k}") for k in keys], *[F.count(k).alias(f"has_{k}") for k in keys])
    out = {}
    for r in seen.collect():
        if len(r.h) > 1:
            raise ValueError(f"{r.param} has {len(r.h)} different headers")
        own, have = slabs.where(F.col("param") == r.param), [k for k in keys if r[f"has_{k}"]]
        if r.n > r.own:
            again = own.groupBy(*have).agg(F.count("*").alias("n")).where("n > 1").limit(10).collect()
            raise ValueError(f"{r.param} has different slabs of " + ", ".join(str(tuple(x)[:-1]) for x in again))
        if r.n != math.prod(max(1, r[f"n_{k}"]) for k in keys):
            require_dense(own, have)
        meta = FieldMeta(**json.loads(r.h[0]))
        field = Field(from_slabs(own).drop(*[k for k in keys if k not in have]), meta)
        box = source.request(request).box if isinstance(source, DataSource) else None
        field = inside(field, box, cells) if box else field
        out[r.param] = located(field, cells) if coordinates else field
    if not out:
        raise RuntimeError("no values")
    return out


def inside(field: Field, box: tuple[float, float, float, float], cells: DataFrame | None = None) -> Field:
    """The points in a box of degrees (west, south, east, north), its sides included. A box whose west
    is east of its east goes over the date line."""
    west, south, east, north = box
    own = located(field, cells).df
    lon = F.pmod(F.col("lon") + 180.0, F.lit(360.0)) - 180.0
    across = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return Field(own.where(across & F.col("lat").between(south, north)).drop("lon", "lat"), field.meta)


def located(field: Field, cells: DataFrame | None = None) -> Field:
    """The field with ``lon`` and ``lat`` at its points: of unstructured grids by identifier, from
    ``cells(grid_id, cell, clon, clat)``, of others from the header."""
    if "cell" in field.df.columns:
        if cells is None:
            raise ValueError("cells of unstructured grids come from a table")
        return Field(field.df.join(coordinates(cells, field.meta.grid_id), "cell", "left"), field.meta)
    grid = field.meta.grid
    lon, lat = grid.system.to_geographic(grid.x0 + F.col("x") * grid.dx, grid.y0 + F.col("y") * grid.dy)
    return Field(field.df.withColumns({"lon": lon, "lat": lat}), field.meta)


def load_single(source: DataSource | DataFrame, request: Request | dict | str | tuple) -> Field:
    """The one field of a request; ValueError if it names another number of parameters."""
    found = load(source, request)
    if len(found) != 1:
        raise ValueError(f"one parameter is wanted, not {sorted(found)}")
    return next(iter(found.values()))


class DataSource:
    """Slabs by request. A request may be a :class:`Request`, a dict of its keys, a parameter, or
    parameter and level type; keys that it leaves open come from the template."""

    def __init__(self, table: DataFrame, template: Request | None = None):
        self.table, self.template = table, template or Request()

    @classmethod
    def of_files(cls, spark: SparkSession, paths: Sequence[str], template: Request | None = None) -> DataSource:
        """Slab tables at several paths, as one."""
        if not paths:
            raise ValueError("no files")
        return cls(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(p) for p in paths]), template)

    def request(self, request: Request | dict | str | tuple) -> Request:
        if isinstance(request, str):
            request = {"param": request}
        elif isinstance(request, tuple):
            request = dict(zip(("param", "levtype"), request))
        elif isinstance(request, Request):
            request = {k: v for k, v in asdict(request).items() if v is not None}
        return replace(self.template, **request)

    def retrieve(self, request: Request | dict | str | tuple) -> DataFrame:
        return self.request(request).read(self.table)


def pattern_paths(pattern: str, steps: Sequence[int] = (0,), numbers: Sequence[int] = (0,)) -> list[tuple[str, int | None, int | None]]:
    """``path, member, step`` of each file of a pattern: ``<mmm>`` is the member, ``<ddhh>`` days and
    hours of the step; what a pattern does not have is None."""
    name = pattern.lower()
    members = numbers if "<mmm>" in name else [None]
    hours = steps if "<ddhh>" in name else [None]
    fill = lambda m, h: name.replace("<mmm>", f"{m or 0:03d}").replace("<ddhh>", f"{(h or 0) // 24:02d}{(h or 0) % 24:02d}")
    return [(fill(m, h), m, h) for m in members for h in hours]


def export(source: DataSource, folder: str, files: dict[str, str], params: dict[str, Sequence[tuple[str, str]]], steps: Sequence[int] = (0,), numbers: Sequence[int] = (0,)) -> list[str]:
    """Write the slabs of each file of ``files`` (label to pattern) as files of messages: those of the
    parameters and level types under its label, and of its member and step. One job writes all files;
    returns their paths. A file for which there is no slab is not written."""
    if not params.keys() <= files.keys():
        raise ValueError("parameters are given for files that have no pattern")
    parts = []
    for label, wanted in params.items():
        name = files[label].lower()
        by_level: dict[str, list[str]] = {}
        for param, levtype in wanted:
            by_level.setdefault(levtype, []).append(param)
        hours, member = F.col("lead_s") / 3600, F.coalesce("eps", F.lit(0)).cast("string")
        two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
        file = F.replace(F.replace(F.lit(name), F.lit("<mmm>"), F.lpad(member, 3, "0")), F.lit("<ddhh>"), F.concat(two(hours / 24), two(hours % 24)))
        keys = {"number": list(numbers)} if "<mmm>" in name else {}
        keys |= {"lead_s": [h * 3600 for h in steps]} if "<ddhh>" in name else {}
        for levtype, names in by_level.items():
            own = source.retrieve({"param": names, "levtype": levtype, **keys})
            parts.append(own.select(*[c for c in gridmsg.KEYS if c in own.columns], "points", file.alias("file")))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    gridmsg.write(every, folder, "file")
    there = {r.file for r in every.select("file").distinct().collect()}  # a list of files
    return [f"{folder}/{p}" for label in params for p, _, _ in pattern_paths(files[label], steps, numbers) if p in there]


def fetch(spark: SparkSession, assets: DataFrame, folder: str) -> DataFrame:
    """Copy ``assets(url, sha256)`` to files in ``folder``: ``url, path, status``.

    A file has its asset's name; of assets with one name each has its whole path besides. What is there
    with the digest declared is ``skipped``, what is read with another is ``corrupt`` and not written,
    the rest ``copied``; an asset without a digest is copied as it is. Repeated rows are one. Files are
    read by Spark once each and written by its tasks; those of a job that fails are not there.
    """
    one = assets.select("url", F.lower("sha256").alias("sha256")).groupBy("url").agg(F.max("sha256").alias("sha256")).where("url is not null")
    name, whole = F.substring_index("url", "/", -1), F.regexp_replace("url", "^[A-Za-z][A-Za-z0-9+.-]*:/*", "")
    one = one.withColumn("file", F.when(F.count("*").over(Window.partitionBy(name)) > 1, whole).otherwise(name))
    there = spark.createDataFrame([], "file string, have string")
    if _exists(spark, folder):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        here = F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")
        base = re.sub("^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", folder).rstrip("/")
        there = found.select(F.substring(here, len(base) + 2, 1 << 20).alias("file"), F.sha2("content", 256).alias("have"))
    state = one.join(there, "file", "left").withColumn("skipped", F.coalesce(F.col("have") == F.col("sha256"), F.lit(False)))
    state = state.select("url", "sha256", "file", "skipped").collect()  # a list of files
    path = F.concat(F.lit(folder.rstrip("/") + "/"), F.col("file"))
    schema = "url string, sha256 string, file string"
    out = spark.createDataFrame([(r.url, r.sha256, r.file) for r in state if r.skipped], schema).select("url", path.alias("path"), F.lit("skipped").alias("status"))
    new = [r for r in state if not r.skipped]
    if not new:
        return out
    body = spark.read.format("binaryFile").load([r.url for r in new]).select(_plain("path").alias("at"), "content")
    want = spark.createDataFrame([(r.url, r.sha256, r.file) for r in new], schema).withColumn("at", _plain("url"))
    good = F.col("sha256").isNull() | (F.sha2("content", 256) == F.col("sha256"))
    files_.write_files(body.join(F.broadcast(want), "at").where(good), folder)  # a list of files
    done = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(_plain("path").alias("to"), F.sha2("content", 256).alias("have"))
    want = want.withColumn("to", _plain(F.concat(F.lit(folder.rstrip("/") + "/"), F.col("file")))).join(done, "to", "left")
    status = F.when(F.coalesce(F.col("have") == F.coalesce("sha256", "have"), F.lit(False)), "copied").otherwise("corrupt")  # of the copy itself
    return out.unionByName(want.select("url", path.alias("path"), status.alias("status")))


def _plain(path: Column | str) -> Column:
    """A path without its scheme, by which the same file compares equal however it is written."""
    return F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def coordinates(table: DataFrame, grid_id: str) -> DataFrame:
    """``cell, lon, lat`` in degrees of one grid, from ``table(grid_id, cell, clon, clat)`` in radians;
    KeyError if it is not there."""
    own = table.where(F.col("grid_id") == grid_id).select("cell", F.degrees("clon").alias("lon"), F.degrees("clat").alias("lat"))
    if own.isEmpty():
        raise KeyError(f"no coordinates of grid {grid_id}")
    return own
