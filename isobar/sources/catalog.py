"""Requests as predicates, runs that are complete, and keys in asset names."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .parameters import PARAMETERS, dimension, parameter

#: Full model levels; half levels are one more. Fixed values.
LEVELS = {"COSMO-1E": 80, "COSMO-2E": 60, "ICON-CH1-EPS": 80, "ICON-CH2-EPS": 80, "KENDA-CH1": 80}


@dataclass(frozen=True)
class Request:
    """Values wanted of each key; a list means any of them, None no restriction.

    ``param`` may also be names separated by commas; ``ref_time`` may be a time (naive ones are
    UTC), ``latest``, or an interval ``from/to`` in ISO 8601 with ``..`` for an open end; ``model``
    turns a request for model levels without ``levelist`` into one for all its levels; ``box`` (west,
    south, east, north in degrees) leaves the slabs whose bounds touch it.
    """

    param: str | list | None = None
    levtype: str | None = None
    levelist: int | list | None = None
    number: int | list | None = None
    ref_time: object = None
    lead_s: int | list | None = None
    model: str | None = None
    stream: str | None = None
    type: str | None = None
    expver: str | None = None
    box: tuple[float, float, float, float] | None = None

    def __post_init__(self):
        if self.box is not None and not (len(self.box) == 4 and -90 <= self.box[1] <= self.box[3] <= 90 and all(-180 <= v <= 180 for v in self.box[::2])):
            raise ValueError(f"no box of west, south, east, north: {self.box}")
        if isinstance(self.param, str) and "," in self.param:
            object.__setattr__(self, "param", [p.strip() for p in self.param.split(",")])
        if self.levtype not in (None, *LEVEL_TYPES):
            raise ValueError(f"no level type {self.levtype}")
        for name, least in (("levelist", 1), ("number", 0)):
            values = getattr(self, name)
            for v in values if isinstance(values, (list, tuple)) else [values]:
                if v is not None and (not isinstance(v, int) or v < least):
                    raise ValueError(f"{name} {v}")
        if isinstance(self.ref_time, str):
            time_bounds(self.ref_time)

    def params(self) -> list[str]:
        return [] if self.param is None else [self.param] if isinstance(self.param, str) else list(self.param)

    def levels(self) -> list | int | None:
        """Those asked for; of a model with no list all, half levels too if any parameter is on them."""
        if self.levelist is None and self.model and self.levtype == "ml":
            return model_levels(self.model, any(p in PARAMETERS and PARAMETERS[p].half_levels for p in self.params()))
        return self.levelist

    def keys(self, as_text: bool = False) -> dict:
        """The request as an archive wants it: identifiers for names (as text if wanted), all levels of
        the model spelled out, and a default for what is left open. The reference time has to be one
        time. RuntimeError without it, KeyError for a name that is not in the catalogue."""
        low, high = (None, None) if self.ref_time is None else time_bounds(self.ref_time)
        if low is None or low != high:
            raise RuntimeError("one reference time is wanted")
        full = replace(self, **{k: v for k, v in DEFAULTS.items() if getattr(self, k) is None})
        ids = [str(i) if as_text else i for i in (parameter(p).param_id for p in full.params())]
        out = {"class": "od", "date": f"{low:%Y%m%d}", "time": f"{low:%H%M}", "timespan": "none", "expver": full.expver, "levtype": full.levtype, "levelist": full.levels(),
               "model": full.model.lower(), "number": full.number, "stream": full.stream, "type": full.type, "step": _hours(full.lead_s),
               "param": ids[0] if isinstance(self.param, str) else ids}
        return {k: v for k, v in out.items() if v is not None}

    def predicate(self) -> Column:
        """Equality or membership by key, which Parquet scans can use."""
        out = F.lit(True)
        wanted = {"param": self.param, "levtype": self.levtype, "levelist": self.levels(), "number": self.number, "lead_s": self.lead_s}
        for key, want in wanted.items():
            if want is not None:
                out = out & (F.col(key).isin(list(want)) if isinstance(want, (list, tuple)) else F.col(key) == want)
        if self.ref_time is not None and self.ref_time != "latest":
            low, high = time_bounds(self.ref_time)
            out = out & (F.lit(True) if low is None else F.col("ref_time") >= F.lit(low)) & (F.lit(True) if high is None else F.col("ref_time") <= F.lit(high))
        if self.box is not None:
            west, south, east, north = self.box
            out = out & (F.col("south") <= north) & (F.col("north") >= south)
            across = (F.col("west") <= east) & (F.col("east") >= west) if west <= east else (F.col("east") >= west) | (F.col("west") <= east)
            out = out & across
        return out

    def read(self, table: DataFrame) -> DataFrame:
        """Rows of ``table``. Keys under which a table of slabs stores them have the table's names:
        ``eps`` for the member, ``k`` for the model level, ``target`` for a level of another kind, which
        requests name in hPa or K."""
        if "number" not in table.columns and "eps" in table.columns:
            table = table.withColumn("number", F.col("eps"))
        if "levelist" not in table.columns:
            if self.levtype in LEVEL_UNITS and "target" in table.columns:
                table = table.withColumn("levelist", F.round(F.col("target") / LEVEL_UNITS[self.levtype], 6))
            elif "k" in table.columns:
                table = table.withColumn("levelist", F.col("k"))
        if self.levtype is not None and "levtype" not in table.columns and "header" in table.columns:
            kind = F.get_json_object("header", "$.vcoord_type")
            table = table.withColumn("levtype", F.element_at(F.create_map(*[F.lit(x) for pair in VCOORD_TYPES.items() for x in pair]), kind))
        own = table.where(self.predicate())
        if self.ref_time == "latest":
            last = own.agg(F.max("ref_time").alias("_last"))  # one row
            own = own.join(F.broadcast(last), F.col("ref_time") == F.col("_last")).drop("_last")
        return own


#: Level types of requests, and those of fields that they stand for. Fixed values.
LEVEL_TYPES = ("ml", "pl", "sfc", "pt")
VCOORD_TYPES = {"model_level": "ml", "pressure": "pl", "surface": "sfc", "theta": "pt"}
#: Units of requested levels, in those of ``target``. Fixed values.
LEVEL_UNITS = {"pl": 100.0, "pt": 1.0}
#: Keys that an archive's request has by default. Fixed values.
DEFAULTS = {"expver": "0001", "levtype": "ml", "model": "COSMO-1E", "stream": "enfo", "type": "cf"}


def _hours(lead_s: int | list | None) -> int | list | None:
    if lead_s is None:
        return None
    return [_hours(x) for x in lead_s] if isinstance(lead_s, (list, tuple)) else lead_s // 3600 if lead_s % 3600 == 0 else lead_s / 3600


def _utc(text: str) -> datetime:
    at = datetime.fromisoformat(text.strip())
    return at.astimezone(timezone.utc) if at.tzinfo else at.replace(tzinfo=timezone.utc)


def time_bounds(value: datetime | str) -> tuple[datetime | None, datetime | None]:
    """First and last time of a request, in UTC, None where it is open; ``latest`` has neither.
    ValueError if they cannot be read or are inverted."""
    if isinstance(value, datetime):
        at = value.astimezone(timezone.utc) if value.tzinfo else value.replace(tzinfo=timezone.utc)
        return at, at
    if value == "latest":
        return None, None
    ends = value.split("/")
    if len(ends) > 2 or ends.count("..") == len(ends):
        raise ValueError(f"no time or interval: {value}")
    low, high = (None if e == ".." else _utc(e) for e in (ends[0], ends[-1]))
    if low and high and high < low:
        raise ValueError(f"the interval {value} is inverted")
    return low, high


@dataclass(frozen=True)
class Point:
    """One value of a coordinate."""

    value: float

    def bounds(self) -> tuple[float, float]:
        return self.value, self.value


@dataclass(frozen=True)
class Range:
    """All values between two."""

    low: float
    high: float

    def __post_init__(self):
        if self.high < self.low:
            raise ValueError("the range is inverted")

    def bounds(self) -> tuple[float, float]:
        return self.low, self.high


def select(df: DataFrame, **wanted: Point | Range) -> DataFrame:
    """Rows whose coordinates are those wanted."""
    for name, want in wanted.items():
        df = df.where(F.col(name).between(*want.bounds()))
    return df


def model_levels(model: str, staggered: bool = False) -> list[int]:
    """All levels of a model, from the top; ValueError if their number is not known."""
    if model not in LEVELS:
        raise ValueError(f"the levels of {model} are not known")
    return list(range(1, LEVELS[model] + 1 + staggered))


def expand_levels(requests: DataFrame) -> DataFrame:
    """Requests for all model levels, a row for each level: ``requests(model, param, ...)`` joined to
    the catalogue of parameters and to the models' numbers of levels, with ``param_id`` and ``k``. A
    request whose parameter or model is not known has no row."""
    spark = requests.sparkSession
    models = spark.createDataFrame(list(LEVELS.items()), "model string, n_levels int")
    known = requests.join(F.broadcast(dimension(spark)), "param").join(F.broadcast(models), "model")  # tables of fixed values
    levels = F.sequence(F.lit(1), F.col("n_levels") + F.col("half_levels").cast("int"))
    return known.select(*requests.columns, "param_id", F.explode(levels).alias("k"))


def complete_runs(assets: DataFrame, required: list[int]) -> DataFrame:
    """``ref_time`` of the runs of ``assets(ref_time, lead_h)`` that have all required lead times."""
    have = assets.where(F.col("lead_h").isin(required)).groupBy("ref_time").agg(F.count_distinct("lead_h").alias("n"))
    return have.where(F.col("n") == len(set(required))).select("ref_time")


def latest_complete_run(assets: DataFrame, required: list[int]) -> DataFrame:
    """One row: the last complete run, NULL if there is none."""
    return complete_runs(assets, required).agg(F.max("ref_time").alias("ref_time"))


def asset_keys(url: Column) -> tuple[Column, Column]:
    """Reference time (UTC) and lead time in hours from names with ``-YYYYMMDDhhmm-N-``; NULL where
    there are none or they are no time or number."""
    pattern = r"-(\d{12})-(\d+)-"
    stamp = F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))
    return F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmm")), F.nullif(F.regexp_extract(url, pattern, 2), F.lit("")).try_cast("int")


#: Names of the constants' asset of each collection. Fixed values.
CONSTANTS = {"ogd-forecasting-icon-ch1": "icon-ch1-eps", "ogd-forecasting-icon-ch2": "icon-ch2-eps", "ogd-analysis-kenda-ch1": "kenda-ch1"}


def constants_asset(assets: DataFrame, collection: str, kind: str = "horizontal") -> DataFrame:
    """The rows of ``assets(collection, url)`` that hold a collection's static coordinates; KeyError
    for a collection that is not known, ValueError for another kind."""
    if kind not in ("horizontal", "vertical"):
        raise ValueError(f"no {kind} constants")
    name = f"{kind}_constants_{CONSTANTS[collection]}"
    return assets.where((F.col("collection") == collection) & F.contains("url", F.lit(name)))


def catalog_tables(assets: DataFrame, required: list[int]) -> DataFrame:
    """``ref_time, lead_h, url`` of the last complete run of ``assets(url)``, what is asked of a
    catalog before its fields are read."""
    ref, lead = asset_keys(F.col("url"))
    keyed = assets.select(ref.alias("ref_time"), lead.alias("lead_h"), "url").where(F.col("lead_h").isin(required))
    return keyed.join(F.broadcast(latest_complete_run(keyed, required)), "ref_time")
