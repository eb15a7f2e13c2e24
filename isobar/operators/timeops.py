"""Operators along lead time; ``lead_s`` is in seconds and uniform within a series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.field import along


def nsteps(df: DataFrame, dtime_s: int, step_s: int | None = None) -> int:
    """Steps in ``dtime_s``; ValueError unless the step is uniform and divides it. The step is read
    from the distinct lead times (one small aggregate) unless it is given."""
    if step_s is None:
        times = sorted(r[0] for r in df.select("lead_s").distinct().collect())
        steps = {b - a for a, b in zip(times, times[1:])}
        if len(steps) != 1:
            raise ValueError("lead times are not uniform")
        step_s = steps.pop()
    if dtime_s % step_s:
        raise ValueError(f"{dtime_s} s is not a multiple of the step of {step_s} s")
    return dtime_s // step_s


def time_rate(df: DataFrame, column: str, dtime_s: int, out: str = "value") -> DataFrame:
    """Change since the step before, per ``dtime_s``; the first step goes."""
    w = along(df, "lead_s")
    rate = (F.col(column) - F.lag(column).over(w)) / ((F.col("lead_s") - F.lag("lead_s").over(w)) / dtime_s)
    return df.withColumns({out: rate, "__n": F.row_number().over(w)}).where("__n > 1").drop("__n")


def delta(df: DataFrame, column: str, dtime_s: int, out: str = "value", step_s: int | None = None) -> DataFrame:
    """Change over ``dtime_s``; undefined for the first steps."""
    return df.withColumn(out, F.col(column) - F.lag(column, nsteps(df, dtime_s, step_s)).over(along(df, "lead_s")))


def resample(df: DataFrame, dtime_s: int, step_s: int | None = None) -> DataFrame:
    """Every so many seconds from the first lead time on."""
    rank = F.row_number().over(along(df, "lead_s")) - 1
    return df.withColumn("__n", rank).where(F.col("__n") % nsteps(df, dtime_s, step_s) == 0).drop("__n")


def resample_average(df: DataFrame, column: str, dtime_s: int, out: str = "value", step_s: int | None = None) -> DataFrame:
    """Averages since the start become averages over the last ``dtime_s``."""
    n = nsteps(df, dtime_s, step_s)
    weighted = df.withColumn("__w", F.col(column) * (F.col("lead_s") / dtime_s))
    return weighted.withColumn(out, F.col("__w") - F.lag("__w", n).over(along(df, "lead_s"))).drop("__w")


def rolling_max(df: DataFrame, column: str, n: int, out: str = "value") -> DataFrame:
    """Greatest of the last ``n`` steps, undefined unless all are there."""
    w = along(df, "lead_s").rowsBetween(1 - n, 0)
    return df.withColumn(out, F.when(F.count(column).over(w) == n, F.max(column).over(w)))
