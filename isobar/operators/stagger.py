"""Destaggering and finite differences: windows along one dimension, edges by row position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.field import along


def _first(w):
    return F.row_number().over(w) == 1


def destagger(df: DataFrame, dim: str, columns: list[str]) -> DataFrame:
    """``columns`` on mass points. Along x and y the first value stays and every other becomes the
    mean with the one before; along k half levels become the full levels between them, one fewer."""
    w = along(df, dim)
    if dim == "k":
        after = F.lead(F.lit(1)).over(w).isNotNull()
        out = df.withColumns({c: 0.5 * (F.col(c) + F.lead(c).over(w)) for c in columns} | {"__full": after})
        return out.where("__full").drop("__full")
    if dim not in ("x", "y"):
        raise ValueError(f"unknown dimension {dim}")
    return df.withColumns({c: F.when(_first(w), F.col(c)).otherwise(0.5 * (F.lag(c).over(w) + F.col(c))) for c in columns})


def midpoints(df: DataFrame, dim: str, column: str, extend: str | None = None) -> DataFrame:
    """``column`` halfway to the next value, one row fewer; with ``extend`` the first value stays as
    it is (``left``, values then are means with the one before), the last (``right``), or one more
    row (``both``, whose index is one past the last)."""
    if extend not in (None, "left", "right", "both"):
        raise ValueError(f"unknown extend {extend}")
    w = along(df, dim)
    after, before = F.lead(column).over(w), F.lag(column).over(w)
    last = F.lead(F.lit(1)).over(w).isNull()
    here = F.col(column)
    if extend in (None, "right"):
        rows = df.select(*df.columns, last.alias("__last"), F.when(last, here).otherwise(0.5 * (here + after)).alias("__mid"))
        rows = rows if extend else rows.where(~F.col("__last"))
        return rows.withColumn(column, F.col("__mid")).drop("__last", "__mid")
    mean = F.when(_first(w), here).otherwise(0.5 * (before + here))
    if extend == "left":
        return df.withColumn(column, mean)
    more = F.array(F.struct(F.col(dim).alias("at"), F.col("__mid").alias("v")), F.struct((F.col(dim) + 1).alias("at"), here.alias("v")))
    rows = df.select(*df.columns, mean.alias("__mid"), last.alias("__last"))
    rows = rows.select(*rows.columns, F.explode(F.when(F.col("__last"), more).otherwise(F.slice(more, 1, 1))).alias("__row"))
    return rows.withColumns({dim: F.col("__row.at"), column: F.col("__row.v")}).drop("__mid", "__last", "__row")


def central(df: DataFrame, dim: str, column: str):
    """Half the difference of both neighbours, undefined at the edges."""
    w = along(df, dim)
    return 0.5 * (F.lead(column).over(w) - F.lag(column).over(w))


def gradient(df: DataFrame, dim: str, column: str):
    """As :func:`central`, one-sided at both edges."""
    w = along(df, dim)
    last = F.lead(F.lit(1)).over(w).isNull()
    before, after = F.lag(column).over(w), F.lead(column).over(w)
    return F.when(_first(w), after - F.col(column)).when(last, F.col(column) - before).otherwise(0.5 * (after - before))


def diff_x(df: DataFrame, column: str, out: str) -> DataFrame:
    return df.withColumn(out, central(df, "x", column))


def diff_y(df: DataFrame, column: str, out: str) -> DataFrame:
    return df.withColumn(out, central(df, "y", column))


def diff_z(df: DataFrame, column: str, out: str) -> DataFrame:
    return df.withColumn(out, gradient(df, "k", column))


def diff_z_staggered(df: DataFrame, column: str, out: str) -> DataFrame:
    """Next level less this one, at this one; the last level goes."""
    w = along(df, "k")
    return df.withColumns({out: F.lead(column).over(w) - F.col(column), "__more": F.lead(F.lit(1)).over(w)}).where("__more = 1").drop("__more")
