"""Horizontal neighbourhoods: every value is sent to the points around it and summed there."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.field import dims


def kernel_weights(n: int, kind: str = "const", shape: str = "disk") -> list[tuple[int, int, float]]:
    """``(dx, dy, weight)`` of an ``n`` by ``n`` kernel: constant or exp(-distance), on a disk or square."""
    if n % 2 == 0:
        raise ValueError("the kernel size is odd")
    if kind not in ("const", "exp") or shape not in ("disk", "square"):
        raise ValueError("kernels are const or exp, disk or square")
    half = n // 2
    out = []
    for dy in range(-half, half + 1):
        for dx in range(-half, half + 1):
            distance = math.hypot(dx, dy)
            inside = shape == "square" or distance <= half
            out.append((dx, dy, (math.exp(-distance) if kind == "exp" else 1.0) if inside else 0.0))
    return out


def _sums(df: DataFrame, column: str, kernel: list[tuple[int, int, float]]) -> DataFrame:
    """For each point, over the points of its kernel: ``_w`` sum of weights of defined values,
    ``_s`` weighted sum, ``_gaps`` undefined values, ``_n`` points in the domain."""
    reach = F.array(*[F.struct(F.lit(-dx).alias("dx"), F.lit(-dy).alias("dy"), F.lit(w).alias("w")) for dx, dy, w in kernel if w > 0])
    rest = [d for d in dims(df) if d not in ("x", "y")]
    sent = df.select(*rest, "x", "y", F.col(column).alias("_v"), F.explode(reach).alias("_to"))
    sent = sent.select(*rest, (F.col("x") + F.col("_to.dx")).alias("x"), (F.col("y") + F.col("_to.dy")).alias("y"), "_v", F.col("_to.w").alias("_w"))
    return sent.groupBy(*rest, "x", "y").agg(
        F.sum(F.when(F.col("_v").isNotNull(), F.col("_w"))).alias("_w"), F.sum(F.col("_w") * F.col("_v")).alias("_s"),
        F.count_if(F.col("_v").isNull()).alias("_gaps"), F.count("*").alias("_n"))


def fill_undef(df: DataFrame, column: str, radius: int, frac_val: float, out: str = "value") -> DataFrame:
    """Undefined points get the exp-disk mean of defined neighbours where at most ``frac_val`` of
    the neighbourhood is undefined."""
    near = _sums(df, column, kernel_weights(2 * radius + 1, "exp", "disk"))
    filled = F.when(F.col("_gaps") / F.col("_n") <= frac_val, F.col("_s") / F.col("_w"))
    keys = dims(df)
    return df.join(near, keys, "left").withColumn(out, F.coalesce(F.col(column), filled)).drop("_w", "_s", "_gaps", "_n")


def disk_avg(df: DataFrame, column: str, radius: int, out: str = "value") -> DataFrame:
    """Mean over a disk, undefined where the centre is. If the field has any gap, means skip
    undefined values; else points whose disk leaves the domain are undefined. Which holds is part
    of the plan: one global aggregate, joined by broadcast of its single row."""
    kernel = kernel_weights(2 * radius + 1, "const", "disk")
    full = sum(1 for *_, w in kernel if w > 0)
    gaps = df.agg(F.coalesce(F.max(F.col(column).isNull()), F.lit(False)).alias("_any_gap"))
    near = _sums(df, column, kernel)
    keys = dims(df)
    joined = df.join(near, keys, "left").join(F.broadcast(gaps))
    mean = F.when(F.col(column).isNotNull() & (F.col("_any_gap") | (F.col("_n") == full)), F.col("_s") / F.col("_w"))
    return joined.withColumn(out, mean).drop("_w", "_s", "_gaps", "_n", "_any_gap")
