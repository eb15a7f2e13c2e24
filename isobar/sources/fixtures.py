"""Stand-in fields derived from the synthetic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


POLE = (190.0, 43.0)
STEP = 0.01


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def half_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cube of 64 half levels: ``x, y, k, e, e_up, hhl, w, ak, bk`` (``e_up``: of level 65 - k)."""
    rows = _table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64)
    at = rows.select((F.col("vec_id") % 20).cast("int").alias("x"), F.floor(F.col("vec_id") / 20).cast("int").alias("y"), "embedding", F.posexplode("embedding").alias("i", "v"))
    k = F.col("i") + 1
    e = F.col("v").cast("double")
    return at.select("x", "y", k.alias("k"), e.alias("e"), F.element_at("embedding", 64 - F.col("i")).cast("double").alias("e_up"), (20155 - 310 * k + 5 * e).alias("hhl"),
                     e.alias("w"), (20000 * (1 - k / 64.0)).alias("ak"), ((k / 64.0) * (k / 64.0)).alias("bk"))


def with_fields(half: DataFrame) -> DataFrame:
    """Half levels with the fields of the full level below each; those of the lowest are undefined."""
    hfl = F.col("hfl")
    out = half.withColumn("hfl", 0.5 * (F.col("hhl") + F.lead("hhl").over(_by_column())))
    return out.withColumns({
        "t": 288.15 - 0.0065 * hfl + 10 * F.col("e"), "p": 100000 * F.exp(-hfl / 8000), "u": 10 * F.col("e"), "v": 10 * F.col("e_up"),
        "qv": 0.005 * F.exp(-hfl / 2500) * (1 + F.abs("e")), "qc": 1e-5 * F.abs("e"), "qi": 5e-6 * F.abs("e")})


def _by_column():
    from pyspark.sql import Window

    return Window.partitionBy("x", "y").orderBy("k")


def full_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cube of 63 full levels: ``x, y, k, e, hfl, t, p, u, v, qv, qc, qi`` and the half-level columns."""
    return with_fields(half_levels(spark, sf_dir)).where("hfl is not null")


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube as one row for each column: ``x, y`` and the arrays ``hhl`` (half levels), ``hfl, t, p``
    (full levels), from the top."""
    rows = _table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64)
    at = rows.select((F.col("vec_id") % 20).cast("int").alias("x"), F.floor(F.col("vec_id") / 20).cast("int").alias("y"), F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    at = at.withColumn("hhl", F.transform("e", lambda e, i: 20155 - 310 * (i + 1) + 5 * e))
    at = at.withColumn("hfl", F.zip_with(F.slice("hhl", 1, 63), F.slice("hhl", 2, 63), lambda a, b: 0.5 * (a + b)))
    return at.select("x", "y", "hhl", "hfl", F.zip_with("hfl", F.slice("e", 1, 63), lambda h, e: 288.15 - 0.0065 * h + 10 * e).alias("t"), F.transform("hfl", lambda h: 100000 * F.exp(-h / 8000)).alias("p"))


def surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``x, y, hsurf, t, ps, gap``; ``gap`` is undefined for every seventh column."""
    h = half_levels(spark, sf_dir).where("k = 64")
    vec = F.col("y") * 20 + F.col("x")
    return h.select("x", "y", F.col("hhl").alias("hsurf"), (288.15 - 0.0065 * F.col("hhl") + 10 * F.col("e")).alias("t"), (100000 * F.exp(-F.col("hhl") / 8000)).alias("ps"),
                    F.when(vec % 7 != 0, F.col("hhl")).alias("gap"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ref_time, lead_h, lead_s, amount, acc, avg``: sums of events on a dense calendar of days by 24 hours."""
    events = _table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").alias("ref_time"), F.hour("ts").alias("lead_h")).agg(F.sum("value").alias("amount"))
    # every day from the first to the last of the table
    ends = events.agg(F.min("ref_time").alias("first"), F.max("ref_time").alias("last"))
    days = ends.select(F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias("ref_time"))
    grid = days.select("ref_time", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("lead_h"))
    rows = grid.join(events, ["ref_time", "lead_h"], "left").select("ref_time", "lead_h", (F.col("lead_h") * 3600).cast("long").alias("lead_s"), F.coalesce("amount", F.lit(0.0)).cast("double").alias("amount"))
    from pyspark.sql import Window

    acc = F.sum("amount").over(Window.partitionBy("ref_time").orderBy("lead_h"))
    return rows.withColumn("acc", acc).withColumn("avg", F.col("acc") / (F.col("lead_h") + 1))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cell, lon, lat, value, strip`` of an unstructured grid."""
    i = F.col("c_custkey")
    return _table(spark, sf_dir, "customer").select(i.alias("cell"), (5.5 + (i * 37 % 1140) / 100.0).alias("lon"), (43.6 + (i * 91 % 640) / 100.0).alias("lat"),
                                                    F.col("c_acctbal").cast("double").alias("value"), (i % 20).alias("strip"))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ref_time, lead_h``: a day's hours that have an error event stand for a run's lead times."""
    return (_table(spark, sf_dir, "events").where("event_type = 'error'").select(F.date_trunc("day", "ts").alias("ref_time"), F.hour("ts").alias("lead_h"))
            .where(F.col("lead_h").isin(0, 6, 12, 18)).distinct())


def members(df: DataFrame, column: str) -> DataFrame:
    """``df`` for two members and two lead times, ``column`` raised by 10 a member and 1 an hour."""
    out = df.withColumn("eps", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("lead_s", F.explode(F.array(F.lit(0), F.lit(3600)).cast("array<bigint>")))
    return out.withColumn(column, F.col(column) + F.col("eps") * 10 + F.col("lead_s") / 3600.0)
