"""Edge rules of the operators on hand-made fields, against NumPy or closed forms."""

import math

import numpy as np
import pytest

from isobar.field import Field, FieldMeta, align, missing_keys, require_dense
from isobar.functions import atmo
from isobar.operators import dynamics, gis, lateral, stagger, timeops, vertical
from isobar.session import settings
from isobar.sources import catalog
from pyspark.sql import functions as F


def column(spark, rows, names):
    return spark.createDataFrame([(0, 0, *r) for r in rows], f"y int, x int, {names}")


def test_destagger_keeps_the_first_and_drops_the_last(spark):
    a = [1.0, 3.0, None, 7.0]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(a)], "y int, x int, u double")
    out = {r.x: r.u for r in stagger.destagger(df, "x", ["u"]).collect()}
    assert out == {0: 1.0, 1: 2.0, 2: None, 3: None}
    levels = column(spark, [(k, float(k * k)) for k in range(1, 5)], "k int, w double")
    assert {r.k: r.w for r in stagger.destagger(levels, "k", ["w"]).collect()} == {1: 2.5, 2: 6.5, 3: 12.5}
    with pytest.raises(ValueError):
        stagger.destagger(levels, "q", ["w"])


def test_gradient_is_numpys(spark):
    a = np.random.default_rng(0).normal(size=9)
    df = column(spark, [(k, float(v)) for k, v in enumerate(a)], "k int, f double")
    got = [r.d for r in stagger.diff_z(df, "f", "d").orderBy("k").collect()]
    assert np.allclose(got, np.gradient(a))


def test_k2p_brackets(spark):
    df = column(spark, [(1, 100.0, 10.0), (2, 200.0, 20.0), (3, 400.0, 40.0)], "k int, p double, f double")
    out = {r.target: r.value for r in vertical.interpolate_k2p(df, "f", "p", [400.0, 100.0, 300.0, 50.0], "linear_in_p").collect()}
    assert out == {50.0: None, 100.0: 10.0, 300.0: 30.0, 400.0: None}
    near = {r.target: r.value for r in vertical.interpolate_k2p(df, "f", "p", [1.0, 3.0], "nearest_sfc", "hPa").collect()}
    assert near == {100.0: 10.0, 300.0: 40.0}
    for bad in (dict(targets=[0.5], mode="linear_in_p"), dict(targets=[10.0], mode="x"), dict(targets=[10.0], mode="linear_in_p", unit="bar")):
        with pytest.raises(RuntimeError):
            vertical.interpolate_k2p(df, "f", "p", **bad)


def test_folds(spark):
    df = column(spark, [(1, 300.0, 5000.0, 1.0), (2, 290.0, 4000.0, 2.0), (3, 300.0, 3000.0, 3.0), (4, 280.0, 2000.0, 4.0)], "k int, th double, h double, f double")
    get = lambda mode, t: vertical.interpolate_k2theta(df, "f", "th", [t], "h", mode).first().value
    assert get("high_fold", 295.0) == 1.5 and get("low_fold", 295.0) == 3.25 and get("undef_fold", 295.0) is None
    assert get("undef_fold", 285.0) == 3.75 and get("low_fold", 250.0) is None
    assert get("undef_fold", 290.0) is None  # an exact hit counts as two brackets


def test_extremum_and_integral(spark):
    rows = [(k, 1000.0 * (5 - k), float(f)) for k, f in enumerate([9.0, 3.0, 7.0, 1.0, 4.0])]
    df = column(spark, rows, "k int, h double, f double").withColumns({"b": F.lit(1500.0), "t": F.lit(3500.0)})
    assert vertical.minmax_k(df, "f", "h", "b", "t", "maximum").first().value == 7.0
    assert vertical.minmax_k(df, "f", "h", "b", "t", "minimum").first().value == pytest.approx(1.0)
    narrow = df.withColumns({"b": F.lit(1600.0), "t": F.lit(1900.0)})
    assert vertical.minmax_k(narrow, "f", "h", "b", "t", "maximum").first().value == pytest.approx(4.0 - 3 * 0.6)
    with pytest.raises(NotImplementedError):
        vertical.minmax_k(df, "f", "h", "b", "t", "maximum", mode="h2z")
    with pytest.raises(RuntimeError):
        vertical.minmax_k(df, "f", "h", "b", "t", "mean")
    flat = column(spark, [(k, 1000.0 * (5 - k), 2.0 if k < 5 else None) for k in range(6)], "k int, h double, f double").withColumns({"b": F.lit(1000.0), "t": F.lit(4000.0)})
    assert vertical.integrate_k(flat, "f", "h", "b", "t").first().value == 6000.0
    assert vertical.integrate_k(flat, "f", "h", "b", "t", "normed_integral").first().value == 2.0
    assert vertical.integrate_k(flat.withColumn("t", F.lit(10.0)).withColumn("b", F.lit(0.0)), "f", "h", "b", "t").first().value is None


def test_zero_isotherm(spark):
    df = column(spark, [(1, 260.0, 3000.0), (2, 270.0, 2000.0), (3, 280.0, 1000.0)], "k int, t double, h double")
    assert vertical.zero_isotherm(df, "t", "h").first().value == pytest.approx(1685.0)
    frozen = df.withColumn("t", F.col("t") - 10)
    assert vertical.zero_isotherm(frozen, "t", "h").first().value is None
    assert vertical.zero_isotherm(frozen, "t", "h", True).first().value == pytest.approx(685.0)
    assert vertical.zero_isotherm(df.withColumn("t", F.col("t") - 200), "t", "h", True).first().value is None


def test_alternating_sum(spark):
    df = column(spark, [(1, 1.0), (2, 2.0), (3, 4.0)], "k int, a double")
    assert [r.r for r in dynamics.alternating_sum(df, "a", "r").orderBy("k").collect()] == [1.0, 1.0, 3.0]


def test_metric_terms_and_curl_of_rigid_rotation(spark):
    """Flat levels: no metric slope, and solid-body rotation has vorticity 2 omega sin(lat)."""
    step, turn = 0.1, 1e-4
    radius = dynamics.c.RADIUS
    rows = [(y, x, k, 1000.0 * (6 - k), math.radians(40 + y * step)) for y in range(5) for x in range(5) for k in range(1, 6)]
    df = spark.createDataFrame(rows, "y int, x int, k int, hhl double, rlat double")
    df = df.withColumns({"u": turn * radius * F.cos("rlat"), "v": F.lit(0.0), "w": F.lit(0.0)})
    out = dynamics.curl(df, "u", "v", "w", "hhl", "rlat", step, step).where("x = 2 and y = 2 and k = 2").first()
    assert out.curl_3 == pytest.approx(2 * turn * math.sin(math.radians(40.2)), rel=1e-4)
    metric = dynamics.metric_terms(df, "hhl", step, step).where("x = 2 and y = 2").first()
    assert metric.dzeta_dlam == 0 and metric.sqrtg == pytest.approx(1e-3)


def series(spark, values, step=3600):
    return spark.createDataFrame([(0, i * step, v) for i, v in enumerate(values)], "x int, lead_s long, v double")


def test_time_operators(spark):
    s = series(spark, [1.0, 2.0, 4.0, None, 16.0])
    get = lambda df: [r.value for r in df.orderBy("lead_s").collect()]
    assert get(timeops.delta(s, "v", 7200)) == [None, None, 3.0, None, 12.0]
    assert get(timeops.time_rate(s, "v", 1800)) == [0.5, 1.0, None, None]
    assert get(timeops.rolling_max(s, "v", 2)) == [None, 2.0, 4.0, None, None]
    assert [r.lead_s for r in timeops.resample(s, 7200).orderBy("lead_s").collect()] == [0, 7200, 14400]
    assert timeops.nsteps(s, 10800) == 3
    for bad in (s.where("lead_s <> 3600"), s.limit(1)):
        with pytest.raises(ValueError):
            timeops.nsteps(bad, 3600)
    with pytest.raises(ValueError):
        timeops.nsteps(s, 5400)


def test_kernels():
    disk = {(x, y): w for x, y, w in lateral.kernel_weights(5)}
    assert sum(disk.values()) == 13 and disk[2, 0] == 1 and disk[2, 1] == 0
    assert {(x, y): w for x, y, w in lateral.kernel_weights(3, "exp", "square")}[1, 1] == pytest.approx(math.exp(-math.sqrt(2)))
    with pytest.raises(ValueError):
        lateral.kernel_weights(4)


def test_neighbourhoods(spark):
    a = np.arange(25.0).reshape(5, 5)
    df = spark.createDataFrame([(y, x, float(a[y, x])) for y in range(5) for x in range(5)], "y int, x int, f double")
    full = {(r.y, r.x): r.value for r in lateral.disk_avg(df, "f", 1).collect()}
    assert full[2, 2] == 12.0 and full[0, 2] is None
    gappy = df.withColumn("f", F.when(~((F.col("x") == 2) & (F.col("y") == 2)), F.col("f")))
    part = {(r.y, r.x): r.value for r in lateral.disk_avg(gappy, "f", 1).collect()}
    assert part[2, 2] is None and part[0, 0] == pytest.approx((0 + 1 + 5) / 3) and part[2, 1] == pytest.approx((11 + 10 + 6 + 16) / 4)
    filled = {(r.y, r.x): r.value for r in lateral.fill_undef(gappy, "f", 1, 0.3).collect()}
    assert filled[2, 2] == pytest.approx(12.0) and filled[0, 0] == 0.0
    assert {(r.y, r.x): r.value for r in lateral.fill_undef(gappy, "f", 1, 0.1).collect()}[2, 2] is None


def test_coordinates(spark):
    """Points with published Swiss coordinates, and rotation there and back."""
    rows = spark.createDataFrame([(7.438637, 46.951083), (367.438637, 46.951083)], "lon double, lat double")
    x, y = gis.geographic_to_swiss(F.col("lon"), F.col("lat"))
    for r in rows.select(x.alias("x"), y.alias("y")).collect():
        assert abs(r.x - 600000) < 1.5 and abs(r.y - 200000) < 1.5
    lon, lat = gis.geographic_to_rotated(F.col("lon"), F.col("lat"), (190.0, 43.0))
    back = gis.rotated_to_geographic(lon, lat, (190.0, 43.0))
    for r in rows.select("lon", "lat", back[0].alias("a"), back[1].alias("b")).collect():
        assert r.a == pytest.approx(r.lon % 360) and r.b == pytest.approx(r.lat)
    u, v = gis.rotate_vector(F.lit(3.0), F.lit(4.0), F.col("lon"), F.col("lat"), (190.0, 43.0))
    assert rows.select(F.hypot(u, v).alias("s")).first().s == pytest.approx(5.0)


def test_regrid_is_exact_on_a_plane(spark):
    source, target = gis.RegularGrid(12, 12, 5.0, 40.0, 0.5, 0.5), gis.RegularGrid(8, 8, 6.6, 41.6, 0.37, 0.37)
    df = source.points(spark).withColumn("f", 2 * F.col("gx") - 3 * F.col("gy"))
    want = target.points(spark).withColumn("want", 2 * F.col("gx") - 3 * F.col("gy"))
    for method in ("bilinear", "cubic"):
        rows = gis.regrid(df.drop("gx", "gy"), "f", source, target, method).join(want, ["y", "x"]).collect()
        assert len(rows) == 64 and all(r.value == pytest.approx(r.want) for r in rows)
    assert gis.regrid(df.drop("gx", "gy"), "f", source, gis.RegularGrid(4, 1, 0.0, 0.0, 1.0, 1.0)).count() == 0
    rotated = gis.RegularGrid(12, 12, -1.0, -1.0, 0.2, 0.2, (190.0, 43.0))
    here = rotated.points(spark).withColumn("f", F.col("gx"))
    same = gis.regrid(here, "f", rotated, rotated, "nearest").join(here.select("y", "x", "f"), ["y", "x"]).collect()
    assert len(same) >= 100 and all(r.value == r.f for r in same)


def test_grid_text():
    g = gis.RegularGrid.parse("geolatlon,6,45,8,46.5,0.5,0.25")
    assert (g.nx, g.ny, g.x0, g.dy) == (5, 7, 6.0, 0.25)
    for bad in ("utm,0,0,1,1,1,1", "rotlatlon,0,0,1,1,1,1", "geolatlon,0,0,1,1,0.3,1", "geolatlon,0,0,1,1,0,1"):
        with pytest.raises(ValueError):
            gis.RegularGrid.parse(bad)


def test_crop_and_clip(spark):
    df = spark.createDataFrame([(y, x, 1.0) for y in range(3) for x in range(4)], "y int, x int, f double")
    assert {(r.y, r.x) for r in gis.crop(df, 1, 2, 0, 1, 4, 3).collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    for bad in ((2, 1, 0, 1), (0, 4, 0, 1), (-1, 1, 0, 1)):
        with pytest.raises(ValueError):
            gis.crop(df, *bad, 4, 3)
    cells = spark.createDataFrame([(0, None), (1, 1), (2, 5)], "cell int, strip int")
    assert {r.cell for r in gis.clip_strip(cells.select("cell"), cells, 4).collect()} == {0, 2}
    assert gis.clipped_grid_uuid("17643da2-5749-59b6-44d2-eba3636a5a08", 4) != gis.clipped_grid_uuid("17643da2-5749-59b6-44d2-eba3636a5a08", 5)


def test_remap_flags(spark):
    field = spark.createDataFrame([(0, 1.0), (1, 5.0), (2, None)], "cell int, f double")
    w = spark.createDataFrame([(0, 0, 0, 2.0, True), (0, 1, 1, 2.0, True), (1, 0, 0, 1.0, False), (2, 0, 2, 1.0, True), (3, 0, 0, 0.25, True), (3, 1, 1, 0.75, True)],
                              "dst int, slot int, cell int, w double, found boolean")
    assert {r.dst: r.value for r in gis.remap(field, "f", w).collect()} == {0: 5.0, 1: None, 2: None, 3: 4.0}


def test_humidity_bounds(spark):
    df = spark.createDataFrame([(0.05, 280.0, 90000.0), (-0.01, 280.0, 90000.0), (None, 280.0, 90000.0)], "q double, t double, p double")
    args = (F.col("q"), F.col("t"), F.col("p"))
    assert [r.r for r in df.select(atmo.relative_humidity(*args).alias("r")).collect()] == [100.0, 0.0, None]
    assert df.select(atmo.relative_humidity(*args, clipping=False).alias("r")).first().r > 100
    with pytest.raises(ValueError):
        atmo.relative_humidity(*args, phase="snow")
    assert df.select(atmo.shortwave_down(F.lit(None).cast("double"), F.lit(3.0)).alias("r")).first().r is None


def test_density_of_keys(spark):
    df = spark.createDataFrame([(1, 10), (1, 20), (2, 10)], "eps int, lead_s int")
    assert [tuple(r) for r in missing_keys(df, ["eps", "lead_s"]).collect()] == [(2, 20)]
    with pytest.raises(RuntimeError, match="missing"):
        require_dense(df, ["eps", "lead_s"])
    with pytest.raises(RuntimeError, match="no values"):
        require_dense(df.limit(0), ["eps"])
    assert require_dense(df.where("eps = 1"), ["eps", "lead_s"]).count() == 2


def test_alignment_and_metadata(spark):
    a = spark.createDataFrame([(1, 0, 1.0), (2, 0, 2.0)], "k int, x int, f double")
    b = spark.createDataFrame([(0, 5.0)], "x int, g double")
    assert {(r.k, r.g) for r in align(a, b).collect()} == {(1, 5.0), (2, 5.0)}
    m = FieldMeta("U", origin_x=0.5, origin_y=0.0)
    assert m.is_staggered_horizontal and not m.override(origin_x=0.0).is_staggered_horizontal
    assert Field(a, m).derive(b, name="V", step=6).meta.keys == {"step": 6}


def test_requests(spark):
    df = spark.createDataFrame([("T", 1), ("T_2M", 1), ("T", 2)], "param string, levelist int")
    assert catalog.Request(param="T_2M").read(df).count() == 1 and catalog.Request(param="T", levelist=[1, 3]).read(df).count() == 1
    assert len(catalog.model_levels("COSMO-2E", True)) == 61
    with pytest.raises(ValueError):
        catalog.model_levels("other")


def test_settings_come_back(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(KeyError), settings(spark, spark_sql_shuffle_partitions="3"):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
        raise KeyError
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


@pytest.mark.parametrize("method", ["nearest", "bilinear", "cubic"])
def test_regrid_queries_take_the_whole_field(spark, method):
    from isobar.plans import catalog
    from isobar.sources import fixtures

    sf = "/root/testdata/sf0.1"
    rows = fixtures.surface(spark, sf).agg(F.max("y")).first()[0] + 1
    out = catalog.QUERIES[f"regrid_{method}"](spark, sf)
    assert out.count() == 30 * (out.agg(F.max("y")).first()[0] + 1)
    assert rows == 100 and rows - 3.8 < 0.2 + 0.6 * out.agg(F.max("y")).first()[0] <= rows - 3.2 + 1e-9
    if method == "nearest":
        values = {(r.x, r.y): round(r.hsurf, 6) for r in fixtures.surface(spark, sf).collect()}
        for r in out.collect():
            i, j = round(0.3 + 0.6 * r.x, 6), round(0.2 + 0.6 * r.y, 6)
            assert r.value == pytest.approx(values[int(i + 0.5), int(j + 0.5)], abs=1e-6)
