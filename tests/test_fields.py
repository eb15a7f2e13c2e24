"""Fields with metadata: storage, requests, checks, grids, streams and the regrid job."""

import json
import math
import os
from datetime import datetime, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isobar import __main__ as job
from isobar.field import Field, FieldMeta
from isobar.metadata import UnitOfTime, code_flags, flags_at, level_coefficients, origin, with_origins
from isobar.operators import checked, columns, dynamics, gis, projections, stagger, triangles, vertical
from isobar.sources import catalog, gridmsg, parameters, slabs
from isobar.streaming import runs

KEYS = {"gridType": "rotated_ll", "Ni": 6, "Nj": 5, "longitudeOfFirstGridPointInDegrees": 359.0, "longitudeOfLastGridPointInDegrees": 359.5,
        "latitudeOfFirstGridPointInDegrees": -1.0, "latitudeOfLastGridPointInDegrees": -0.6, "iDirectionIncrementInDegrees": 0.1, "jDirectionIncrementInDegrees": 0.1,
        "longitudeOfSouthernPoleInDegrees": 10.0, "latitudeOfSouthernPoleInDegrees": -43.0}


def field(spark, name="T", value=lambda k, y, x: 10.0 * k + y + x / 10, shift=0.0, **meta):
    rows = [(k, y, x, value(k, y, x)) for k in (1, 2) for y in range(5) for x in range(6)]
    keys = KEYS | {"longitudeOfFirstGridPointInDegrees": 359.0 + shift, "longitudeOfLastGridPointInDegrees": 359.5 + shift}
    return Field(spark.createDataFrame(rows, "k int, y int, x int, value double"), FieldMeta(name, keys=keys, **({"origin_x": shift * 10, "origin_y": 0.0} | meta)))


def test_code_flags_and_units():
    assert code_flags([3, 4]) == 0b00110000 and code_flags([]) == 0 and flags_at(0b01000001, [1, 2, 8]) == [False, True, True]
    for bad in (lambda: code_flags([9]), lambda: flags_at(256, [1]), lambda: flags_at(1, [0])):
        with pytest.raises(ValueError):
            bad()
    assert UnitOfTime(1).seconds == 3600 and UnitOfTime(13).seconds == 1


def test_origins(spark):
    assert origin(KEYS | {"longitudeOfFirstGridPointInDegrees": 359.05}, KEYS) == (0.5, 0.0)
    out = with_origins({"HHL": field(spark, "HHL"), "U": field(spark, "U", shift=0.05, origin_x=None)}, "HHL")
    assert out["U"].meta.origin_x == 0.5 and not out["HHL"].meta.is_staggered_horizontal
    with pytest.raises(KeyError):
        with_origins({}, "HHL")
    with pytest.raises(ValueError, match="origin"):
        FieldMeta("T").is_staggered_horizontal
    assert not FieldMeta("T", keys={"gridType": "unstructured_grid"}).is_staggered_horizontal
    assert level_coefficients({"pv": [1, 2, 3, 4]}) == ([1, 2], [3, 4]) and level_coefficients({}) is None


def test_save_and_load(spark, tmp_path):
    path = str(tmp_path / "slabs")
    gaps = field(spark, "G")
    gaps = gaps.derive(gaps.df.withColumn("value", F.when(F.col("x") != 3, F.col("value"))))
    slabs.save([field(spark), field(spark, "C", lambda k, y, x: 7.0), gaps], path, bits=24)
    source = slabs.DataSource.of_files(spark, [path])
    out = slabs.load(source, "T,G,C")
    assert set(out) == {"T", "G", "C"} and out["T"].meta == field(spark).meta and out["T"].df.columns == ["k", "y", "x", "value"]
    got = {(r.k, r.y, r.x): r.value for r in out["G"].df.collect()}
    for r in gaps.df.collect():
        assert got[r.k, r.y, r.x] == (None if r.value is None else pytest.approx(r.value, abs=1e-5))
    assert {r.value for r in out["C"].df.collect()} == {7.0}
    assert slabs.load_single(source, {"param": "T", "levelist": [2]}).df.select("k").distinct().collect()[0].k == 2
    assert slabs.load_single(slabs.DataSource(source.table, catalog.Request(levelist=[1])), ("T", "ml")).df.count() == 30
    for bad, error in ((lambda: slabs.load_single(source, "T,C"), ValueError), (lambda: slabs.load(source, "X"), RuntimeError), (lambda: slabs.DataSource.of_files(spark, []), ValueError),
                       (lambda: slabs.to_slabs(gaps, bits=0), ValueError)):
        with pytest.raises(error):
            bad()
    mixed = source.table.where("param = 'T'").unionByName(source.table.where("param = 'C'").withColumn("param", F.lit("T")))
    with pytest.raises(ValueError, match="headers"):
        slabs.load(mixed, "T")
    thin = slabs.to_slabs(Field(spark.createDataFrame([(0, 0, 0, 0, 1.0), (0, 1, 0, 0, 1.0), (1, 1, 0, 0, 1.0)], "eps int, k int, y int, x int, value double"), FieldMeta("T")))
    with pytest.raises(RuntimeError, match="missing"):
        slabs.load(thin, "T")


def test_requests():
    assert catalog.Request(param="T, U").param == ["T", "U"] and len(catalog.Request(levtype="ml", model="COSMO-2E").levels()) == 60
    for bad in (dict(levtype="xx"), dict(levelist=0), dict(number=[-1]), dict(ref_time="2024-01-02/2024-01-01"), dict(ref_time="../.."), dict(ref_time="no")):
        with pytest.raises(ValueError):
            catalog.Request(**bad)
    low, high = catalog.time_bounds("2024-01-01T01:00:00+01:00/..")
    assert low == datetime(2024, 1, 1, tzinfo=timezone.utc) and high is None
    assert catalog.time_bounds(datetime(2024, 1, 1))[0] == low and catalog.time_bounds("latest") == (None, None)
    with pytest.raises(ValueError):
        catalog.Range(2, 1)


def test_selection_and_catalog(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (2.0,)], "lat double")
    assert catalog.select(df, lat=catalog.Range(0.9, 2)).count() == 2 and catalog.select(df, lat=catalog.Point(1.0)).count() == 1
    names = [f"https://h.example/f-20240{m}010000-{h}-v.grib2" for m in (1, 2) for h in (0, 6) if (m, h) != (2, 6)] + ["https://h.example/f-202413010000-0-v", "x", "https://h.example/f-202401010000-99999999999-v"]
    assets = spark.createDataFrame([("ogd-forecasting-icon-ch1", n) for n in names] + [("ogd-forecasting-icon-ch1", "h/horizontal_constants_icon-ch1-eps.grib2")], "collection string, url string")
    assert sorted(r.lead_h for r in catalog.catalog_tables(assets.select("url"), [0, 6]).collect()) == [0, 6]
    assert catalog.constants_asset(assets, "ogd-forecasting-icon-ch1").count() == 1
    with pytest.raises(KeyError):
        catalog.constants_asset(assets, "other")
    table = spark.createDataFrame([("g", 0, math.pi / 2, 0.0)], "grid_id string, cell int, clon double, clat double")
    assert slabs.coordinates(table, "g").first().lon == 90.0
    with pytest.raises(KeyError):
        slabs.coordinates(table, "h")


def test_export_and_fetch(spark, tmp_path):
    assert slabs.pattern_paths("lfff<DDHH>0000_<mmm>", [0, 30], [1]) == [("lfff00000000_001", 1, 0), ("lfff01060000_001", 1, 30)]
    assert slabs.pattern_paths("const") == [("const", None, None)]
    table = slabs.to_slabs(field(spark)).withColumns({"eps": F.lit(1), "lead_s": F.lit(21600).cast("long")})
    other = slabs.to_slabs(field(spark, "PS", vcoord_type="surface")).withColumns({"eps": F.lit(1), "lead_s": F.lit(108000).cast("long")})
    source = slabs.DataSource(table.unionByName(other))
    written = slabs.export(source, str(tmp_path / "out"), {"ml": "F<ddhh>_<mmm>", "sf": "ps<ddhh>"}, {"ml": [("T", "ml")], "sf": [("PS", "sfc")]}, [0, 6, 30], [1])
    assert [p[len(str(tmp_path)):] for p in written] == ["/out/f0006_001", "/out/ps0106"]
    assert [gridmsg.read(spark, p).count() for p in written] == [2, 2] and sorted(os.listdir(tmp_path / "out")) == ["f0006_001", "ps0106"]
    with pytest.raises(ValueError):
        slabs.export(slabs.DataSource(table), str(tmp_path), {}, {"ml": []})


def test_fetch(spark, tmp_path):
    """Assets of one name are kept apart; copies are files with their assets' bytes."""
    bodies = {"a/x.bin": b"one", "b/x.bin": b"two", "c.bin": b"three", "d.bin": b"four"}
    for name, body in bodies.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    rows = [(f"file://{tmp_path}/{n}", None if n == "d.bin" else slabs.digest(b"wrong" if n == "c.bin" else body).upper()) for n, body in bodies.items()]
    assets = spark.createDataFrame(rows + rows[:1] + [(None, "x")], "url string, sha256 string")
    folder = str(tmp_path / "copies")

    def fetched():
        out = slabs.fetch(spark, assets, folder).collect()
        assert len(out) == 4
        return {r.url[len(f"file://{tmp_path}/"):]: (r.status, r.path) for r in out}

    first = fetched()
    assert {n: s for n, (s, _) in first.items()} == {"a/x.bin": "copied", "b/x.bin": "copied", "c.bin": "corrupt", "d.bin": "copied"}
    for name, (status, path) in first.items():
        assert os.path.exists(path) == (status == "copied") and (status != "copied" or open(path, "rb").read() == bodies[name])
    assert first["d.bin"][1] == f"{folder}/d.bin"
    (tmp_path / "b/x.bin").write_bytes(b"changed")  # the copy that is there still has the digest declared
    again = fetched()
    assert {n: s for n, (s, _) in again.items()} == {"a/x.bin": "skipped", "b/x.bin": "skipped", "c.bin": "corrupt", "d.bin": "copied"}


def test_checked_operators(spark):
    u, v = field(spark, "U", lambda k, y, x: 3.0), field(spark, "V", lambda k, y, x: 4.0)
    ug, vg = checked.to_geographic_axes(u, v)
    speed = ug.df.join(vg.df.withColumnRenamed("value", "w"), ["k", "y", "x"]).select(F.hypot("value", "w").alias("s")).collect()
    assert len(speed) == 60 and all(r.s == pytest.approx(5.0) for r in speed) and ug.meta.vref == "geo"
    assert all(r.value == 5.0 for r in checked.wind_speed(u, v).df.collect()) and checked.wind_direction(ug, vg).meta.name == "DD"
    staggered = field(spark, "U", shift=0.05)
    assert checked.destagger(staggered, "x").meta.origin_x == 0.0
    assert checked.destagger(staggered, "x").meta.keys["longitudeOfFirstGridPointInDegrees"] == pytest.approx(359.0)
    half = u.derive(u.df, origin_z=-0.5)
    assert checked.destagger(half, "k").df.count() == 30
    cut = checked.crop(u, 1, 3, 0, 1)
    assert cut.df.count() == 12 and cut.meta.keys["Ni"] == 3 and cut.meta.keys["longitudeOfFirstGridPointInDegrees"] == pytest.approx(-0.9)
    assert gis.RegularGrid.from_header(cut.meta.keys).nx == 3
    cells = Field(spark.createDataFrame([(0, 1.0), (1, 2.0)], "cell int, value double"), FieldMeta("T", grid_id="17643da2-5749-59b6-44d2-eba3636a5a08", keys={"gridType": "unstructured_grid"}))
    strips = spark.createDataFrame([(0, 1), (1, 9)], "cell int, strip int")
    assert checked.clip(cells, strips, 3).df.count() == 1 and checked.clip(cells, strips, 3).meta.grid_id != cells.meta.grid_id
    assert checked.on_new_levels(u, [300.0, 500.0], "pressure").df.where("value is null").count() == 60
    p = field(spark, "P", lambda k, y, x: 30000.0 * k)
    assert checked.interpolate_k2p(u, p, [400.0], "linear_in_p", "hPa").meta.vcoord_type == "pressure"
    turned = u.derive(u.df, angleOfRotationInDegrees=1.0)
    wrong = [lambda: checked.destagger(u, "x"), lambda: checked.destagger(u, "k"), lambda: checked.destagger(u, "q"), lambda: checked.to_geographic_axes(staggered, v),
             lambda: checked.wind_speed(v, u), lambda: checked.wind_speed(staggered, v), lambda: checked.wind_direction(ug, v), lambda: checked.clip(u, strips, 3),
             lambda: checked.clip(cells, strips, 3, "other"), lambda: checked.interpolate_k2p(half, p, [400.0], "linear_in_p"), lambda: checked.to_geographic_axes(turned, v)]
    for f in wrong:
        with pytest.raises(ValueError):
            f()


def test_projections_and_headers(spark):
    df = spark.createDataFrame([(7.438637, 46.951083), (9.0, 47.0), (12.5, 44.0)], "lon double, lat double")
    for system in (projections.System("utm32n"), projections.System("swiss"), projections.System("swiss95"), projections.System("rotlatlon", (190.0, 43.0)), projections.System()):
        lon, lat = system.to_geographic(*system.from_geographic(F.col("lon"), F.col("lat")))
        for r in df.where("lon < 10").select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
            assert r.a == pytest.approx(r.lon, abs=3e-5) and r.b == pytest.approx(r.lat, abs=3e-5)
    x, y = projections.geographic_to_utm(F.lit(9.0), F.lit(0.0), 32)
    assert df.limit(1).select(x.alias("x"), y.alias("y")).first() == (500000.0, 0.0)
    with pytest.raises(ValueError):
        projections.central_meridian(61)
    grid = gis.RegularGrid.parse("utm32n,400000,5100000,500000,5200000,1000,2000")
    assert (grid.header()["gridDefinitionTemplateNumber"], grid.header()["Dj"], grid.header()["X2"]) == (12, 200000, 50000000)
    assert gis.RegularGrid.parse("swiss,0,0,1,1,1,1").header()["sourceOfGridDefinition"] == 255 and grid.transform[2] == 399500.0
    rotated = gis.RegularGrid.from_header(KEYS)
    assert rotated.pole == (190.0, 43.0) and rotated.header()["longitudeOfSouthernPole"] == 10000000
    goal = rotated.to_crs(spark, "geolatlon")
    lon, lat = rotated.system.to_geographic(F.col("gx"), F.col("gy"))
    own = rotated.points(spark).select(lon.alias("lon"), lat.alias("lat")).collect()
    assert all(goal.x0 - goal.dx <= r.lon <= goal.last[0] + goal.dx and goal.y0 - goal.dy <= r.lat <= goal.last[1] + goal.dy for r in own)
    with pytest.raises(ValueError):
        gis.RegularGrid.from_header(KEYS | {"iDirectionIncrementInDegrees": 0.2})
    with pytest.raises(NotImplementedError):
        gis.RegularGrid.from_header({"gridType": "reduced_gg"})


def test_barycentric_remap(spark):
    rng = np.random.default_rng(2)
    lon, lat = 7 + 3 * rng.random(300), 45 + 2 * rng.random(300)
    lon[200:], lat[200:] = 7.1 + 0.2 * rng.random(100), 45.1 + 0.2 * rng.random(100)  # crowded in one corner
    cells = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lon, lat))] + [(300, float(lon[0]), float(lat[0])), (301, None, 45.0)], "cell long, lon double, lat double")
    px, py = triangles.PLANE.from_geographic(F.col("lon"), F.col("lat"))
    values = cells.select("cell", (px / 1000 - py / 500).alias("f"))
    values = values.withColumn("eps", F.explode(F.array(F.lit(0), F.lit(1))))
    target = gis.RegularGrid(22, 15, 6.8, 44.8, 0.17, 0.17)
    out = triangles.iconremap(values, "f", cells, target).collect()
    assert len(out) == 2 * 22 * 15
    plane = {(r.y, r.x): (r.px, r.py) for r in target.points(spark).select("y", "x", *[c.alias(n) for c, n in zip(triangles.PLANE.from_geographic(F.col("gx"), F.col("gy")), ("px", "py"))]).collect()}
    have = 0
    for r in out:
        a, b = plane[r.y, r.x]
        assert r.value is None or r.value == pytest.approx(a / 1000 - b / 500, abs=1e-6)
        have += r.value is not None
    corners = triangles.hull_of(np.array([(r.px, r.py) for r in cells.where("lat is not null and lon is not null").select(px.alias("px"), py.alias("py")).collect()]))
    inside = sum(all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0 for (ax, ay), (bx, by) in zip(corners, np.roll(corners, -1, axis=0))) for x, y in plane.values())
    assert have == 2 * inside > 200
    with pytest.raises(NotImplementedError):
        triangles.iconremap(values, "f", cells, target, "rbf")
    assert all(r.value is None for r in triangles.iconremap(values, "f", cells.limit(2), target).collect())


def test_weights_by_grid(spark):
    table = spark.createDataFrame([("g", 0, 0, 1, 1.0, True)], "grid_id string, dst int, slot int, cell int, w double, found boolean")
    assert gis.remap(spark.createDataFrame([(1, 4.0)], "cell int, f double"), "f", gis.coefficients(table, "g")).first().value == 4.0
    with pytest.raises(KeyError):
        gis.coefficients(table, "h")


def test_remap_with_missing_cells_and_members(spark):
    w = spark.createDataFrame([(1, 0, 7, 0.5, True), (1, 1, 8, 0.5, True), (2, 0, 8, 1.0, True)], "dst int, slot int, cell int, w double, found boolean")
    f = spark.createDataFrame([(e, 8, 10.0 + e) for e in (0, 1)], "eps int, cell int, f double")
    assert {(r.eps, r.dst): r.value for r in gis.remap(f, "f", w).collect()} == {(0, 1): None, (1, 1): None, (0, 2): 10.0, (1, 2): 11.0}


def test_midpoints(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([1.0, 3.0, 7.0])], "y int, x int, f double")
    get = lambda extend: [r.f for r in stagger.midpoints(df, "x", "f", extend).orderBy("x").collect()]
    assert get(None) == [2.0, 5.0] and get("left") == [1.0, 2.0, 5.0] and get("right") == [2.0, 5.0, 7.0] and get("both") == [1.0, 2.0, 5.0, 7.0]
    with pytest.raises(ValueError):
        stagger.midpoints(df, "x", "f", "up")


def test_curl_has_three_exchanges_and_fits_another_form(spark):
    """On flat levels the vertical component is the curl of a plane wind in spherical coordinates."""
    step, radius = 0.1, dynamics.c.RADIUS
    rng = np.random.default_rng(1)
    uv = rng.normal(size=(2, 7, 7))
    rows = [(y, x, k, 1000.0 * (6 - k), math.radians(40 + y * step), float(uv[0, y, x]), float(uv[1, y, x]), 0.0) for y in range(7) for x in range(7) for k in range(1, 6)]
    df = spark.createDataFrame(rows, "y int, x int, k int, hhl double, rlat double, u double, v double, w double")
    out = dynamics.curl(df, "u", "v", "w", "hhl", "rlat", step, step)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3
    d = math.radians(step)
    for r in out.where("k = 2 and x between 1 and 5 and y between 1 and 5").collect():
        lat = math.radians(40 + r.y * step)
        v_x = (uv[1, r.y, r.x + 1] - uv[1, r.y, r.x - 1]) / (2 * d)
        u_y = (uv[0, r.y + 1, r.x] - uv[0, r.y - 1, r.x]) / (2 * d)
        assert r.curl_3 == pytest.approx((v_x / math.cos(lat) - u_y + uv[0, r.y, r.x] * math.tan(lat)) / radius, rel=1e-9)


def test_streams(spark, tmp_path):
    folder = str(tmp_path / "in")
    at = datetime(2024, 1, 1)
    spark.createDataFrame([(at, 0), (at, 6), (datetime(2024, 1, 2), 0), (at, 5)], "ref_time timestamp, lead_h int").write.parquet(folder)
    stream = spark.readStream.schema("ref_time timestamp, lead_h int").parquet(folder)
    q = runs.complete_runs(stream, [0, 6]).writeStream.outputMode("append").format("memory").queryName("done_runs").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.ref_time for r in spark.table("done_runs").collect()] == [at]
    path = str(tmp_path / "slabs")
    slabs.to_slabs(field(spark)).write.parquet(path)
    table = spark.read.parquet(path)
    q = runs.read_slabs(spark, path, table.schema, catalog.Request(levelist=[2])).writeStream.format("memory").queryName("landed").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("landed").count() == 1


def test_regrid_job(spark, tmp_path):
    keys = {"T": field(spark), "U": field(spark, "U", lambda k, y, x: 3.0, shift=0.05, origin_x=None), "V": field(spark, "V", lambda k, y, x: 4.0), "HHL": field(spark, "HHL")}
    a, b, out = (str(tmp_path / n) for n in ("a", "b", "out"))
    slabs.save([keys["T"], keys["HHL"]], a)
    slabs.save([keys["U"], keys["V"]], b)
    job.regrid(spark, [a, b], out, "T,U,V,HHL", resampling="bilinear")
    done = slabs.load(slabs.DataSource.of_files(spark, [out]), "T,U,V")
    both = done["U"].df.join(done["V"].df.withColumnRenamed("value", "w"), ["k", "y", "x"]).where("value is not null and w is not null").collect()
    assert len(both) > 20 and all(math.hypot(r.value, r.w) == pytest.approx(5.0, abs=1e-2) for r in both)
    assert done["T"].meta.keys["gridDefinitionTemplateNumber"] == 0 and json.dumps(done["T"].meta.keys)
    with pytest.raises(ValueError):
        job.regrid(spark, [a, b], out + "2", "T,U")


def test_levels_survive_storage(spark, tmp_path):
    p = field(spark, "P", lambda k, y, x: 30000.0 * k + x)
    t = checked.interpolate_k2p(field(spark), p, [400.0, 500.0], "linear_in_p", "hPa")
    path = str(tmp_path / "pl")
    slabs.save([t, t.derive(t.df, name="T2")], path, bits=32)
    source = slabs.DataSource.of_files(spark, [path])
    out = slabs.load_single(source, {"param": "T", "levtype": "pl", "levelist": [400]})
    assert out.meta.vcoord_type == "pressure" and out.df.columns == ["target", "y", "x", "value"]
    want = {(r.target, r.y, r.x): r.value for r in t.df.where("target = 40000").collect()}
    got = {(r.target, r.y, r.x): r.value for r in out.df.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())
    assert slabs.load_single(source, ("T2", "pl")).df.select("target").distinct().count() == 2
    with pytest.raises(RuntimeError):
        slabs.load(source, {"param": "T", "levtype": "ml"})


def test_repeated_slabs(spark):
    one = slabs.to_slabs(field(spark)).withColumn("written", F.lit(1))
    other = slabs.to_slabs(field(spark, value=lambda k, y, x: 99.0)).withColumn("written", F.lit(2))
    assert slabs.load_single(one.unionByName(one), "T").df.count() == 60
    with pytest.raises(ValueError, match="different slabs"):
        slabs.load(one.unionByName(other.where("k = 1")), "T")
    rows = slabs.load(one.unionByName(other.where("k = 1")).unionByName(one), "T", order="written")["T"].df.collect()
    assert len(rows) == 60 and {r.value for r in rows if r.k == 1} == {99.0} and 99.0 not in {r.value for r in rows if r.k == 2}


def test_coordinates_on_load(spark):
    out = slabs.load(slabs.to_slabs(field(spark)), "T", coordinates=True)["T"].df
    lon, lat = projections.rotated_to_geographic(F.lit(-1.0) + F.col("x") * 0.1, F.lit(-1.0) + F.col("y") * 0.1, (190.0, 43.0))
    assert all(r.lon == pytest.approx(r.a) and r.lat == pytest.approx(r.b) for r in out.select("lon", "lat", lon.alias("a"), lat.alias("b")).collect())
    cells = Field(spark.createDataFrame([(0, 1.0), (1, 2.0)], "cell int, value double"), FieldMeta("T", grid_id="g", keys={"gridType": "unstructured_grid"}))
    table = spark.createDataFrame([("g", 0, math.pi / 2, 0.0), ("h", 1, 0.0, 0.0)], "grid_id string, cell int, clon double, clat double")
    got = {r.cell: r.lon for r in slabs.load(slabs.to_slabs(cells), "T", cells=table, coordinates=True)["T"].df.collect()}
    assert got == {0: pytest.approx(90.0), 1: None}
    with pytest.raises(ValueError):
        slabs.located(cells)


def test_grid_of_a_field(spark):
    rotated = field(spark).meta
    for grid in (rotated.grid, gis.RegularGrid.parse("geolatlon,-1,2,8,6,0.5,0.25")):
        meta = rotated.on_grid(grid)
        assert meta.grid == grid and meta.keys["numberOfDataPoints"] == grid.nx * grid.ny and meta.vref == ("native" if grid.pole else "geo")
    assert not {"longitudeOfSouthernPoleInDegrees", "latitudeOfSouthernPole"} & rotated.on_grid(gis.RegularGrid.parse("geolatlon,0,0,1,1,1,1")).keys.keys()
    assert rotated.on_grid(gis.RegularGrid.parse("utm32n,0,0,1000,1000,1000,1000")).keys["gridDefinitionTemplateNumber"] == 12


def test_regrid_job_gives_fields(spark, tmp_path):
    """Whole fields on the target's points, with a header that reads back, vectors along geographic axes."""
    a, out = (str(tmp_path / n) for n in ("a", "out"))
    slabs.save([field(spark), field(spark, "U", lambda k, y, x: 3.0), field(spark, "V", lambda k, y, x: 4.0), field(spark, "HHL")], a)
    job.regrid(spark, [a], out, "U, V,T")
    done = slabs.load(slabs.DataSource.of_files(spark, [out]), "U,V,T")
    goal = gis.RegularGrid.from_header(KEYS).to_crs(spark, "geolatlon")
    for f in done.values():
        grid = f.meta.grid
        assert (grid.nx, grid.ny) == (goal.nx, goal.ny) and grid.x0 == pytest.approx(goal.x0) and f.meta.vref == "geo" and f.meta.keys["gridType"] == "regular_ll"
        assert f.df.count() == 2 * f.meta.keys["numberOfDataPoints"] and f.df.where("value is not null").count() > 20
    with pytest.raises(ValueError, match="own grid"):
        checked.regrid(field(spark, "U"), goal)
    with pytest.raises(RuntimeError, match="QV"):
        job.regrid(spark, [a], out + "2", "T,QV")


def test_time_ranges(spark):
    rows = [(h * 3600, y, x, float(h)) for h in range(4) for y in range(2) for x in range(2)]
    acc = Field(spark.createDataFrame(rows, "lead_s long, y int, x int, value double"), FieldMeta("TOT_PREC"))
    change = checked.delta(acc, 7200)
    assert change.meta.keys == {"lengthOfTimeRange": 120, "indicatorOfUnitForTimeRange": 0, "typeOfStatisticalProcessing": 4}
    assert {(r.begin_min, r.end_min) for r in slabs.to_slabs(change).collect()} == {(h * 60.0 - 120, h * 60.0) for h in range(4)}
    assert checked.resample_average(acc, 7200).meta.keys["typeOfStatisticalProcessing"] == 0 and checked.time_rate(acc, 3600).meta.keys["typeOfStatisticalProcessing"] == 255
    assert "typeOfStatisticalProcessing" not in checked.resample(acc, 7200).meta.keys and checked.resample(acc, 7200).df.count() == 8
    assert {r.begin_min for r in slabs.to_slabs(acc).collect()} == {0.0, 60.0, 120.0, 180.0}
    with pytest.raises(NotImplementedError):
        slabs.to_slabs(acc.derive(acc.df, numberOfTimeRange=2))


def test_archive_requests(spark):
    request = catalog.Request("U", ref_time="2020-01-01", number=0, lead_s=0)
    want = {"class": "od", "date": "20200101", "expver": "0001", "levtype": "ml", "levelist": list(range(1, 81)), "model": "cosmo-1e", "number": 0, "stream": "enfo", "param": 500028,
            "time": "0000", "type": "cf", "step": 0, "timespan": "none"}
    assert request.keys() == want and request.keys(as_text=True)["param"] == "500028"
    both = catalog.Request("U, V,W", ref_time="2020-01-01T06:00", lead_s=[3600, 5400], model="COSMO-2E").keys()
    assert (both["param"], both["levelist"][-1], both["step"], both["time"], "number" in both) == ([500028, 500030, 500032], 61, [1, 1.5], "0600", False)
    assert "levelist" not in catalog.Request("HSURF", ref_time="2020-01-01", levtype="sfc").keys()
    for bad, error in ((catalog.Request("U"), RuntimeError), (catalog.Request("U", ref_time="2020-01-01/.."), RuntimeError), (catalog.Request("NO", ref_time="2020-01-01"), KeyError)):
        with pytest.raises(error):
            bad.keys()
    assert parameters.vector_pairs(["T", "V_10M", "U_10M"]) == [("U_10M", "V_10M")]
    assert parameters.dimension(spark).where("half_levels").count() == 2


def test_checked_columns(spark):
    t, h = field(spark, value=lambda k, y, x: 270.0 + 5 * k), field(spark, "HFL", lambda k, y, x: 1000.0 * (3 - k))
    cold = t.derive(t.df.withColumn("value", F.col("value") - 3))
    assert [r.value for r in checked.zero_isotherm(cold, h).df.distinct().collect()] == [pytest.approx(2000 - (273.15 - 272) / 5 * 1000)] * 30
    assert {r.value for r in checked.minmax_k(t, h, 900.0, 1500.0, "maximum").df.collect()} == {280.0}
    out = checked.interpolate_k2theta(t, field(spark, "TH", lambda k, y, x: 320.0 - 10 * k), [305.0], h, "low_fold")
    assert {r.value for r in out.df.collect()} == {277.5} and out.meta.vcoord_type == "theta" and slabs.from_slabs(slabs.to_slabs(out)).first().target == 305.0
    half = field(spark, "HHL", lambda k, y, x: 3000.0 - 1000 * k, origin_z=-0.5)
    one = t.derive(t.df.where("k = 1"))
    assert {r.value for r in checked.integrate_k(one, half, 0.0, 9000.0).df.collect()} == {275.0 * 1000}
    u = field(spark, "U", shift=0.05)
    for bad in (lambda: checked.zero_isotherm(half, h), lambda: checked.integrate_k(t, h, 0.0, 1.0), lambda: checked.interpolate_k2any(t, half, [1.0], h, "low_fold"),
                lambda: checked.minmax_k(out, h, 0.0, 1.0, "maximum"), lambda: checked.bulk_richardson(t, u, u, h, h)):
        with pytest.raises(ValueError):
            bad()


def test_italian_grids(spark):
    """There and back, the projection against the length of the meridian, the datum against a matrix."""
    df = spark.createDataFrame([(7.6, 45.0), (9.0, 42.0), (12.45, 41.92), (16.8, 41.1)], "lon double, lat double")
    for zone in ("boaga-west", "boaga-east"):
        x, y = projections.System(zone).from_geographic(F.col("lon"), F.col("lat"))
        lon, lat = projections.System(zone).to_geographic(x, y)
        for r in df.select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
            assert r.a == pytest.approx(r.lon, abs=3e-8) and r.b == pytest.approx(r.lat, abs=3e-8)
    own = projections.BOAGA["boaga-west"]
    x, y = own.from_geographic(F.lit(9.0), F.lit(42.0))
    e2 = projections.HAYFORD_FLATTENING * (2 - projections.HAYFORD_FLATTENING)
    at = np.linspace(0, math.radians(42), 200001)
    length = np.trapezoid(projections.HAYFORD_AXIS * (1 - e2) / (1 - e2 * np.sin(at) ** 2) ** 1.5, at) * 0.9996
    got = df.limit(1).select(x.alias("x"), y.alias("y")).first()
    assert got.x == pytest.approx(1500000.0, abs=1e-6) and got.y == pytest.approx(length, abs=1e-3)
    dx, dy, dz, rx, ry, rz, ppm = projections.MONTE_MARIO
    rx, ry, rz = (math.radians(v / 3600) for v in (rx, ry, rz))
    want = np.array([dx, dy, dz]) + (1 + ppm * 1e-6) * np.array([[1, -rz, ry], [rz, 1, -rx], [-ry, rx, 1]]) @ np.array([4.6e6, 1.0e6, 4.2e6])
    point = [F.lit(v) for v in (4.6e6, 1.0e6, 4.2e6)]
    there = projections._turned(*point, projections.MONTE_MARIO, False)
    assert list(df.limit(1).select(*[c.alias(n) for n, c in zip("abc", there)]).first()) == pytest.approx(want.tolist(), abs=1e-6)
    back = projections._turned(*[F.lit(float(v)) for v in want], projections.MONTE_MARIO, True)
    assert list(df.limit(1).select(*[c.alias(n) for n, c in zip("abc", back)]).first()) == pytest.approx([4.6e6, 1.0e6, 4.2e6], abs=1e-6)


def test_weights_are_made_once(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    cells = spark.createDataFrame([(i, 7 + float(a), 45 + float(b)) for i, (a, b) in enumerate(rng.random((60, 2)))], "cell long, lon double, lat double")
    values = cells.select("cell", (F.col("lon") * 2).alias("f"))
    target, store = gis.RegularGrid(5, 4, 7.2, 45.2, 0.1, 0.1), str(tmp_path / "weights")
    first = {(r.y, r.x): r.value for r in triangles.iconremap(values, "f", cells, target, store=store).collect()}
    monkeypatch.setattr(triangles, "barycentric_weights", None)  # not called again
    again = triangles.iconremap(values, "f", cells.repartition(3), target, store=store)
    assert {(r.y, r.x): r.value for r in again.collect()} == first and any(v is not None for v in first.values())
    key = triangles.weights_key(cells, target)
    assert key != triangles.weights_key(cells.where("cell > 0"), target) and key != triangles.weights_key(cells, gis.RegularGrid(5, 4, 7.2, 45.2, 0.1, 0.2))


def test_remap_to_a_named_grid(spark):
    field_of_cells = Field(spark.createDataFrame([(0, 1.0), (1, 3.0)], "cell int, value double"), FieldMeta("T", grid_id="g", keys={"gridType": "unstructured_grid"}))
    weights = spark.createDataFrame([("g", "rotlatlon", d, 0, d % 2, 1.0, True) for d in range(6)], "grid_id string, goal string, dst int, slot int, cell int, w double, found boolean")
    grids = spark.createDataFrame([("g", "rotlatlon", 3, 2, -1.0, -1.0, 1.0, 1.0, 190.0, 43.0)], "grid_id string, goal string, nx int, ny int, xmin double, ymin double, xmax double, ymax double, pole_lon double, pole_lat double")
    out = checked.remap_to_grid(field_of_cells, "rotlatlon", weights, grids)
    assert {(r.y, r.x): r.value for r in out.df.collect()} == {(d // 3, d % 3): 1.0 + 2 * (d % 2) for d in range(6)} and out.meta.grid.pole == (190.0, 43.0) and out.meta.grid.dy == 2.0
    with pytest.raises(KeyError):
        checked.remap_to_grid(field_of_cells, "geolatlon", weights, grids)
    with pytest.raises(ValueError):
        checked.remap_to_grid(field(spark), "rotlatlon", weights, grids)


def test_checked_dynamics(spark):
    """The same numbers as the bare operators on a cube, and errors for fields that do not fit."""
    rng = np.random.default_rng(6)
    noise = {n: rng.normal(size=(4, 5, 6)) for n in ("u", "v", "w", "th", "rho", "etadot")}

    def cube(name, half, value):
        rows = [(k, y, x, float(value(k, y, x))) for k in range(1, 5 if half else 4) for y in range(5) for x in range(6)]
        return Field(spark.createDataFrame(rows, "k int, y int, x int, value double"), FieldMeta(name, keys=KEYS, origin_x=0.0, origin_y=0.0, origin_z=-0.5 if half else 0.0))

    of = lambda n: lambda k, y, x: noise[n][k - 1, y, x]
    u, v, th, rho = (cube(n, False, of(n.lower())) for n in ("U", "V", "TH", "RHO"))
    w, hhl = cube("W", True, of("w")), cube("HHL", True, lambda k, y, x: 5000 - 1000 * k + 10 * x + 7 * y)
    wide = hhl.df.withColumnRenamed("value", "h").join(w.df.withColumnRenamed("value", "w"), ["k", "y", "x"])
    for name, f in (("u", u), ("v", v)):
        wide = wide.join(f.df.withColumnRenamed("value", name), ["k", "y", "x"], "left")
    bare = dynamics.curl(wide.withColumn("rlat", F.radians(-1.0 + F.col("y") * 0.1)), "u", "v", "w", "h", "rlat", 0.1, 0.1)
    want = {(r.k, r.y, r.x): (r.curl_1, r.curl_2, r.curl_3) for r in bare.collect()}
    for i, (name, f) in enumerate(checked.curl(u, v, w, hhl).items()):
        got = {(r.k, r.y, r.x): r.value for r in f.df.collect()}
        assert got.keys() == want.keys() and f.meta.name == name.upper()
        assert all(got[p] is None if want[p][i] is None else got[p] == pytest.approx(want[p][i], rel=1e-9) for p in want)
    assert checked.potential_vorticity(u, v, w, th, rho, hhl).df.where("value is not null").count() == 3 * 3 * 4
    etadot = cube("ETADOT", True, of("etadot"))
    etadot = etadot.derive(etadot.df, pv=[20000.0, 15000.0, 7000.0, 0.0, 0.0, 0.1, 0.5, 1.0])
    ps = Field(u.df.where("k = 1").select("y", "x", F.lit(1e5).alias("value")), FieldMeta("PS", vcoord_type="surface"))
    omega = checked.omega_slope(etadot, ps)
    first = {(r.y, r.x): r.value for r in omega.df.where("k = 1").collect()}
    assert omega.df.count() == 90 and first[0, 0] == pytest.approx(2 * noise["etadot"][0, 0, 0] * 1e5 * (-5000 / 1e5 + 0.1) / (-5000 / dynamics.c.P_REF + 0.1))
    geo = u.derive(u.df, vref="geo")
    for bad in (lambda: checked.curl(geo, v, w, hhl), lambda: checked.curl(u, v, u, hhl), lambda: checked.curl(w, v, w, hhl), lambda: checked.potential_vorticity(u, geo, w, th, rho, hhl),
                lambda: checked.curl(u.derive(u.df, origin_x=0.5), v, w, hhl), lambda: checked.omega_slope(w, ps), lambda: checked.omega_slope(u, ps)):
        with pytest.raises(ValueError):
            bad()
    level = checked.destagger(w.derive(w.df, typeOfLevel="generalVertical"), "k")
    assert level.meta.keys["typeOfLevel"] == "generalVerticalLayer" and checked.to_geographic_axes(u, v)[0].meta.keys["uvRelativeToGrid"] == 0


def test_barycentric_remap_of_a_curved_field(spark):
    """Against the triangle that a search of all triples finds: it holds the point and its circle no other cell."""
    rng = np.random.default_rng(8)
    n = 24
    cells = spark.createDataFrame([(i, 7 + 2 * float(a), 45 + float(b)) for i, (a, b) in enumerate(rng.random((n, 2)))], "cell long, lon double, lat double")
    px, py = triangles.PLANE.from_geographic(F.col("lon"), F.col("lat"))
    at = np.array([(r.px, r.py) for r in cells.select("cell", px.alias("px"), py.alias("py")).orderBy("cell").collect()])
    f = np.sin(at[:, 0] / 2e4) + (at[:, 1] / 5e4) ** 2
    values = spark.createDataFrame([(i, float(v)) for i, v in enumerate(f)], "cell long, f double")
    target = gis.RegularGrid(8, 6, 7.2, 45.1, 0.22, 0.15)
    qx, qy = triangles.PLANE.from_geographic(F.col("gx"), F.col("gy"))
    goal = {(r.y, r.x): np.array([r.qx, r.qy]) for r in target.points(spark).select("y", "x", qx.alias("qx"), qy.alias("qy")).collect()}

    def brute(q):
        for i in range(n):
            for j in range(i):
                for k in range(j):
                    a, b, c = at[i], at[j], at[k]
                    m = np.array([[a[0], b[0], c[0]], [a[1], b[1], c[1]], [1, 1, 1]])
                    w = np.linalg.solve(m, np.array([q[0], q[1], 1]))
                    if (w >= 0).all():
                        centre = np.linalg.solve(2 * np.array([b - a, c - a]), np.array([b @ b - a @ a, c @ c - a @ a]))
                        r = np.hypot(*(a - centre))
                        if sum(np.hypot(*(p - centre)) < r * (1 - 1e-9) for p in at) == 0:
                            return float(w @ f[[i, j, k]])
        return None

    got = {(r.y, r.x): r.value for r in triangles.iconremap(values, "f", cells, target).collect()}
    want = {p: brute(q) for p, q in goal.items()}
    assert sum(v is not None for v in want.values()) > 20
    assert all(got[p] is None if v is None else got[p] == pytest.approx(v, abs=1e-9) for p, v in want.items())


def test_targets_of_a_tile_are_searched_together(monkeypatch):
    """Steps go by tile and not by target, and chunks of targets change nothing."""
    rng = np.random.default_rng(12)
    points, q = rng.random((60, 2)) * 3000, 1000 + 1000 * rng.random((400, 2))
    own = pd.DataFrame({"cell": np.arange(60), "dst": None, "px": points[:, 0], "py": points[:, 1]})
    pdf = pd.concat((own, pd.DataFrame({"cell": None, "dst": np.arange(400), "px": q[:, 0], "py": q[:, 1]})))
    steps, inverse = [], np.linalg.inv
    monkeypatch.setattr(np.linalg, "inv", lambda m: steps.append(len(m)) or inverse(m))
    of = triangles._tiles(1000.0, points.min(0), points.max(0))
    found = of((1, 1), pdf)
    assert len(steps) < 100 < len(found) == found["dst"].nunique()
    monkeypatch.setattr(triangles, "CHUNK", 1000)
    pd.testing.assert_frame_equal(of((1, 1), pdf).reset_index(drop=True), found.reset_index(drop=True))
    for r in found.itertuples():
        at, w = points[[r.cell_0, r.cell_1, r.cell_2]], np.array([r.w_0, r.w_1, r.w_2])
        assert w @ at == pytest.approx(q[r.dst], abs=1e-6)
        centre = np.linalg.solve(2 * (at[1:] - at[0]), (at[1:] ** 2).sum(1) - (at[0] ** 2).sum())
        assert (np.hypot(*(points - centre).T) >= np.hypot(*(at[0] - centre)) * (1 - 1e-9)).all()


def test_points_in_a_hull():
    rng = np.random.default_rng(13)
    for points in (rng.random((50, 2)), np.array([[0, 0], [0, 1], [1, 0], [1, 1.0]]), np.array([[0, 0], [1, 2], [1, -2.0]]), np.array([[0, 0], [1, 1], [2, 2.0]])):
        hull = triangles.hull_of(points)
        q = np.concatenate((rng.random((300, 2)) * 1.4 - 0.2, points))
        want = len(hull) > 2 and np.array([all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= -1e-9 for (ax, ay), (bx, by) in zip(hull, np.roll(hull, -1, axis=0))) for x, y in q])
        assert (triangles._inside(hull).func(pd.Series(q[:, 0]), pd.Series(q[:, 1])).to_numpy() == want).all()


def test_columns_give_the_rows_of_levels_without_a_shuffle(spark):
    """Column arrays from long rows: the same values as the long operators; on arrays no exchange."""
    rng = np.random.default_rng(9)
    rows = [(e, y, x, k, float(20000 * k + 900 * rng.random()), float(rng.normal(270, 15)), 9000.0 - 1500 * k - 10 * rng.random()) for e in (0, 1) for y in range(2) for x in range(3) for k in range(1, 6)]
    rows.append((0, 9, 9, 1, 20000.0, 280.0, 5000.0))  # a column of one level
    df = spark.createDataFrame(rows, "eps int, y int, x int, k int, p double, t double, h double")
    wide = spark.createDataFrame(columns.to_columns(df, "p", "t", "h").collect(), columns.to_columns(df, "p", "t", "h").schema)
    assert columns.to_levels(wide, "p", "t", "h").count() == len(rows)
    pairs = [(vertical.interpolate_k2p(df, "t", "p", [300.0, 500.0, 1100.0], m, "hPa"), columns.interpolate_k2p(wide, "t", "p", [300.0, 500.0, 1100.0], m, "hPa")) for m in ("linear_in_p", "linear_in_lnp", "nearest_sfc")]
    pairs += [(vertical.zero_isotherm(df, "t", "h", e), columns.zero_isotherm(wide, "t", "h", e)) for e in (False, True)]
    bounds = df.withColumns({"b": F.lit(2000.0), "u": F.lit(6000.0)})
    pairs += [(vertical.minmax_k(bounds, "t", "h", "b", "u", o), columns.minmax_k(wide, "t", "h", F.lit(2000.0), F.lit(6000.0), o)) for o in ("minimum", "maximum")]
    for long, short in pairs:
        assert "Exchange" not in short._jdf.queryExecution().executedPlan().toString()
        key = lambda r: tuple(v for v, c in zip(r, long.columns) if c != "value")
        want = {key(r): r.value for r in long.collect()}
        got = {key(r): r.value for r in short.select(long.columns).collect()}
        assert got.keys() == want.keys() and all(got[k] == (None if v is None else pytest.approx(v, rel=1e-12)) for k, v in want.items())
    with pytest.raises(RuntimeError):
        columns.interpolate_k2p(wide, "t", "p", [1.0], "other")
