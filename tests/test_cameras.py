"""Posed cameras, geodesy and radiometry on small cases."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathline.operators import camera as C
from swathline.operators import geodesy as G
from swathline.operators import radiometry as Q

from .conftest import to_array

SAMPLES = "raster_id string, band string, ub double, vb double"


def test_bilinear(spark, make_raster):
    r = make_raster({"b": np.arange(16.0).reshape(4, 4)})
    s = spark.createDataFrame([("r", "b", 1.0, 1.0), ("r", "b", 2.0, 2.0), ("r", "b", 3.0, 1.0), ("r", "b", 0.5, 0.5)], SAMPLES)
    got = {(x["ub"], x["vb"]): x["value"] for x in C.bilinear_gather(r, s).collect()}
    assert got == {(1.0, 1.0): 5.0, (2.0, 2.0): 10.0, (0.5, 0.5): 2.5}


def test_invert3(spark):
    h = [1.7162, 0.0, 415.75, 0.0, 1.7162, 309.81, 0.0, 0.0, 1.0]
    df = spark.createDataFrame([(h,), ([0.0] * 9,)], "h array<double>")
    good, bad = C.invert3(df, "h", "i").collect()
    assert np.allclose([good[f"i{k}"] for k in range(9)], np.linalg.inv(np.array(h).reshape(3, 3)).ravel())
    assert bad["i0"] is None


def test_quaternions(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 1.0)], "qw double, qx double, qy double, qz double")
    a, b = G.quat_to_rot(df).collect()
    assert np.allclose([a[f"r{i}{j}"] for i in range(3) for j in range(3)], np.eye(3).ravel())
    assert np.allclose([b[f"r{i}{j}"] for i in range(3) for j in range(3)], np.diag([-1, -1, 1]).ravel())


def test_principal_point(spark):
    cam = C.Camera(5280, 3956, 3713.0, 3713.0, 2640.0, 1978.0)
    pose = {**{f"r{i}{j}": float(i == j) for i in range(3) for j in range(3)}, "tx": 0.0, "ty": 0.0, "tz": 0.0}
    df = spark.createDataFrame([{**pose, "x": 0.0, "y": 0.0, "z": 10.0}, {**pose, "x": 1.0, "y": 2.0, "z": -1.0}])
    a, b = C.project_pinhole(df, cam).orderBy(F.desc("z")).collect()
    assert (a["u"], a["v"], a["in_front"]) == (2640.0, 1978.0, True) and not b["in_front"]


def _random_poses(n: int, seed: int):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        tilt, yaw = rng.uniform(0, 0.9), rng.uniform(0, 2 * math.pi)
        qf = np.array([0.0, 1.0, 0.0, 0.0])
        qy = np.array([math.cos(yaw / 2), 0, 0, math.sin(yaw / 2)])
        qt = np.array([math.cos(tilt / 2), math.sin(tilt / 2), 0, 0])

        def mul(a, b):
            w1, x1, y1, z1 = a
            w2, x2, y2, z2 = b
            return np.array([w1 * w2 - x1 * x2 - y1 * y2 - z1 * z2, w1 * x2 + x1 * w2 + y1 * z2 - z1 * y2,
                             w1 * y2 - x1 * z2 + y1 * w2 + z1 * x2, w1 * z2 + x1 * y2 - y1 * x2 + z1 * w2])
        q = mul(qt, mul(qf, qy))
        w, x, y, z = q
        rot = np.array([[1 - 2 * y * y - 2 * z * z, 2 * x * y - 2 * w * z, 2 * x * z + 2 * w * y],
                        [2 * x * y + 2 * w * z, 1 - 2 * x * x - 2 * z * z, 2 * y * z - 2 * w * x],
                        [2 * x * z - 2 * w * y, 2 * y * z + 2 * w * x, 1 - 2 * x * x - 2 * y * y]])
        t = -rot @ np.array([rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(5, 40)])
        rows.append((i, *[float(v) for v in q], *[float(v) for v in t]))
    return rows


@pytest.mark.parametrize("dist", [(0.0,) * 8, (-0.25, 0.1, 0.001, -0.002, -0.02, 0.0, 0.0, 0.0)])
def test_project_join_loses_nothing(spark, dist):
    """The descent through blocks gives what testing every cell against every tilted image gives."""
    cam = C.Camera(64, 48, 60.0, 60.0, 32.0, 24.0, dist)
    cells = spark.range(60 * 60).select(
        F.floor(F.col("id") / 60).cast("int").alias("row"), (F.col("id") % 60).cast("int").alias("col"))
    cells = cells.withColumns({"x": F.col("col") + 0.5, "y": F.col("row") + 0.5, "z": F.sin(F.col("col") / 5.0) * 2})
    poses = spark.createDataFrame(_random_poses(12, 3), "image_id int, qw double, qx double, qy double, qz double, tx double, ty double, tz double")
    fast = {(r["row"], r["col"], r["image_id"]) for r in C.project_join(cells, poses, cam, tile=4).collect()}
    every = cells.crossJoin(G.quat_to_rot(poses))
    slow = {(r["row"], r["col"], r["image_id"]) for r in C.project_pinhole(every, cam).where(C.in_frame(cam)).collect()}
    assert fast == slow and slow


def test_rational_model_differs(spark):
    cam = C.Camera(64, 48, 60.0, 60.0, 32.0, 24.0, (0.1, 0.0, 0.0, 0.0, 0.0, 0.2, 0.0, 0.0))
    assert cam.radial(1.0, "polynomial") == pytest.approx(1.3)
    assert cam.radial(1.0, "rational") == pytest.approx(1.1 / 1.2)


@pytest.mark.parametrize("lat,lon", [(41.3, 2.1), (-33.9, 18.4), (64.1, -21.9), (0.0, 10.0)])
def test_utm_round_trip(spark, lat, lon):
    df = spark.createDataFrame([(lat, lon, 120.0)], "lat double, lon double, alt double")
    epsg = G.utm_epsg(df).first()["epsg"]
    utm = G.gps_to_utm(df, epsg)
    back = G.utm_to_gps(utm.drop("lat", "lon"), epsg).first()
    assert back["lat"] == pytest.approx(lat, abs=1e-10) and back["lon"] == pytest.approx(lon, abs=1e-10)
    e = G.gps_to_ecef(df)
    g = G.ecef_to_gps(e.drop("lat", "lon", "alt")).first()
    assert (g["lat"], g["lon"], g["alt"]) == pytest.approx((lat, lon, 120.0), abs=1e-8)


def test_known_utm_point(spark):
    """On the central meridian the easting is the false easting; the equator has northing zero."""
    got = G.gps_to_utm(spark.createDataFrame([(0.0, 3.0)], "lat double, lon double"), 32631).first()
    assert (got["east"], got["north"]) == pytest.approx((500000.0, 0.0), abs=1e-6)


def test_sim3_round_trip(spark):
    sim = G.Sim3(2.5, (0.9, 0.1, -0.3, 0.3), (10.0, -5.0, 3.0))
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, z double")
    back = G.sim3_invert(G.sim3_apply(df, sim).drop("x", "y", "z"), sim).first()
    assert (back["x"], back["y"], back["z"]) == pytest.approx((1.0, 2.0, 3.0))


META = ("raster_id string, band string, width int, height int, sensor_gain double, exposure_time_us double, black_level double, "
        "sensor_gain_adjustment double, irradiance double, irradiance_exposure double, irradiance_gain double, bit_depth int, "
        "centre_x double, centre_y double, vignetting array<double>, dewarp array<double>, homography array<double>")


def meta(spark, band="nir", vig=(), dewarp=(), hom=(), irradiance=0.7):
    return spark.createDataFrame([("r", band, 8, 8, 1.0, 1000.0, 3200.0, 1.0, irradiance, 1.0, 1.0, 16, 4.0, 4.0,
                                   [float(v) for v in vig], [float(v) for v in dewarp],
                                   [float(v) for v in hom])], META)


def test_vignetting_centre_unchanged(spark, make_raster):
    r = make_raster({"nir": np.full((8, 8), 100.0)})
    got = to_array(Q.vignetting(r, meta(spark, vig=[1e-2] * 6)), (8, 8))
    assert got[4, 4] == 100.0 and got[0, 0] > 100
    assert np.array_equal(to_array(Q.vignetting(r, meta(spark, vig=[1e-2] * 5)), (8, 8)), np.full((8, 8), 100.0))


def test_identity_resampling(spark, make_raster):
    arr = np.random.default_rng(0).random((8, 8))
    r = make_raster({"nir": arr})
    assert np.allclose(to_array(Q.undistort(r, meta(spark, dewarp=[10, 10, 0, 0, 0, 0, 0, 0, 0.0])), (8, 8)), arr)
    shift = to_array(Q.homography_align(r, meta(spark, hom=[1, 0, 2, 0, 1, 1, 0, 0, 1.0])), (8, 8))
    assert np.allclose(shift[1:, 2:], arr[:-1, :-2]) and np.allclose(shift[0, :], 0)


def test_calibrate_range_and_failures(spark, make_raster):
    r = make_raster({"nir": np.full((8, 8), 3200.0 + 32.0), "rgb": np.full((8, 8), 9.0), "red": np.ones((8, 8))})
    m = meta(spark).unionByName(meta(spark, band="red", irradiance=None))
    done, outcome = Q.calibrate(r, m)
    states = {x["band"]: x["state"] for x in outcome.collect()}
    assert states == {"nir": "reflectance", "rgb": "calibrated", "red": "failed"}
    values = {x["band"]: x["value"] for x in done.groupBy("band").agg(F.avg("value").alias("value")).collect()}
    assert values["rgb"] == 9.0 and "red" not in values
    assert values["nir"] == pytest.approx(32.0 / 65536 / 1e-3 / 0.7, rel=1e-6)
