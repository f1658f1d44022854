"""Nodata, NaN and infinities on entry to sampling, radiometry and quality checks; the distance transform against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest

from swathline.operators import camera, neighbours, radiometry, surfaces, validate

from .conftest import RASTER, to_array

ODD = [None, -9999.0, math.nan, math.inf, -math.inf]
META = ("raster_id string, band string, sensor_gain double, exposure_time_us double, black_level double, sensor_gain_adjustment double, irradiance double, "
        "irradiance_exposure double, irradiance_gain double, bit_depth int, centre_x double, centre_y double, vignetting array<double>, dewarp array<double>, "
        "homography array<double>, width int, height int")


def square(spark, odd, n=4, band="b"):
    return spark.createDataFrame([("r", band, r, c, odd if (r, c) == (1, 1) else float(r * n + c + 1)) for r in range(n) for c in range(n)], RASTER)


def meta(spark, dewarp=(), homography=()):
    return spark.createDataFrame([("r", "b", 1.0, 1000.0, 1.0, 1.0, 1.0, 1.0, 1.0, 8, None, None, [0.1] * 6, [float(x) for x in dewarp], list(homography), 4, 4)], META)


@pytest.mark.parametrize("odd", ODD)
def test_samples_that_touch_nodata_give_nothing(spark, odd):
    at = spark.createDataFrame([("r", "b", 0.5, 0.5), ("r", "b", 2.5, 2.5)], "raster_id string, band string, ub double, vb double")
    assert [(x["ub"], x["value"]) for x in camera.bilinear_gather(square(spark, odd), at).collect()] == [(2.5, 13.5)]
    filled = {x["ub"]: x["value"] for x in camera.bilinear_gather(square(spark, odd), at, nodata=0.0).collect()}
    assert filled == {0.5: (1 + 2 + 5) / 4, 2.5: 13.5}


@pytest.mark.parametrize("odd", ODD)
def test_no_step_of_calibration_makes_a_number_of_nodata(spark, odd):
    raster, m = square(spark, odd), meta(spark)
    for out in (radiometry.vignetting(raster, m), radiometry.camera_signal(raster, m), radiometry.reflectance(raster, m), radiometry.calibrate(raster, m)[0]):
        values = {(x["row"], x["col"]): x["value"] for x in out.collect()}
        assert values[1, 1] is None and all(v is not None for k, v in values.items() if k != (1, 1))
    lens = radiometry.undistort(raster, meta(spark, dewarp=[4.0, 4.0, 0, 0, 0, 0, 0, 0, 0]))
    same = radiometry.undistort(square(spark, 0.0), meta(spark, dewarp=[4.0, 4.0, 0, 0, 0, 0, 0, 0, 0]))
    assert np.allclose(to_array(lens, (4, 4)), to_array(same, (4, 4)))


@pytest.mark.parametrize("odd", ODD)
def test_quality_checks_pass_over_nodata(spark, odd):
    half = spark.createDataFrame([("r", b, r, c, odd if r < 2 else 100.0 + c) for b in ("red", "green", "blue") for r in range(4) for c in range(4)], RASTER)
    zero = spark.createDataFrame([("r", b, r, c, 0.0 if r < 2 else 100.0 + c) for b in ("red", "green", "blue") for r in range(4) for c in range(4)], RASTER)
    assert validate.visual_coverage(half).first()["coverage"] == 0.5
    for check in (validate.visual_blur, validate.visual_color, validate.visual_seams, validate.visual_qa):
        assert check(half).first() == check(zero).first()
    assert surfaces.surface_fit(square(spark, odd)).first()["cells"] == 15
    assert surfaces.surface_fit(square(spark, odd)).first()["explained"] == pytest.approx(1.0)


@pytest.mark.parametrize("odd", ODD)
def test_reproducibility_takes_missing_values_as_the_mean(spark, odd):
    rng = np.random.default_rng(3)
    runs = rng.random((3, 50))
    rows = [("g", f"r{k}", i, odd if (k, i) == (1, 7) else float(x)) for k, run in enumerate(runs) for i, x in enumerate(run)]
    got = validate.reproducibility(spark.createDataFrame(rows, "group_id string, run_id string, ordinal int, value double")).first()
    z = []
    for k, run in enumerate(runs):
        known = np.delete(run, 7) if k == 1 else run
        own = (run - known.mean()) / known.std()
        if k == 1:
            own[7] = 0.0
        z.append(own)
    want = np.mean([(z[a] * z[b]).mean() for a, b in ((0, 1), (0, 2), (1, 2))])
    assert got["correlation"] == pytest.approx(want)


@pytest.mark.parametrize(("seed", "limit"), [(1, None), (2, 5), (3, 0), (4, None)])
def test_the_distance_transform_is_exact_with_ties(make_raster, seed, limit):
    rng = np.random.default_rng(seed)
    arr = np.where(rng.random((40, 27)) < (0.02, 0.5, 0.1, 0.005)[seed - 1], rng.random((40, 27)), np.nan)
    arr[rng.random(arr.shape) < 0.1] = -9999
    known = np.argwhere(~np.isnan(arr) & (arr != -9999))
    want = np.full(arr.shape, np.nan)
    for r, c in np.ndindex(arr.shape):
        d, a, b = min((int((r - a) ** 2 + (c - b) ** 2), a, b) for a, b in known)
        if limit is None or d <= limit * limit:
            want[r, c] = arr[a, b]
    out = neighbours.nearest_valid(make_raster({"b": arr}), limit)
    assert np.array_equal(to_array(out, arr.shape), want, equal_nan=True)
    assert sum(x["was_hole"] for x in out.collect()) == arr.size - len(known)


def test_the_distance_transform_takes_two_passes(make_raster):
    plan = neighbours.nearest_valid(make_raster({"b": np.array([[1.0, np.nan]])}))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and plan.count("FlatMapGroupsInPandas") == 1


def test_rasters_apart_and_empty(spark):
    rows = [("a", "b", 0, 0, 1.0), ("a", "b", 0, 1, None), ("a", "c", 0, 0, None), ("a", "c", 0, 1, 5.0), ("z", "b", 0, 0, None)]
    got = {tuple(x)[:4]: x["value"] for x in neighbours.nearest_valid(spark.createDataFrame(rows, RASTER)).collect()}
    assert got == {("a", "b", 0, 0): 1.0, ("a", "b", 0, 1): 1.0, ("a", "c", 0, 0): 5.0, ("a", "c", 0, 1): 5.0, ("z", "b", 0, 0): None}
    assert neighbours.nearest_valid(spark.createDataFrame([], RASTER)).count() == 0
