"""Raster operators against plain NumPy on small arrays."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathline.operators import composite, georef, indices, matching, neighbours, surfaces, terrain
from swathline.operators.grid import Grid, densify

from .conftest import to_array


def holes(seed: int, shape=(13, 17), share=0.25) -> np.ndarray:
    rng = np.random.default_rng(seed)
    arr = rng.random(shape) * 10
    arr[rng.random(shape) < share] = np.nan
    return arr


def test_index_values(spark, make_raster):
    r = make_raster({"nir": np.array([[.8, .6], [.4, .2]]), "red": np.array([[.2, .3], [.4, .5]])})
    got = to_array(indices.normalised_difference(r, "ndvi"), (2, 2))
    assert np.allclose(got, [[.6, 1 / 3], [0, -3 / 7]])


def test_index_zero_denominator(make_raster):
    r = make_raster({"nir": np.zeros((1, 1)), "red": np.zeros((1, 1))})
    assert indices.normalised_difference(r, "ndvi", "production").first()["value"] == 0
    assert np.isnan(indices.normalised_difference(r, "ndvi", "validation").first()["value"])
    assert indices.normalised_difference(r, "ndvi", "calibrator").first()["value"] == 0


def test_common_gain_leaves_index(make_raster):
    nir, red = np.abs(holes(1, share=0)), np.abs(holes(2, share=0)) + 1
    a = to_array(indices.normalised_difference(make_raster({"nir": nir, "red": red}), "ndvi"), nir.shape)
    b = to_array(indices.normalised_difference(make_raster({"nir": nir * 1.7, "red": red * 1.7}), "ndvi"), nir.shape)
    assert np.allclose(a, b)


def test_stack_needs_a_band(make_raster):
    with pytest.raises(ValueError):
        indices.stack_bands(make_raster({"thermal": np.ones((2, 2))}))


def test_edge_weight(make_raster):
    arr = holes(3)
    valid = ~np.isnan(arr)
    h, w = arr.shape
    want = np.zeros(arr.shape)
    for r in range(h):
        for c in range(w):
            if valid[r, c]:
                best = []
                for dr, dc in ((0, 1), (0, -1), (1, 0), (-1, 0)):
                    k = 1
                    while 0 <= r + dr * k < h and 0 <= c + dc * k < w and valid[r + dr * k, c + dc * k]:
                        k += 1
                    best.append(k)
                want[r, c] = min(best)
    got = to_array(neighbours.edge_weight(make_raster({"b": arr})), arr.shape, col="weight")
    assert np.array_equal(got, want)


@pytest.mark.parametrize("n", [0, 1, 2, 4])
def test_erode(spark, n):
    rng = np.random.default_rng(n)
    mask = rng.random((25, 30)) < 0.97
    want = mask.copy()
    for _ in range(n):
        e = np.zeros_like(want)
        e[1:-1, 1:-1] = want[1:-1, 1:-1] & want[:-2, 1:-1] & want[2:, 1:-1] & want[1:-1, :-2] & want[1:-1, 2:]
        want = e
    rows = [("r", int(r), int(c)) for r, c in zip(*np.nonzero(mask))]
    got = {(x["row"], x["col"]) for x in neighbours.erode(
        spark.createDataFrame(rows, "raster_id string, row int, col int"), n).collect()}
    assert got == {(int(r), int(c)) for r, c in zip(*np.nonzero(want))}


def test_nearest_valid(make_raster):
    arr = holes(5, share=0.6)
    got = to_array(neighbours.nearest_valid(make_raster({"b": arr}), 30), arr.shape)
    pts = np.argwhere(~np.isnan(arr))
    for r, c in np.argwhere(np.isnan(arr)):
        d = ((pts - [r, c]) ** 2).sum(axis=1)
        first = pts[np.lexsort((pts[:, 1], pts[:, 0], d))[0]]
        assert got[r, c] == pytest.approx(arr[tuple(first)])


def test_fill_holes_smoothing_only_touches_holes(make_raster):
    arr = holes(6)
    plain = to_array(neighbours.fill_holes(make_raster({"b": arr}), 10), arr.shape)
    smooth = to_array(neighbours.fill_holes(make_raster({"b": arr}), 10, smooth=2), arr.shape)
    ok = ~np.isnan(arr)
    assert np.allclose(plain[ok], arr[ok]) and np.allclose(smooth[ok], arr[ok])
    assert not np.isnan(plain).any()


def test_hillshade_of_plane_is_even(make_raster):
    y, x = np.mgrid[0:9, 0:9]
    got = to_array(terrain.hillshade(make_raster({"b": 2.0 * x - y}), res=1.0), (9, 9))
    assert np.ptp(got) < 1e-9


def test_slope_of_plane(make_raster):
    y, x = np.mgrid[0:9, 0:9]
    got = to_array(terrain.slope(make_raster({"b": 1.0 * x}), res=1.0), (9, 9))
    assert np.allclose(got[:, 1:-1], 45.0)


def test_overviews_keep_the_total(make_raster):
    arr = holes(7, shape=(16, 16), share=0)
    o = indices.overviews(make_raster({"b": arr}))
    for level in (2, 4, 8, 16):
        mean = o.where(F.col("level") == level).agg(F.avg("value")).first()[0]
        assert mean == pytest.approx(arr.mean())


def test_multires_of_a_constant(make_raster):
    m = indices.multires(make_raster({"b": np.full((16, 16), 3.0)}), 16, 16)
    assert m.agg(F.max(F.abs(F.col("value") - 3))).first()[0] < 1e-9
    assert {r["factor"]: r["count"] for r in m.groupBy("factor").count().collect()} == {2: 64, 4: 16, 8: 4}


def test_two_strips(spark):
    rng = np.random.default_rng(0)
    rows = [("f", i, (0.0 if i < 5 else 0.00018) + rng.normal(0, 2e-6), (i % 5) * 1e-4) for i in range(10)]
    df = spark.createDataFrame(rows, "flight string, capture_id int, lat double, lon double")
    got = {r["capture_id"]: r["strip"] for r in composite.flight_strips(df).collect()}
    assert {got[i] for i in range(5)} != {got[i] for i in range(5, 10)}
    assert len(set(got.values())) == 2


def test_one_capture_is_one_strip(spark):
    df = spark.createDataFrame([("f", 1, 41.0, 2.0)], "flight string, capture_id int, lat double, lon double")
    assert [r["strip"] for r in composite.flight_strips(df).collect()] == [0]


def test_hovering_flight(spark):
    """A flight that hangs in one place for most of its captures stays one strip beside a second one."""
    df = spark.range(3000).select(
        F.lit("f").alias("flight"), F.col("id").alias("capture_id"),
        F.when(F.col("id") < 2000, 41.0).otherwise(41.0 + 0.0005).alias("lat"), (F.col("id") % 50 * 1e-4).alias("lon"))
    got = composite.flight_strips(df).groupBy("strip").count().collect()
    assert sorted(r["count"] for r in got) == [1000, 2000]


def test_gain_is_shared_and_neutral_without_strips(spark):
    means = spark.createDataFrame(
        [("f", i, b, v * k) for i, v in enumerate([1.0, 1.0, 2.0, 2.0]) for b, k in (("red", 1), ("nir", 5))],
        "flight string, image_id int, band string, mean double")
    strips = spark.createDataFrame([("f", i, i // 2) for i in range(4)], "flight string, image_id int, strip int")
    got = {r["image_id"]: r["gain"] for r in composite.strip_gain(means, strips).collect()}
    assert got[0] == pytest.approx(1.5) and got[3] == pytest.approx(0.75)
    one = strips.withColumn("strip", F.lit(0))
    assert {r["gain"] for r in composite.strip_gain(means, one).collect()} == {1.0}


def test_feather_composite_nodata(make_raster):
    a, b = np.full((3, 3), 2.0), np.full((3, 3), 4.0)
    a[1, 1] = np.nan
    r = make_raster({"red": a}, "a").unionByName(make_raster({"red": b}, "b"))
    gains = r.select("raster_id").distinct().withColumn("gain", F.lit(1.0))
    got = to_array(composite.feather_composite(r, gains), (3, 3))
    assert got[1, 1] == 4.0 and got[0, 0] == pytest.approx(3.0)


@pytest.mark.parametrize("shift,limit,want", [((5, -3), 40, (-5, 3)), ((30, 0), 10, (0, 0))])
def test_phase_shift(make_raster, shift, limit, want):
    ref = np.random.default_rng(0).random((64, 64))
    mov = np.roll(ref, shift, axis=(0, 1))
    got = matching.band_register(make_raster({"nir": ref, "red": mov}), max_shift=limit).first()
    assert (got["dy"], got["dx"]) == want


@pytest.mark.parametrize("method", ["phase", "search"])
def test_registration_leaves_out_nodata(make_raster, method):
    ref = np.random.default_rng(4).random((24, 24))
    mov = np.roll(ref, (2, -1), axis=(0, 1))
    mov[4:6, 6:9], ref[15, :5] = -9999, np.inf
    got = matching.band_register(make_raster({"nir": ref, "red": mov}), max_shift=3, method=method).first()
    assert (got["dy"], got["dx"]) == (-2, 1)


def test_search_finds_the_same_shift(make_raster):
    ref = np.random.default_rng(1).random((24, 24))
    r = make_raster({"nir": ref, "red": np.roll(ref, (2, -1), axis=(0, 1))})
    got = matching.band_register(r, max_shift=3, method="search").first()
    assert (got["dy"], got["dx"]) == (-2, 1)
    moved = to_array(matching.apply_shift(r, matching.band_register(r, max_shift=3, method="search")), ref.shape, band="red")
    inside = ~np.isnan(moved)
    assert np.allclose(moved[inside], ref[inside]) and np.isnan(moved[-2:, :]).all() and np.isnan(moved[:, :1]).all()


def test_median_smooth(make_raster):
    arr = np.arange(25.0).reshape(5, 5)
    arr[2, 2] = 1000
    got = to_array(neighbours.median_smooth(make_raster({"b": arr})), (5, 5))
    assert got[2, 2] == np.median(arr[1:4, 1:4]) and got[0, 0] == np.median(arr[:2, :2])


def test_surface_fit_quadratic(make_raster):
    y, x = np.mgrid[0:20, 0:30]
    r = make_raster({"b": 3 + 0.5 * x - 0.2 * y + 0.01 * x * x + 0.02 * x * y - 0.03 * y * y})
    got = surfaces.surface_fit(r, 2).first()
    assert got["explained"] == pytest.approx(1.0) and got["residual_std"] < 1e-6
    assert surfaces.surface_fit(r, 1).first()["explained"] < 1


def test_densify(spark, make_raster):
    r = make_raster({"b": np.ones((2, 2))}).where("row <> 1 OR col <> 1")
    d = densify(r, Grid("r", 3, 2, 0, 0, 1, 1))
    assert d.count() == 6 and d.where("value IS NULL").count() == 3


def test_warp_to_utm(spark, make_raster):
    """A north-up image of 1 m pixels keeps its values when warped to a 1 m UTM grid around its centre."""
    from swathline.operators.geodesy import gps_to_utm
    arr = np.random.default_rng(4).random((21, 21))
    lat, lon = 41.0, -3.0  # on the zone's meridian, where grid north is true north
    centre = gps_to_utm(spark.createDataFrame([(lat, lon)], "lat double, lon double"), 32630).first()
    cap = spark.createDataFrame([("r", 21, 21, lat, lon, 30.0, 0.0)],
                                "raster_id string, width int, height int, lat double, lon double, agl_m double, yaw_deg double")
    cap = cap.withColumn("hfov_deg", F.degrees(2 * F.atan(F.lit(21 / 2 / 30.0))))
    images = georef.direct_georef(cap)
    grid = Grid("g", 9, 9, centre["east"] - 4.5, centre["north"] + 4.5, 1.0, -1.0, epsg=32630)
    got = to_array(georef.warp_nearest(make_raster({"b": arr}), images, grid), (9, 9))
    assert np.array_equal(got, arr[6:15, 6:15])


def test_values_that_are_not_finite_are_nodata(make_raster, spark):
    bad = [np.inf, -np.inf, -9999.0]
    raster = make_raster({"nir": np.array([[0.8, 0.6, 0.5, 0.7]]), "red": np.array([[0.2, *bad]])})
    spoilt = raster.unionByName(spark.createDataFrame([("r", "nir", 0, 4, float("nan")), ("r", "red", 0, 4, 0.5)], raster.schema))
    got = {r["col"]: r["value"] for r in indices.normalised_difference(spoilt, "ndvi").collect()}
    assert got == {0: pytest.approx(0.6), 1: None, 2: None, 3: None, 4: None}
    mean = {r["band"]: (r["mean"], r["valid"]) for r in indices.image_mean(spoilt).collect()}
    assert mean == {"nir": (pytest.approx(0.65), 4), "red": (pytest.approx(0.35), 2)}
    weights = {(r["band"], r["col"]) for r in neighbours.valid_weights(spoilt).collect()}
    assert weights == {("nir", 0), ("nir", 1), ("nir", 2), ("nir", 3), ("red", 0), ("red", 4)}


def test_nearest_valid_has_no_limit(make_raster):
    rng = np.random.default_rng(3)
    arr = np.full((23, 31), np.nan)
    for r, c in zip(rng.integers(0, 6, 8), rng.integers(0, 9, 8), strict=True):
        arr[r, c] = rng.random()
    arr[22, 30] = 2.0
    rows = np.argwhere(~np.isnan(arr))
    want = arr.copy()
    for r, c in np.argwhere(np.isnan(arr)):
        best = min(((r - a) ** 2 + (c - b) ** 2, a, b) for a, b in rows)
        want[r, c] = arr[best[1], best[2]]
    got = to_array(neighbours.nearest_valid(make_raster({"b": arr})), arr.shape)
    assert np.array_equal(got, want)
    empty = neighbours.nearest_valid(make_raster({"b": np.full((2, 3), np.nan)})).collect()
    assert len(empty) == 6 and all(r["value"] is None and r["was_hole"] for r in empty)


def test_flight_strips_refuse_a_gap_below_the_slot(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 0.0)], "flight int, capture_id int, lat double, lon double")
    with pytest.raises(ValueError):
        composite.flight_strips(df, min_gap_m=0.01)


def test_registration_far_from_the_origin(spark):
    rng = np.random.default_rng(0)
    ref = rng.random((64, 64))
    moved = np.roll(ref, (5, -3), axis=(0, 1))
    cells = [("r", b, r + 900_000, c + 700_000, float(a[r, c])) for b, a in (("nir", ref), ("red", moved)) for r in range(64) for c in range(64)]
    df = spark.createDataFrame(cells, "raster_id string, band string, row int, col int, value double")
    assert [(r["dy"], r["dx"]) for r in matching.band_register(df).collect()] == [(-5, 3)]
