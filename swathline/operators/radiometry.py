"""Sensor counts to reflectance.  Every step cleans what it is given: nodata stays nodata and is never corrected into a count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathline.functions import constants as K
from swathline.functions.scalars import float_list, lookup, number, positive
from swathline.operators.camera import bilinear_zero, invert3
from swathline.operators.grid import LINE, clean

META = ["sensor_gain", "exposure_time_us", "black_level", "sensor_gain_adjustment", "irradiance",
        "irradiance_exposure", "irradiance_gain", "bit_depth", "centre_x", "centre_y", "vignetting", "dewarp",
        "homography", "width", "height"]


def _vignetting_factor() -> Column:
    cx = F.coalesce("centre_x", F.col("width") / 2.0)
    cy = F.coalesce("centre_y", F.col("height") / 2.0)
    dx, dy = F.col("col") - cx, F.col("row") - cy
    r = F.sqrt(dx * dx + dy * dy)
    k = F.col("vignetting")
    poly = k[5]
    for i in range(4, -1, -1):
        poly = poly * r + k[i]
    return F.when(F.coalesce(F.size(k) >= 6, F.lit(False)), 1.0 + poly * r).otherwise(1.0)


def vignetting(raster: DataFrame, meta: DataFrame) -> DataFrame:
    """Multiply by 1 + k0 r + ... + k5 r^6; images with fewer than six coefficients are left alone."""
    m = meta.select(*LINE, "centre_x", "centre_y", "vignetting", "width", "height")
    return clean(raster).join(m, LINE).select(*LINE, "row", "col", (F.col("value") * _vignetting_factor()).alias("value"))


def undistort(raster: DataFrame, meta: DataFrame, pixels: DataFrame | None = None) -> DataFrame:
    """Lens correction by k1, k2, p1, p2, k3; images with fewer than nine numbers are left alone.

    ``pixels`` names the pixels to make (raster_id, band, row, col), by default those of ``raster``; a chain of
    steps passes its first input so that each step reads the one before once.
    """
    d = F.col("dewarp")
    has = F.coalesce(F.size(d) >= 9, F.lit(False))
    m = meta.select(*LINE, has.alias("moved"), F.get(d, F.lit(0)).alias("fx"), F.get(d, F.lit(1)).alias("fy"),
                    (F.coalesce("centre_x", F.col("width") / 2.0) + F.get(d, F.lit(2))).alias("cx"),
                    (F.coalesce("centre_y", F.col("height") / 2.0) + F.get(d, F.lit(3))).alias("cy"),
                    *[F.get(d, F.lit(4 + i)).alias(n) for i, n in enumerate(("k1", "k2", "p1", "p2", "k3"))])
    px = (raster if pixels is None else pixels).select(*LINE, "row", "col").join(m, LINE)
    px = px.withColumns({"_x": (F.col("col") - F.col("cx")) / F.col("fx"), "_y": (F.col("row") - F.col("cy")) / F.col("fy")})
    x, y = F.col("_x"), F.col("_y")
    px = px.withColumn("_r2", x * x + y * y)
    r2 = F.col("_r2")
    radial = 1 + r2 * (F.col("k1") + r2 * (F.col("k2") + r2 * F.col("k3")))
    xd = x * radial + 2 * F.col("p1") * x * y + F.col("p2") * (r2 + 2 * x * x)
    yd = y * radial + F.col("p1") * (r2 + 2 * y * y) + 2 * F.col("p2") * x * y
    return bilinear_zero(raster, px.select(
        *LINE, "row", "col", "moved",
        F.when(F.col("moved"), xd * F.col("fx") + F.col("cx")).otherwise(F.col("col")).alias("ub"),
        F.when(F.col("moved"), yd * F.col("fy") + F.col("cy")).otherwise(F.col("row")).alias("vb")))


def homography_align(raster: DataFrame, meta: DataFrame, pixels: DataFrame | None = None) -> DataFrame:
    """Perspective warp to the same size; images without nine numbers are left alone."""
    whole = F.when(F.size("homography") == 9, F.col("homography"))
    m = invert3(meta.select(*LINE, whole.alias("_hm")), "_hm", "_h").drop("_hm")
    px = (raster if pixels is None else pixels).select(*LINE, "row", "col").join(m, LINE)
    u, v = F.col("col"), F.col("row")
    px = px.withColumns({"_w": F.nullif(F.col("_h6") * u + F.col("_h7") * v + F.col("_h8"), F.lit(0.0)),
                         "moved": F.col("_h0").isNotNull()})
    far = F.lit(1e8)  # a point at infinity lies outside every image
    ub = F.coalesce((F.col("_h0") * u + F.col("_h1") * v + F.col("_h2")) / F.col("_w"), far)
    vb = F.coalesce((F.col("_h3") * u + F.col("_h4") * v + F.col("_h5")) / F.col("_w"), far)
    return bilinear_zero(raster, px.select(
        *LINE, "row", "col", "moved", F.when(F.col("moved"), ub).otherwise(u.cast("double")).alias("ub"),
        F.when(F.col("moved"), vb).otherwise(v.cast("double")).alias("vb")))


def _signal(value: Column) -> Column:
    full = F.pow(F.lit(2.0), F.col("bit_depth"))
    return (value / full - F.col("black_level") / full) / (F.col("sensor_gain") * F.col("exposure_time_us") / 1e6)


def _reflectance(signal: Column) -> Column:
    irr = F.col("irradiance") / (F.col("irradiance_exposure") * F.col("irradiance_gain") + 1e-10)
    return signal * F.col("sensor_gain_adjustment") / (irr + 1e-10)


def camera_signal(raster: DataFrame, meta: DataFrame) -> DataFrame:
    """Counts per unit of gain and exposure, black level removed."""
    m = meta.select(*LINE, "bit_depth", "black_level", "sensor_gain", "exposure_time_us")
    return clean(raster).join(m, LINE).select(*LINE, "row", "col", _signal(F.col("value")).alias("value"))


def reflectance(raster: DataFrame, meta: DataFrame, clip: bool = True) -> DataFrame:
    """Signal over irradiance (put on the same exposure and gain), clipped to 0..1."""
    m = meta.select(*LINE, "sensor_gain_adjustment", "irradiance", "irradiance_exposure", "irradiance_gain")
    raw = _reflectance(F.col("value"))
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)) if clip else raw
    return clean(raster).join(m, LINE).select(*LINE, "row", "col", F.when(raw.isNotNull(), value).alias("value"))


def calibrate(raster: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calibrated raster, outcome per image).

    Vignetting, lens and perspective corrections, then signal and reflectance.  RGB passes through unchanged;
    an image without usable metadata is reported as failed and gives no pixels.
    """
    raster = clean(raster)
    usable = (F.col("sensor_gain") * F.col("exposure_time_us") > 0) & F.col("irradiance").isNotNull()
    known = meta.withColumn("_ok", F.coalesce(usable, F.lit(False)))
    images = raster.select(*LINE).distinct().join(known.select(*LINE, "_ok"), LINE, "left")
    state = F.when(F.col("band") == "rgb", "calibrated").when(F.col("_ok"), "reflectance").otherwise("failed")
    outcome = images.select(*LINE, state.alias("state"))
    good = known.where((F.col("band") != "rgb") & F.col("_ok")).drop("_ok")
    spectral = raster.join(good.select(*LINE), LINE, "left_semi")
    lens = undistort(vignetting(spectral, good), good, pixels=spectral)
    steps = homography_align(lens, good, pixels=spectral)
    # the last two steps share one lookup of the metadata
    raw = _reflectance(_signal(F.col("value")))
    m = good.select(*LINE, "bit_depth", "black_level", "sensor_gain", "exposure_time_us", "sensor_gain_adjustment",
                    "irradiance", "irradiance_exposure", "irradiance_gain")
    done = steps.join(m, LINE).select(*LINE, "row", "col", F.when(
        raw.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))).alias("value"))
    plain = raster.where(F.col("band") == "rgb").select(*LINE, "row", "col", "value")
    return done.unionByName(plain), outcome


def meta_dji(xmp: DataFrame) -> DataFrame:
    """Typed calibration metadata from DJI property columns (text), with the defaults of missing ones."""
    dewarp = F.split("DewarpData", ";")
    return xmp.withColumns({
        "band_name": F.coalesce("BandName", F.lit("Unknown")),
        "sensor_gain": F.coalesce(number("SensorGain"), F.lit(1.0)),
        "exposure_time_us": F.coalesce(number("ExposureTime"), F.lit(1000.0)),
        "black_level": F.coalesce(number(F.nullif("BlackLevel", F.lit(""))), number("BlackCurrent"), F.lit(3200.0)),
        "sensor_gain_adjustment": F.coalesce(number("SensorGainAdjustment"), F.lit(1.0)),
        "irradiance": F.coalesce(number("Irradiance"), F.lit(1.0)),
        "irradiance_exposure": positive("IrradianceExposureTime", 1.0),
        "irradiance_gain": positive("IrradianceGain", 1.0),
        "bit_depth": F.coalesce(number("BitsPerSample").cast("int"), F.lit(16)),
        "centre_x": number("CalibratedOpticalCenterX"), "centre_y": number("CalibratedOpticalCenterY"),
        "vignetting": float_list("VignettingData"),
        "dewarp": float_list(F.get(dewarp, F.lit(1))),
        "homography": float_list("CalibratedHMatrix"),
        "focal_length": number("CalibratedFocalLength")})


def meta_micasense(xmp: DataFrame) -> DataFrame:
    """Typed calibration metadata from MicaSense property columns (text)."""
    name = F.coalesce("BandName", F.lit("Unknown"))
    centre = float_list("VignettingCenter")
    return xmp.withColumns({
        "band_name": lookup(F.lower(F.trim(name)), K.MICASENSE_NORMAL_NAMES, name),
        "sensor_gain": F.coalesce(number("ISOSpeed"), number("SensorGain"), F.lit(1.0)),
        "exposure_time_us": F.coalesce(number("ExposureTime"), F.lit(0.001)) * 1e6,
        "black_level": F.coalesce(number("BlackLevel"), number("DarkRowValue"), F.lit(0.0)),
        "sensor_gain_adjustment": F.coalesce(number("BandSensitivity"), F.lit(1.0)),
        "irradiance": F.coalesce(number("Irradiance"), F.lit(1.0)),
        "irradiance_exposure": F.lit(1.0), "irradiance_gain": F.lit(1.0),
        "bit_depth": F.coalesce(number("BitsPerSample").cast("int"), F.lit(16)),
        "centre_x": F.get(centre, F.lit(0)), "centre_y": F.get(centre, F.lit(1)),
        "vignetting": float_list("VignettingPolynomial"),
        "dewarp": F.array().cast("array<double>"), "homography": F.array().cast("array<double>"),
        "focal_length": number("FocalLength")})
