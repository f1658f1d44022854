"""Queries over image placement, mosaics, radiometry, geodesy and posed cameras."""

from __future__ import annotations

from pyspark.sql import functions as F

from swathline.functions import constants as K
from swathline.functions.scalars import rounded as r6
from swathline.operators import camera as C
from swathline.operators import composite as M
from swathline.operators import geodesy as G
from swathline.operators import georef as R
from swathline.operators import indices as I
from swathline.operators import neighbours as N
from swathline.operators import radiometry as Q
from swathline.operators.grid import Grid, raster_metadata
from swathline.plans.rasters import SITE, cloud, dsm
from swathline.plans.registry import query
from swathline.plans.views import Tables

# --- placement -------------------------------------------------------------------------------------------------

AGL_SQL = """SELECT *, CASE WHEN a > 0 THEN a ELSE 3e1 END AS agl_m, CASE WHEN focal_px > 0 THEN degrees(2 * atan(width / (2 * focal_px)))
  WHEN focal_mm > 0 AND plane_resolution > 0 THEN degrees(2 * atan(width * (CASE WHEN coalesce(plane_unit, 2) = 2 THEN 254e-1 ELSE 1e1 END
  / plane_resolution) / (2 * focal_mm))) WHEN focal_35mm > 0 THEN degrees(2 * atan(18 / focal_35mm)) WHEN drone_model = 'M3M' THEN 385e-1
  WHEN drone_model = 'P4M' THEN 627e-1 ELSE 65e0 END AS hfov_deg, coalesce(flight_yaw, gimbal_yaw, 0e0) AS yaw_deg FROM (SELECT *, CASE WHEN
  relative_altitude IS NOT NULL THEN abs(relative_altitude) WHEN absolute_altitude IS NOT NULL THEN abs(absolute_altitude) - 18e1
  WHEN exif_altitude_ref = 1 THEN -exif_altitude - 18e1 ELSE exif_altitude - 18e1 END AS a FROM {camera_meta})"""
GT_SQL = f"""SELECT *, lon - width / 2e0 * gt1 - height / 2e0 * gt2 AS gt0, lat - width / 2e0 * gt4 - height / 2e0 * gt5 AS gt3 FROM (SELECT *,
  px * cos(radians(yaw_deg)) AS gt1, -py * sin(radians(yaw_deg)) AS gt2, px * sin(radians(yaw_deg)) AS gt4, -py * cos(radians(yaw_deg)) AS gt5
  FROM (SELECT *, gsd / (111320e0 * cos(radians(lat))) AS px, gsd / 111320e0 AS py FROM (SELECT *, 2 * agl_m * tan(radians(hfov_deg) / 2) / width AS gsd
  FROM ({AGL_SQL}))))"""
GTS = ["gt0", "gt1", "gt2", "gt3", "gt4", "gt5"]


def placed(t: Tables):
    return R.direct_georef(R.agl_hfov_yaw(t.camera_meta, 180.0))


@query("agl_hfov_yaw", f"SELECT capture_id, round(agl_m, 6) AS agl_m, round(hfov_deg, 6) AS hfov_deg, round(yaw_deg, 6) AS yaw_deg FROM ({AGL_SQL})")
def _(t: Tables):
    return R.agl_hfov_yaw(t.camera_meta, 180.0).select("capture_id", *[r6(c).alias(c) for c in ("agl_m", "hfov_deg", "yaw_deg")])


@query("direct_georef", "SELECT capture_id, " + ", ".join(f"round({g} * 1000, 6) + 0 AS {g}" for g in GTS) + f" FROM ({GT_SQL})")
def _(t: Tables):
    return placed(t).select("capture_id", *[r6(F.col(g) * 1000).alias(g) for g in GTS])


@query("footprint", f"""SELECT capture_id, round(list_min(xs) * 1000, 6) AS xmin, round(list_max(xs) * 1000, 6) AS xmax, round(list_min(ys) * 1000, 6) AS ymin,
  round(list_max(ys) * 1000, 6) AS ymax, 5 AS ring_points FROM (SELECT capture_id, [gt0, gt0 + 8 * gt1, gt0 + 8 * gt1 + 6 * gt2, gt0 + 6 * gt2] AS xs,
  [gt3, gt3 + 8 * gt4, gt3 + 8 * gt4 + 6 * gt5, gt3 + 6 * gt5] AS ys FROM ({GT_SQL}))""")
def _(t: Tables):
    return R.footprint(placed(t)).select("capture_id", *[r6(F.col(c) * 1000).alias(c) for c in ("xmin", "xmax", "ymin", "ymax")],
                                         F.size("ring").alias("ring_points"))


@query("raster_metadata", """SELECT raster_id, round(list_min(xs), 6) AS xmin, round(list_max(xs), 6) AS xmax, round(list_min(ys), 6) AS ymin,
  round(list_max(ys), 6) AS ymax, round(abs(gt1), 6) AS pixel_x, round(abs(gt5), 6) AS pixel_y FROM (SELECT *, [gt0, gt0 + 8 * gt1, gt0 + 8 * gt1 + 8 * gt2,
  gt0 + 8 * gt2] AS xs, [gt3, gt3 + 8 * gt4, gt3 + 8 * gt4 + 8 * gt5, gt3 + 8 * gt5] AS ys FROM {scenes})""")
def _(t: Tables):
    m = raster_metadata(t.scenes.withColumn("gt", F.array(*GTS)))
    return m.select("raster_id", *[r6(c).alias(c) for c in ("xmin", "xmax", "ymin", "ymax", "pixel_x", "pixel_y")])


FIELD = Grid("field", 100, 100, 0.0, 0.0, 1.0, 1.0)
WARP_SQL = """SELECT s.raster_id, s.row, s.col, c.band, c.value FROM (SELECT raster_id, row, col, cast(floor((dy * gt1 - dx * gt4) / det) AS INT) AS sr,
  cast(floor((dx * gt5 - dy * gt2) / det) AS INT) AS sc FROM (SELECT *, col + 5e-1 - gt0 AS dx, row + 5e-1 - gt3 AS dy, gt1 * gt5 - gt2 * gt4 AS det
  FROM {scenes} CROSS JOIN (SELECT cast(floor(i / 100) AS INT) AS row, cast(i % 100 AS INT) AS col FROM range(10000) AS t(i)))) s
  JOIN {cells} c ON c.raster_id = s.raster_id AND c.row = sr AND c.col = sc"""


@query("warp_nearest", f"SELECT raster_id, band, row, col, round(value, 6) AS value FROM ({WARP_SQL})")
def _(t: Tables):
    return R.warp_nearest(t.cells, t.scenes, FIELD).withColumn("value", r6("value"))


@query("footprint_overlap", """SELECT a.id AS id_a, b.id AS id_b FROM (SELECT c_custkey AS id, c_custkey * 37 % 1000 + c_acctbal / 1e3 AS x,
  c_custkey * 91 % 1000 AS y FROM {customer}) a JOIN (SELECT s_suppkey AS id, s_suppkey * 53 % 1000 AS x, s_suppkey * 29 % 1000 + s_acctbal / 1e3 AS y
  FROM {supplier}) b ON a.x <= b.x + 45 AND b.x <= a.x + 30 AND a.y <= b.y + 20 AND b.y <= a.y + 25""")
def _(t: Tables):
    a = t.customer.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 37 % 1000 + F.col("c_acctbal") / 1e3).alias("xmin"),
                          (F.col("c_custkey") * 91 % 1000).cast("double").alias("ymin"))
    b = t.supplier.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 53 % 1000).cast("double").alias("xmin"),
                          (F.col("s_suppkey") * 29 % 1000 + F.col("s_acctbal") / 1e3).alias("ymin"))
    a = a.withColumns({"xmax": F.col("xmin") + 30, "ymax": F.col("ymin") + 25})
    b = b.withColumns({"xmax": F.col("xmin") + 45, "ymax": F.col("ymin") + 20})
    return R.footprint_overlap(a, b, 50.0)


@query("terrain_level", "SELECT 'dsm' AS raster_id, round(quantile_cont(value, 5e-1), 6) AS terrain FROM {dsm}")
def _(t: Tables):
    return R.terrain_level(dsm(t)).select("raster_id", r6("terrain").alias("terrain"))


@query("heading_groups", """SELECT flight, heading, count(*) AS images, round(avg(band_mean), 6) AS mean, round(stddev_pop(band_mean), 6) AS std,
  round(stddev_pop(band_mean) / avg(band_mean), 6) AS cv FROM (SELECT *, CASE WHEN yaw < 90 OR yaw >= 270 THEN 'out' ELSE 'back' END AS heading
  FROM {captures}) GROUP BY 1, 2""")
def _(t: Tables):
    g = R.heading_groups(t.captures.select("flight", F.col("yaw").alias("yaw_deg"), F.col("band_mean").alias("mean")))
    return g.select("flight", "heading", "images", *[r6(c).alias(c) for c in ("mean", "std", "cv")])


# --- strips, gains, mosaics --------------------------------------------------------------------------------------

STRIPS_SQL = """WITH b AS (SELECT flight, avg(lat) AS mlat, avg(lon) AS mlon, var_pop(lat) * 111320e0 * 111320e0 AS a, var_pop(lon) * 111320e0 * 111320e0 AS c0,
  covar_pop(lat, lon) * 111320e0 * 111320e0 AS b0, cos(radians(avg(lat))) AS k FROM {captures} GROUP BY flight),
  e AS (SELECT *, (a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b) AS s FROM (SELECT flight, mlat, mlon, k, a, c0 * k * k AS c, b0 * k AS b FROM b)),
  v AS (SELECT *, CASE WHEN abs(b) <= 1e-12 * greatest(a, c) THEN CASE WHEN a < c THEN 1e0 ELSE 0e0 END ELSE b END AS vx,
  CASE WHEN abs(b) <= 1e-12 * greatest(a, c) THEN CASE WHEN a >= c THEN 1e0 ELSE 0e0 END ELSE s - a END AS vy FROM e),
  u AS (SELECT *, CASE WHEN abs(vx) >= abs(vy) THEN sign(vx) ELSE sign(vy) END / sqrt(vx * vx + vy * vy) AS f FROM v),
  p AS (SELECT capture_id, c.flight, ((lat - mlat) * vx + (lon - mlon) * k * vy) * f * 111320e0 AS proj FROM {captures} c JOIN u ON c.flight = u.flight),
  g AS (SELECT *, proj - lag(proj) OVER (PARTITION BY flight ORDER BY proj) AS gap FROM p),
  t AS (SELECT flight, greatest(6 * median(gap), 5e0) AS lim FROM g GROUP BY flight)
  SELECT capture_id, g.flight, cast(sum(CASE WHEN gap > lim THEN 1 ELSE 0 END) OVER (PARTITION BY g.flight ORDER BY proj, capture_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS strip, round(proj, 2) AS proj FROM g JOIN t ON g.flight = t.flight"""


@query("flight_strips", STRIPS_SQL)
def _(t: Tables):
    return M.flight_strips(t.captures).select("capture_id", "flight", "strip", r6("proj", 2).alias("proj"))


MEANS_SQL = """SELECT flight, capture_id AS image_id, true_strip AS strip, band, CASE WHEN (capture_id + k) % 29 = 0 THEN 0e0 ELSE band_mean * k + capture_id % 7 END AS mean
  FROM {captures} CROSS JOIN (VALUES ('red', 1), ('nir', 3)) AS b(band, k)"""


@query("strip_gain", f"""WITH m AS MATERIALIZED ({MEANS_SQL}), g AS (SELECT flight, band, avg(mean) AS g FROM m WHERE mean > 0 GROUP BY 1, 2),
  l AS (SELECT m.flight, image_id, any_value(strip) AS strip, avg(mean / g) AS lum FROM m JOIN g ON m.flight = g.flight AND m.band = g.band WHERE mean > 0 GROUP BY 1, 2),
  s AS (SELECT flight, strip, avg(lum) AS sm FROM l GROUP BY 1, 2), t AS (SELECT flight, median(sm) AS target FROM s GROUP BY 1),
  n AS (SELECT flight, count(DISTINCT strip) AS strips, count(DISTINCT image_id) AS images FROM m GROUP BY 1)
  SELECT DISTINCT m.flight, m.image_id, m.strip, round(CASE WHEN strips >= 2 AND images >= 2 AND sm > 0 THEN target / sm ELSE 1e0 END, 6) AS gain FROM m
  JOIN n ON m.flight = n.flight LEFT JOIN s ON m.flight = s.flight AND m.strip = s.strip LEFT JOIN t ON m.flight = t.flight""")
def _(t: Tables):
    k = F.explode(F.array(F.struct(F.lit("red").alias("band"), F.lit(1).alias("k")), F.struct(F.lit("nir").alias("band"), F.lit(3).alias("k"))))
    m = t.captures.withColumn("b", k).select(
        "flight", F.col("capture_id").alias("image_id"), "b.band",
        F.when((F.col("capture_id") + F.col("b.k")) % 29 == 0, 0.0).otherwise(F.col("band_mean") * F.col("b.k") + F.col("capture_id") % 7).alias("mean"))
    s = t.captures.select("flight", F.col("capture_id").alias("image_id"), F.col("true_strip").alias("strip"))
    return M.strip_gain(m, s).withColumn("gain", r6("gain"))


WEIGHT_SQL = """SELECT a.raster_id, a.band, a.row, a.col, a.capture, a.value, least(
  coalesce(min(a.col - b.col) FILTER (b.row = a.row AND b.col < a.col), a.col + 1), coalesce(min(b.col - a.col) FILTER (b.row = a.row AND b.col > a.col), 8 - a.col),
  coalesce(min(a.row - b.row) FILTER (b.col = a.col AND b.row < a.row), a.row + 1), coalesce(min(b.row - a.row) FILTER (b.col = a.col AND b.row > a.row), 8 - a.row)) AS w
  FROM {cells} a LEFT JOIN (SELECT * FROM {cells} WHERE value IS NULL) b ON a.raster_id = b.raster_id AND a.band = b.band AND (a.row = b.row OR a.col = b.col)
  WHERE a.value IS NOT NULL GROUP BY a.raster_id, a.band, a.row, a.col, a.capture, a.value"""


@query("feather_composite", f"""SELECT band, row, col, round(sum(value * (1 + (capture % 5) / 1e1) * w) / sum(w), 6) AS value FROM ({WEIGHT_SQL})
  WHERE (row * 8 + col) % 5 <> 0 GROUP BY 1, 2, 3""")
def _(t: Tables):
    gains = t.cells.select("raster_id", "capture").distinct().select("raster_id", (1 + F.col("capture") % 5 / 10.0).alias("gain"))
    mask = t.cells.select("row", "col").distinct().where((F.col("row") * 8 + F.col("col")) % 5 != 0)
    return M.feather_composite(t.cells.drop("capture"), gains, mask).withColumn("value", r6("value"))


@query("median_composite", "SELECT band, row, col, round(quantile_cont(value, 5e-1), 6) AS value FROM {cells} WHERE value IS NOT NULL GROUP BY 1, 2, 3")
def _(t: Tables):
    return M.median_composite(t.cells).withColumn("value", r6("value"))


MOSAIC_RATIO = "(nir - red) / CASE WHEN nir + red = 0 THEN 1e-10 ELSE nir + red END"


@query("mosaic_ndvi", f"""WITH warp AS MATERIALIZED ({WARP_SQL}), v AS (SELECT * FROM warp WHERE value IS NOT NULL),
  w AS (SELECT *, row_number() OVER (PARTITION BY raster_id, band, row ORDER BY col) AS h, row_number() OVER (PARTITION BY raster_id, band, col ORDER BY row) AS k FROM v),
  r AS (SELECT *, row_number() OVER (PARTITION BY raster_id, band, row, col - h ORDER BY col) AS a, row_number() OVER (PARTITION BY raster_id, band, row, col - h ORDER BY col DESC) AS b,
  row_number() OVER (PARTITION BY raster_id, band, col, row - k ORDER BY row) AS c, row_number() OVER (PARTITION BY raster_id, band, col, row - k ORDER BY row DESC) AS d FROM w),
  m AS (SELECT row, col, sum(value * least(a, b, c, d)) FILTER (band = 'nir') / sum(least(a, b, c, d)) FILTER (band = 'nir') AS nir,
  sum(value * least(a, b, c, d)) FILTER (band = 'red') / sum(least(a, b, c, d)) FILTER (band = 'red') AS red FROM r GROUP BY 1, 2)
  SELECT row, col, round(greatest(-1e0, least(1e0, {MOSAIC_RATIO})), 6) + 0 AS ndvi FROM m WHERE nir IS NOT NULL AND red IS NOT NULL""")
def _(t: Tables):
    warped = R.warp_nearest(t.cells.where("band IN ('red', 'nir')"), t.scenes, FIELD)
    gains = t.scenes.select("raster_id", F.lit(1.0).alias("gain"))
    mosaic = M.feather_composite(warped, gains).withColumn("raster_id", F.lit("mosaic"))
    return I.normalised_difference(mosaic, "ndvi").where("value IS NOT NULL").select("row", "col", r6("value").alias("ndvi"))


# --- radiometry --------------------------------------------------------------------------------------------------

VIG = [1e-3, 2e-4, -1e-5, 3e-6, 1e-7, -1e-8]
LENS = [12.0, 11.5, 0.1, -0.2, 0.05, -0.01, 0.002, -0.001, 0.003]
WARP = [1.01, 0.02, 0.3, -0.015, 0.99, -0.2, 0.001, 0.0005, 1.0]


def sensor_meta(t: Tables):
    def when(cond: str, values: list[float]):
        return F.when(F.expr(cond), F.array(*[F.lit(v) for v in values])).otherwise(F.array().cast("array<double>"))
    return t.sensor_meta.withColumns({"vignetting": when("capture % 5 <> 0", VIG), "dewarp": when("capture % 3 <> 0", LENS),
                                      "homography": when("capture % 4 <> 0", WARP)})


COUNT_COLS = ["raster_id", "band", "row", "col", "value"]
JOIN_META = "JOIN {sensor_meta} m ON p.raster_id = m.raster_id AND p.band = m.band"


def vignetting_sql(src: str) -> str:
    r = "sqrt((p.col - coalesce(centre_x, width / 2e0)) ** 2 + (p.row - coalesce(centre_y, height / 2e0)) ** 2)"
    poly = " + ".join(f"({k!r}) * ({r}) ** {i + 1}" for i, k in enumerate(VIG))
    return (f"SELECT p.raster_id, p.band, p.row, p.col, p.value * CASE WHEN m.capture % 5 <> 0 THEN 1 + {poly} ELSE 1 END AS value "
            f"FROM {src} p {JOIN_META}")


def resample_sql(src: str, cond: str, ub: str, vb: str) -> str:
    return f"""SELECT raster_id, band, row, col, CASE WHEN moved THEN coalesce(v, 0) ELSE own END AS value FROM (SELECT q.raster_id, q.band, q.row, q.col, any_value(moved) AS moved,
      any_value(own) AS own, sum(s.value * (1 - abs(ub - s.col)) * (1 - abs(vb - s.row))) AS v FROM (SELECT p.raster_id, p.band, p.row, p.col, p.value AS own, {cond} AS moved,
      {ub} AS ub, {vb} AS vb FROM {src} p {JOIN_META}) q LEFT JOIN {src} s ON s.raster_id = q.raster_id AND s.band = q.band AND abs(ub - s.col) < 1 AND abs(vb - s.row) < 1
      GROUP BY 1, 2, 3, 4)"""


def undistort_sql(src: str) -> str:
    fx, fy, ox, oy, k1, k2, p1, p2, k3 = LENS
    cx, cy = f"(coalesce(centre_x, width / 2e0) + ({ox!r}))", f"(coalesce(centre_y, height / 2e0) + ({oy!r}))"
    x, y = f"((p.col - {cx}) / {fx!r})", f"((p.row - {cy}) / {fy!r})"
    r2 = f"({x} * {x} + {y} * {y})"
    rad = f"(1 + {k1!r} * {r2} + ({k2!r}) * {r2} ** 2 + {k3!r} * {r2} ** 3)"
    ub = f"({x} * {rad} + 2 * {p1!r} * {x} * {y} + ({p2!r}) * ({r2} + 2 * {x} * {x})) * {fx!r} + {cx}"
    vb = f"({y} * {rad} + {p1!r} * ({r2} + 2 * {y} * {y}) + 2 * ({p2!r}) * {x} * {y}) * {fy!r} + {cy}"
    return resample_sql(src, "m.capture % 3 <> 0", ub, vb)


def homography_sql(src: str) -> str:
    import numpy as np
    h = np.linalg.inv(np.array(WARP).reshape(3, 3)).ravel().tolist()
    w = f"(({h[6]!r}) * p.col + ({h[7]!r}) * p.row + ({h[8]!r}))"
    return resample_sql(src, "m.capture % 4 <> 0", f"(({h[0]!r}) * p.col + ({h[1]!r}) * p.row + ({h[2]!r})) / {w}",
                        f"(({h[3]!r}) * p.col + ({h[4]!r}) * p.row + ({h[5]!r})) / {w}")


def signal_sql(src: str) -> str:
    return ("SELECT p.raster_id, p.band, p.row, p.col, (p.value / 2 ** bit_depth - black_level / 2 ** bit_depth) / (sensor_gain * exposure_time_us / 1e6) AS value "
            f"FROM {src} p {JOIN_META}")


def reflectance_sql(src: str) -> str:
    return ("SELECT p.raster_id, p.band, p.row, p.col, CASE WHEN irradiance IS NOT NULL THEN greatest(0e0, least(1e0, p.value * sensor_gain_adjustment / (irradiance / "
            f"(irradiance_exposure * irradiance_gain + 1e-10) + 1e-10))) END AS value FROM {src} p {JOIN_META}")


def out6(sql: str) -> str:
    return f"SELECT raster_id, band, row, col, round(value, 6) + 0 AS value FROM ({sql})"


def out3(sql: str) -> str:
    """Counts: fewer places, and off the ties that whole counts times short coefficients fall on."""
    return f"SELECT raster_id, band, row, col, round(value + 137e-7, 3) AS value FROM ({sql})"


def r3(df):
    return df.withColumn("value", r6(F.col("value") + F.lit(137e-7), 3))


def counts(t: Tables):
    return t.counts.select(*COUNT_COLS)


@query("vignetting", out3(vignetting_sql("{counts}")))
def _(t: Tables):
    return r3(Q.vignetting(counts(t), sensor_meta(t)))


@query("undistort", out3(undistort_sql("{counts}")))
def _(t: Tables):
    return r3(Q.undistort(counts(t), sensor_meta(t)))


@query("homography_align", out3(homography_sql("{counts}")))
def _(t: Tables):
    return r3(Q.homography_align(counts(t), sensor_meta(t)))


@query("camera_signal", out6(signal_sql("{counts}")))
def _(t: Tables):
    return Q.camera_signal(counts(t), sensor_meta(t)).withColumn("value", r6("value"))


@query("reflectance", out6(reflectance_sql("(SELECT raster_id, band, row, col, value / 20 - 300 AS value FROM {counts})")))
def _(t: Tables):
    r = counts(t).withColumn("value", F.col("value") / 20 - 300)
    return Q.reflectance(r, sensor_meta(t)).withColumn("value", r6("value"))


@query("calibrate", f"""WITH a AS MATERIALIZED ({vignetting_sql('{counts}')}), b AS MATERIALIZED ({undistort_sql('a')}), c AS MATERIALIZED ({homography_sql('b')}),
  d AS ({signal_sql('c')}), e AS ({reflectance_sql('d')}) SELECT e.raster_id, e.band, row, col, round(value, 6) + 0 AS value FROM e WHERE value IS NOT NULL""")
def _(t: Tables):
    return Q.calibrate(counts(t), sensor_meta(t))[0].withColumn("value", r6("value"))


@query("calibrate_outcome", """SELECT raster_id, band, CASE WHEN band = 'rgb' THEN 'calibrated' WHEN irradiance IS NOT NULL THEN 'reflectance' ELSE 'failed' END AS state
  FROM (SELECT raster_id, CASE WHEN band = 'red_edge' THEN 'rgb' ELSE band END AS band, irradiance FROM {sensor_meta})""")
def _(t: Tables):
    name = F.when(F.col("band") == "red_edge", "rgb").otherwise(F.col("band"))
    return Q.calibrate(counts(t).withColumn("band", name), sensor_meta(t).withColumn("band", name))[1]


PROPS_SQL = """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'Red edge' END AS BandName, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'x' ELSE cast(o_orderkey % 9 AS STRING) END AS SensorGain,
  CASE WHEN o_orderkey % 3 = 0 THEN '0.002' END AS ExposureTime, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '4096' END AS BlackLevel, CASE WHEN o_orderkey % 2 = 0 THEN '2800' END AS BlackCurrent,
  '1.5' AS SensorGainAdjustment, CASE WHEN o_orderkey % 7 <> 0 THEN cast(o_orderkey % 1000 AS STRING) END AS Irradiance, CASE o_orderkey % 3 WHEN 0 THEN '-1' WHEN 1 THEN '0.5' END AS IrradianceExposureTime,
  CASE WHEN o_orderkey % 11 = 0 THEN '2' END AS IrradianceGain, CASE WHEN o_orderkey % 2 = 0 THEN '12' END AS BitsPerSample, '4.5' AS CalibratedOpticalCenterX,
  cast(NULL AS STRING) AS CalibratedOpticalCenterY, CASE o_orderkey % 3 WHEN 0 THEN '1,2, 3,4,5,6' WHEN 1 THEN '1,a' END AS VignettingData, CASE WHEN o_orderkey % 2 = 0 THEN '2022-06-01;1,2,3,4,5,6,7,8,9' ELSE 'none' END AS DewarpData,
  '1,0,0,0,1,0,0,0,1' AS CalibratedHMatrix, '3713.29' AS CalibratedFocalLength, CASE WHEN o_orderkey % 6 = 0 THEN '400' END AS ISOSpeed, '51' AS DarkRowValue, '0.8' AS BandSensitivity,
  '0.1 0.2 0.3 0.4 0.5 0.6' AS VignettingPolynomial, CASE WHEN o_orderkey % 2 = 0 THEN '640.5, 480.25' END AS VignettingCenter, '5.5' AS FocalLength FROM {orders}"""


def props(t: Tables):
    return t.spark.sql(PROPS_SQL, orders=t.orders)


META_OUT = ["sensor_gain", "exposure_time_us", "black_level", "sensor_gain_adjustment", "irradiance", "irradiance_exposure", "irradiance_gain", "bit_depth", "centre_x", "centre_y"]


@query("meta_dji", f"""SELECT k, coalesce(BandName, 'Unknown') AS band_name, coalesce(TRY_CAST(SensorGain AS DOUBLE), 1) AS sensor_gain, coalesce(TRY_CAST(ExposureTime AS DOUBLE), 1000) AS exposure_time_us,
  coalesce(TRY_CAST(nullif(BlackLevel, '') AS DOUBLE), TRY_CAST(BlackCurrent AS DOUBLE), 3200) AS black_level, 15e-1 AS sensor_gain_adjustment, coalesce(TRY_CAST(Irradiance AS DOUBLE), 1) AS irradiance,
  CASE WHEN IrradianceExposureTime = '0.5' THEN 5e-1 ELSE 1e0 END AS irradiance_exposure, CASE WHEN IrradianceGain = '2' THEN 2e0 ELSE 1e0 END AS irradiance_gain,
  CASE WHEN BitsPerSample = '12' THEN 12 ELSE 16 END AS bit_depth, 45e-1 AS centre_x, cast(NULL AS DOUBLE) AS centre_y, CASE WHEN k % 3 = 0 THEN 6 ELSE 0 END AS n_vignetting,
  CASE WHEN k % 2 = 0 THEN 9 ELSE 0 END AS n_dewarp, 9 AS n_homography, 371329e-2 AS focal_length FROM ({PROPS_SQL})""")
def _(t: Tables):
    m = Q.meta_dji(props(t))
    return m.select("k", "band_name", *META_OUT, F.size("vignetting").alias("n_vignetting"), F.size("dewarp").alias("n_dewarp"),
                    F.size("homography").alias("n_homography"), "focal_length")


@query("meta_micasense", f"""SELECT k, CASE WHEN BandName IS NULL THEN 'Unknown' ELSE 'RedEdge' END AS band_name, coalesce(TRY_CAST(ISOSpeed AS DOUBLE), TRY_CAST(SensorGain AS DOUBLE), 1) AS sensor_gain,
  coalesce(TRY_CAST(ExposureTime AS DOUBLE), 1e-3) * 1e6 AS exposure_time_us, coalesce(TRY_CAST(nullif(BlackLevel, '') AS DOUBLE), 51e0) AS black_level, 8e-1 AS sensor_gain_adjustment,
  coalesce(TRY_CAST(Irradiance AS DOUBLE), 1) AS irradiance, 1e0 AS irradiance_exposure, 1e0 AS irradiance_gain, CASE WHEN BitsPerSample = '12' THEN 12 ELSE 16 END AS bit_depth,
  CASE WHEN k % 2 = 0 THEN 6405e-1 END AS centre_x, CASE WHEN k % 2 = 0 THEN 48025e-2 END AS centre_y, 6 AS n_vignetting, 55e-1 AS focal_length FROM ({PROPS_SQL})""")
def _(t: Tables):
    m = Q.meta_micasense(props(t))
    return m.select("k", "band_name", *META_OUT, F.size("vignetting").alias("n_vignetting"), "focal_length")


# --- geodesy -----------------------------------------------------------------------------------------------------

ECEF_SQL = """SELECT *, (n + alt) * cos(radians(lat)) * cos(radians(lon)) AS ex, (n + alt) * cos(radians(lat)) * sin(radians(lon)) AS ey,
  ((1 - 0.00669437999014e0) * n + alt) * sin(radians(lat)) AS ez FROM (SELECT capture_id, flight, lat, lon, alt, 6378137e0 / sqrt(1 - 0.00669437999014e0 * sin(radians(lat)) ** 2) AS n FROM {captures})"""


def series(coefs, trig: str, hyp: str, x: str, y: str) -> str:
    return " + ".join(f"({c!r}) * {trig}({2 * j} * {x}) * {hyp}({2 * j} * {y})" for j, c in enumerate(coefs, 1))


K0A = repr(G.SCALE0 * G.RADIUS)
UTM_SQL = f"""SELECT *, 500000e0 + {K0A} * (eta + {series(G.FORWARD, 'cos', 'sinh', 'xi', 'eta')}) AS east,
  {K0A} * (xi + {series(G.FORWARD, 'sin', 'cosh', 'xi', 'eta')}) AS north FROM (SELECT *, atan2(tt, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + tt * tt)) AS eta
  FROM (SELECT *, sinh(atanh(sin(radians(lat))) - {G.ECC!r} * atanh({G.ECC!r} * sin(radians(lat)))) AS tt, radians(lon + 3) AS dl FROM {{captures}}))"""


def gps(t: Tables):
    return t.captures.select("capture_id", "flight", "lat", "lon", "alt")


@query("gps_to_ecef", f"SELECT capture_id, round(ex, 2) AS ex, round(ey, 2) AS ey, round(ez, 2) AS ez FROM ({ECEF_SQL})")
def _(t: Tables):
    return G.gps_to_ecef(gps(t)).select("capture_id", *[r6(c, 2).alias(c) for c in ("ex", "ey", "ez")])


@query("utm_epsg", "SELECT capture_id, cast(CASE WHEN lat - 41 >= 3e-4 THEN 32600 ELSE 32700 END + floor((lon * 50 + 180) / 6) + 1 AS INT) AS epsg FROM {captures}")
def _(t: Tables):
    moved = gps(t).withColumns({"lat": F.col("lat") - 41 - 3e-4, "lon": F.col("lon") * 50})
    return G.utm_epsg(moved).select("capture_id", "epsg")


@query("gps_centroid", "SELECT flight, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, 32630 AS epsg FROM {captures} GROUP BY flight")
def _(t: Tables):
    return G.gps_centroid(gps(t), ["flight"]).select("flight", r6("lat").alias("lat"), r6("lon").alias("lon"), "epsg")


@query("ecef_to_utm", f"SELECT capture_id, round(east, 2) AS east, round(north, 2) AS north, round(alt, 2) AS height FROM ({UTM_SQL})")
def _(t: Tables):
    e = G.gps_to_ecef(gps(t)).select("capture_id", "ex", "ey", "ez")
    return G.ecef_to_utm(e, 32630).select("capture_id", *[r6(c, 2).alias(c) for c in ("east", "north", "height")])


@query("utm_to_ecef", f"SELECT capture_id, round(ex, 2) AS ex, round(ey, 2) AS ey, round(ez, 2) AS ez FROM ({ECEF_SQL})")
def _(t: Tables):
    u = G.gps_to_utm(gps(t), 32630).select("capture_id", "east", "north", F.col("alt").alias("height"))
    return G.utm_to_ecef(u, 32630).select("capture_id", *[r6(c, 2).alias(c) for c in ("ex", "ey", "ez")])


@query("point_reproject", f"SELECT capture_id, round(east, 2) AS x, round(north, 2) AS y, round(alt, 2) AS z FROM ({UTM_SQL})")
def _(t: Tables):
    e = G.gps_to_ecef(gps(t)).select("capture_id", F.col("ex").alias("x"), F.col("ey").alias("y"), F.col("ez").alias("z"))
    return G.point_reproject(e, 32630).select("capture_id", *[r6(c, 2).alias(c) for c in "xyz"])


ROT_SQL = """SELECT *, 1 - 2 * qz * qz AS r00, -2 * qw * qz AS r01, 0e0 AS r02, 2 * qw * qz AS r10, 1 - 2 * qz * qz AS r11, 0e0 AS r12, 0e0 AS r20, 0e0 AS r21, 1e0 AS r22 FROM {poses}"""
ROTS = [f"r{i}{j}" for i in range(3) for j in range(3)]


@query("quat_to_rot", "SELECT image_id, " + ", ".join(f"round({r}, 6) + 0 AS {r}" for r in ROTS) + f" FROM ({ROT_SQL})")
def _(t: Tables):
    return G.quat_to_rot(t.poses).select("image_id", *[r6(r).alias(r) for r in ROTS])


@query("camera_centre", f"SELECT image_id, round(-(r00 * tx + r10 * ty), 6) + 0 AS cx, round(-(r01 * tx + r11 * ty), 6) + 0 AS cy, round(-tz, 6) + 0 AS cz FROM ({ROT_SQL})")
def _(t: Tables):
    return G.camera_centre(t.poses).select("image_id", *[r6(c).alias(c) for c in ("cx", "cy", "cz")])


SIM = G.Sim3(1.25, (0.9, 0.1, -0.3, 0.3), (4.8e6, -3.1e5, 4.1e6))
assert abs(sum(v * v for v in SIM.q) - 1.0) < 1e-12
RS = SIM.rotation


@query("sim3_apply", "SELECT image_id, " + ", ".join(
    f"round({SIM.scale!r} * (({RS[i][0]!r}) * tx + ({RS[i][1]!r}) * ty + ({RS[i][2]!r}) * tz) + ({SIM.t[i]!r}) + 137e-7, 3) AS {n}" for i, n in enumerate(("ex", "ey", "ez"))) + " FROM {poses}")
def _(t: Tables):
    return G.sim3_apply(t.poses, SIM, source=("tx", "ty", "tz")).select("image_id", *[r6(F.col(c) + F.lit(137e-7), 3).alias(c) for c in ("ex", "ey", "ez")])


INV_SQL = "SELECT capture_id, " + ", ".join(
    f"round((({RS[0][i]!r}) * (ex - ({SIM.t[0]!r})) + ({RS[1][i]!r}) * (ey - ({SIM.t[1]!r})) + ({RS[2][i]!r}) * (ez - ({SIM.t[2]!r}))) / {SIM.scale!r}, 2) AS {n}"
    for i, n in enumerate("xyz")) + f" FROM ({ECEF_SQL})"


@query("sim3_invert", INV_SQL)
def _(t: Tables):
    return G.sim3_invert(G.gps_to_ecef(gps(t)), SIM).select("capture_id", *[r6(c, 2).alias(c) for c in "xyz"])


@query("sim3_fit", """SELECT count(*) AS cameras, count(*) FILTER (capture_id % 40 <> 0) AS inliers, 1.25e0 AS scale, 9e-1 AS qw, 1e-1 AS qx, -3e-1 AS qy, 3e-1 AS qz,
  true AS scale_warning, false AS rmse_warning FROM {captures}""")
def _(t: Tables):
    e = G.gps_to_ecef(gps(t)).withColumn("name", F.col("capture_id"))
    local = G.sim3_invert(e, SIM).select("name", (F.col("x") + F.when(F.col("name") % 40 == 0, 80.0).otherwise(0.0)).alias("x"), "y", "z")
    sim, rep = G.sim3_fit(local, e)
    row = (rep["cameras"], rep["inliers"], round(sim.scale, 4), *[round(v, 4) for v in sim.q], rep["scale_warning"], rep["rmse_warning"])
    return t.spark.createDataFrame([row], "cameras long, inliers long, scale double, qw double, qx double, qy double, qz double, scale_warning boolean, rmse_warning boolean")


@query("outlier_cameras", """SELECT capture_id AS name, CASE WHEN capture_id % 10 <> 0 THEN round((capture_id % 25) * 1e0, 3) END AS error,
  coalesce(capture_id % 10 <> 0 AND capture_id % 25 > 10, false) AS removed FROM {captures}""")
def _(t: Tables):
    e = G.gps_to_ecef(gps(t))
    poses = e.select(F.col("capture_id").alias("name"), (F.col("ex") + F.col("capture_id") % 25 + F.when(F.col("capture_id") % 25 == 10, -1e-6).otherwise(0.0)).alias("cx"),
                     F.col("ey").alias("cy"), F.col("ez").alias("cz"))
    ref = gps(t).where("capture_id % 10 <> 0").withColumnRenamed("capture_id", "name")
    return G.outlier_cameras(poses, ref).select("name", r6("error", 3).alias("error"), "removed")


# --- posed cameras -----------------------------------------------------------------------------------------------

CAM = C.Camera(8, 8, 10.0, 11.0, 3.9, 4.1, (0.02, -0.01, 0.001, -0.002, 0.003, 0.0, 0.0, 0.0))


def coarse(t: Tables):
    return t.coarse.select("row", "col", (F.col("col") * 4.0 + 2).alias("x"), (F.col("row") * 4.0 + 2).alias("y"), "z")


def site_poses(t: Tables):
    return t.site_poses.select("image_id", "qw", "qx", "qy", "qz", "tx", "ty", "tz")


RAD = "(1 + r2 * (0.02e0 + r2 * (-0.01e0 + r2 * 0.003e0)))"
PROJ_SQL = f"""SELECT *, 10 * (xn * {RAD} + 2 * 0.001e0 * xn * yn + (-0.002e0) * (r2 + 2 * xn * xn)) + 3.9e0 AS u,
  11 * (yn * {RAD} + 0.001e0 * (r2 + 2 * yn * yn) + 2 * (-0.002e0) * xn * yn) + 4.1e0 AS v FROM (SELECT *, xn * xn + yn * yn AS r2 FROM (SELECT row, col, image_id,
  (r00 * x + r01 * y + tx) / (tz - z) AS xn, (r01 * x + r11 * y + ty) / (tz - z) AS yn FROM (SELECT row, col, col * 4e0 + 2 AS x, row * 4e0 + 2 AS y, z FROM {{coarse}})
  CROSS JOIN {{site_poses}} WHERE tz - z > 1e-6))"""
SEEN_SQL = f"SELECT * FROM ({PROJ_SQL}) WHERE u >= 0 AND u < 8 AND v >= 0 AND v < 8"


@query("project_join", f"SELECT row, col, image_id, round(u, 6) AS u, round(v, 6) AS v FROM ({SEEN_SQL})")
def _(t: Tables):
    return C.project_join(coarse(t), site_poses(t), CAM, tile=8).select("row", "col", "image_id", r6("u").alias("u"), r6("v").alias("v"))


@query("project_pinhole", f"""SELECT row, col, round(u, 6) AS u, round(v, 6) AS v FROM ({PROJ_SQL}) JOIN (SELECT count(*) AS n FROM {{supplier}}) ON image_id = (row * 50 + col) % n""")
def _(t: Tables):
    n = t.supplier.agg(F.count("*").alias("n")).withColumn("_k", F.lit(0))
    cells = coarse(t).withColumn("_k", F.lit(0)).join(F.broadcast(n), "_k").withColumn("image_id", (F.col("row") * 50 + F.col("col")) % F.col("n"))
    pairs = cells.join(G.quat_to_rot(site_poses(t)), "image_id")
    return C.project_pinhole(pairs, CAM).where("in_front").select("row", "col", r6("u").alias("u"), r6("v").alias("v"))


HMAT = [1.02, 0.01, 0.1, -0.02, 0.98, 0.05, 0.0001, 0.0002, 1.0]


def band_geometry(t: Tables):
    n = t.cells.agg((F.max("capture") + 1).alias("n")).withColumn("_k", F.lit(0))
    base = t.site_poses.select("image_id").withColumn("_k", F.lit(0)).join(F.broadcast(n), "_k")
    bands = F.explode(F.array(F.struct(F.lit("red").alias("band"), F.lit(0.25).alias("ox")), F.struct(F.lit("nir").alias("band"), F.lit(0.0).alias("ox"))))
    return base.withColumn("b", bands).select(
        "image_id", F.concat(F.lit("c"), (F.col("image_id") % F.col("n")).cast("string")).alias("raster_id"), "b.band",
        F.array(*[F.lit(h) for h in HMAT]).alias("h"), F.col("b.ox").alias("off_x"), F.lit(-0.125).alias("off_y"))


def _hinv():
    import numpy as np
    return np.linalg.inv(np.array(HMAT).reshape(3, 3)).ravel().tolist()


HI = _hinv()
BAND_SQL = f"""SELECT row, col, image_id, u, v, band, concat('c', cast(image_id % n AS STRING)) AS raster_id, (({HI[0]!r}) * u + ({HI[1]!r}) * v + ({HI[2]!r})) / (({HI[6]!r}) * u + ({HI[7]!r}) * v + ({HI[8]!r})) - ox AS ub,
  (({HI[3]!r}) * u + ({HI[4]!r}) * v + ({HI[5]!r})) / (({HI[6]!r}) * u + ({HI[7]!r}) * v + ({HI[8]!r})) + 125e-3 AS vb FROM ({SEEN_SQL}) CROSS JOIN (VALUES ('red', 25e-2), ('nir', 0e0)) AS b(band, ox)
  CROSS JOIN (SELECT max(capture) + 1 AS n FROM {{cells}})"""


def seen_bands(t: Tables):
    return C.band_pixel(C.project_join(coarse(t), site_poses(t), CAM, tile=8).select("row", "col", "image_id", "u", "v"), band_geometry(t))


@query("band_pixel", f"SELECT row, col, image_id, band, round(ub, 6) AS ub, round(vb, 6) AS vb FROM ({BAND_SQL})")
def _(t: Tables):
    return seen_bands(t).select("row", "col", "image_id", "band", r6("ub").alias("ub"), r6("vb").alias("vb"))


SAMPLE_SQL = f"""SELECT s.row, s.col, s.image_id, s.band, s.u, s.v, sum(c.value * (1 - abs(ub - c.col)) * (1 - abs(vb - c.row))) AS value FROM ({BAND_SQL}) s JOIN {{cells0}} c
  ON c.raster_id = s.raster_id AND c.band = s.band AND c.col IN (cast(floor(ub) AS INT), cast(floor(ub) AS INT) + 1) AND c.row IN (cast(floor(vb) AS INT), cast(floor(vb) AS INT) + 1)
  WHERE ub >= 0 AND floor(ub) < 7 AND vb >= 0 AND floor(vb) < 7 GROUP BY ALL"""
ZEROED = "(SELECT raster_id, band, row, col, coalesce(value, 0) AS value FROM {cells})"


@query("bilinear_gather", f"SELECT row, col, image_id, band, round(value, 6) AS value FROM ({SAMPLE_SQL.replace('{cells0}', '{cells}')} HAVING count(value) = 4)")
def _(t: Tables):
    return C.bilinear_gather(t.cells, seen_bands(t)).select("row", "col", "image_id", "band", r6("value").alias("value"))


@query("pose_composite", f"""SELECT band, row, col, round(sum(value * w) / sum(w), 6) AS value FROM (SELECT band, row, col, value, greatest(greatest(0e0, least(1e0, least(least(u, 7 - u) / 4e0,
  least(v, 7 - v) / 4e0) / 3e-1)), 1e-3) AS w FROM ({SAMPLE_SQL.replace('{cells0}', ZEROED)}) WHERE value <> 0) GROUP BY 1, 2, 3""")
def _(t: Tables):
    return C.pose_composite(coarse(t), site_poses(t), CAM, t.cells.drop("capture"), band_geometry(t)).withColumn("value", r6("value"))


BLOCK = Grid("utm", 50, 50, 440000.0, 4540000.0, 4.0, -4.0, epsg=32630)
BACK_SQL = f"""SELECT row, col, z AS alt, -3 + degrees(atan2(sinh(eta), cos(xi))) AS lon, degrees(chi + {' + '.join(f'({d!r}) * sin({2 * j} * chi)' for j, d in enumerate(G.LATITUDE, 1))}) AS lat
  FROM (SELECT *, asin(sin(xi) / cosh(eta)) AS chi FROM (SELECT *, x0 - ({series(G.BACK, 'sin', 'cosh', 'x0', 'y0')}) AS xi, y0 - ({series(G.BACK, 'cos', 'sinh', 'x0', 'y0')}) AS eta
  FROM (SELECT row, col, z, (4540000 - (row + 5e-1) * 4) / {K0A} AS x0, (440000 + (col + 5e-1) * 4 - 500000) / {K0A} AS y0 FROM {{coarse}})))"""
LOCAL_SQL = INV_SQL.replace("capture_id, ", "row, col, ", 1).replace("SELECT capture_id, flight, lat", "SELECT row, col, lat").replace("FROM {captures}", f"FROM ({BACK_SQL})")


@query("cells_to_local", LOCAL_SQL)
def _(t: Tables):
    return C.cells_to_local(t.coarse, BLOCK, SIM).select("row", "col", *[r6(c, 2).alias(c) for c in "xyz"])


@query("trajectory_stats", """WITH p AS (SELECT scene, row_number() OVER (PARTITION BY scene ORDER BY ordinal) AS k, tx AS x, ty AS y, tz AS z FROM {poses}),
  b AS (SELECT scene, count(*) AS cameras, round((min(x) + max(x)) / 2, 6) AS centre_x, round((min(y) + max(y)) / 2, 6) AS centre_y, round((min(z) + max(z)) / 2, 6) AS centre_z,
  round(greatest(max(x), max(y), max(z)) - least(min(x), min(y), min(z)), 6) AS extent FROM p GROUP BY scene),
  s AS (SELECT a.scene, round(avg(d), 6) AS mean_step, round(sum(d), 4) AS path_length FROM (SELECT a.scene, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d
  FROM p a JOIN p b ON a.scene = b.scene AND a.k = b.k + 1) a GROUP BY 1) SELECT b.*, mean_step, path_length FROM b LEFT JOIN s ON b.scene = s.scene""")
def _(t: Tables):
    from swathline.functions.ranking import bucketed_row_number
    n = bucketed_row_number(t.poses.withColumnRenamed("ordinal", "o"), ["scene"], ["o"], F.floor(F.col("o") / 100000))
    p = n.select("scene", "ordinal", F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("tz").alias("z"))
    s = C.trajectory_stats(p)
    return s.select("scene", "cameras", *[r6(c).alias(c) for c in ("centre_x", "centre_y", "centre_z", "extent", "mean_step")], r6("path_length", 4).alias("path_length"))
