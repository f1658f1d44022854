"""Placing images on the ground from their own position, height and heading."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathline.functions import constants as K
from swathline.functions.ranking import exact_quantiles
from swathline.functions.scalars import lookup, settle
from swathline.operators.geodesy import gps_to_utm, utm_to_gps
from swathline.operators.grid import LINE, Grid


def terrain_level(dsm: DataFrame) -> DataFrame:
    """Median elevation per raster."""
    return exact_quantiles(dsm, ["raster_id"], "value", {"terrain": 0.5})


def agl_hfov_yaw(captures: DataFrame, terrain: Column | float = 0.0) -> DataFrame:
    """Height above ground, horizontal field of view and heading, each from the best source present.

    Reads relative_altitude, absolute_altitude, exif_altitude, exif_altitude_ref, focal_px, focal_mm,
    plane_resolution, plane_unit, focal_35mm, drone_model, flight_yaw, gimbal_yaw, width; all but width
    may be NULL.
    """
    ground = terrain if isinstance(terrain, Column) else F.lit(float(terrain))
    exif = F.when(F.col("exif_altitude_ref") == 1, -F.col("exif_altitude")).otherwise(F.col("exif_altitude"))
    agl = F.coalesce(F.abs("relative_altitude"), F.abs("absolute_altitude") - ground, exif - ground)
    width = F.col("width").cast("double")

    def angle(ratio: Column) -> Column:
        return F.degrees(2.0 * F.atan(ratio))

    pitch = F.when(F.coalesce(F.col("plane_unit"), F.lit(2)) == 2, 25.4).otherwise(10.0) / F.col("plane_resolution")
    hfov = F.coalesce(
        F.when(F.col("focal_px") > 0, angle(width / (2.0 * F.col("focal_px")))),
        F.when((F.col("focal_mm") > 0) & (F.col("plane_resolution") > 0),
               angle(width * pitch / (2.0 * F.col("focal_mm")))),
        F.when(F.col("focal_35mm") > 0, angle(18.0 / F.col("focal_35mm"))),
        lookup(F.col("drone_model"), K.MODEL_HFOV_DEG), F.lit(K.DEFAULT_HFOV_DEG))
    return captures.withColumns({
        "agl_m": F.when(agl > 0, agl).otherwise(F.lit(K.DEFAULT_AGL_M)),
        "hfov_deg": hfov,
        "yaw_deg": F.coalesce("flight_yaw", "gimbal_yaw", F.lit(0.0))})


def direct_georef(captures: DataFrame) -> DataFrame:
    """Affine transform gt0 .. gt5 (pixel -> lon, lat) that puts the image centre on its GPS position."""
    df = captures.withColumns({
        "_gsd": 2.0 * F.col("agl_m") * F.tan(F.radians("hfov_deg") / 2.0) / F.col("width"),
        "_c": F.cos(F.radians("yaw_deg")), "_s": F.sin(F.radians("yaw_deg"))})
    df = df.withColumns({"_px": F.col("_gsd") / (K.METRES_PER_DEGREE * F.cos(F.radians("lat"))),
                         "_py": F.col("_gsd") / K.METRES_PER_DEGREE})
    df = df.withColumns({"gt1": F.col("_px") * F.col("_c"), "gt2": -F.col("_py") * F.col("_s"),
                         "gt4": F.col("_px") * F.col("_s"), "gt5": -F.col("_py") * F.col("_c")})
    hw, hh = F.col("width") / 2.0, F.col("height") / 2.0
    return df.withColumns({"gt0": F.col("lon") - hw * F.col("gt1") - hh * F.col("gt2"),
                           "gt3": F.col("lat") - hw * F.col("gt4") - hh * F.col("gt5")}).drop(
        "_gsd", "_c", "_s", "_px", "_py")


def footprint(headers: DataFrame) -> DataFrame:
    """Corner ring (closed, five points) and lon/lat box of images with gt0 .. gt5, width, height."""
    w, h = F.col("width"), F.col("height")
    corners = [(F.lit(0), F.lit(0)), (w, F.lit(0)), (w, h), (F.lit(0), h), (F.lit(0), F.lit(0))]
    ring = F.array(*[F.struct((F.col("gt0") + c * F.col("gt1") + r * F.col("gt2")).alias("x"),
                              (F.col("gt3") + c * F.col("gt4") + r * F.col("gt5")).alias("y")) for c, r in corners])
    df = headers.withColumn("ring", ring)
    return df.withColumns({
        "xmin": F.array_min(F.col("ring")["x"]), "xmax": F.array_max(F.col("ring")["x"]),
        "ymin": F.array_min(F.col("ring")["y"]), "ymax": F.array_max(F.col("ring")["y"])})


def warp_cells(images: DataFrame, grid: Grid) -> DataFrame:
    """For each image the target cells inside its footprint, with the source pixel of each.

    ``images`` has raster_id, width, height, gt0 .. gt5.  The footprint's box gives the candidate cells, so
    work follows the covered area.  ``grid.epsg`` None means the grid is in degrees.
    """
    corners = footprint(images).drop("ring", "xmin", "xmax", "ymin", "ymax")
    w, h = F.col("width"), F.col("height")
    pts = F.array(*[F.struct((F.col("gt0") + c * F.col("gt1") + r * F.col("gt2")).alias("lon"),
                             (F.col("gt3") + c * F.col("gt4") + r * F.col("gt5")).alias("lat"))
                    for c, r in [(F.lit(0), F.lit(0)), (w, F.lit(0)), (w, h), (F.lit(0), h)]])
    flat = corners.withColumn("_p", F.explode(pts)).withColumns({"lon": F.col("_p.lon"), "lat": F.col("_p.lat")})
    if grid.epsg is None:
        flat = flat.withColumns({"east": F.col("lon"), "north": F.col("lat")})
    else:
        flat = gps_to_utm(flat, grid.epsg)
    flat = flat.withColumns({"_c": (F.col("east") - grid.x0) / grid.dx, "_r": (F.col("north") - grid.y0) / grid.dy})
    keys = ["raster_id", "width", "height", "gt0", "gt1", "gt2", "gt3", "gt4", "gt5"]
    box = flat.groupBy(*keys).agg(*[f(c).alias(n) for n, f, c in [
        ("c0", F.min, "_c"), ("c1", F.max, "_c"), ("r0", F.min, "_r"), ("r1", F.max, "_r")]])
    # one cell of margin covers the curvature of a straight image edge in the other system
    lo_r, hi_r = F.greatest(F.floor("r0") - 1, F.lit(0)), F.least(F.ceil("r1") + 1, F.lit(grid.height - 1))
    lo_c, hi_c = F.greatest(F.floor("c0") - 1, F.lit(0)), F.least(F.ceil("c1") + 1, F.lit(grid.width - 1))
    inside = box.where((lo_r <= hi_r) & (lo_c <= hi_c))
    lines = inside.withColumn("row", F.explode(F.sequence(lo_r.cast("int"), hi_r.cast("int"))))
    # a few images open out into very many cells: deal the rows over all tasks before the cells are made
    parts = int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = lines.repartition(parts, "raster_id", "row").withColumn(
        "col", F.explode(F.sequence(lo_c.cast("int"), hi_c.cast("int"))))
    cells = cells.withColumns({"east": grid.centre_x(F.col("col")), "north": grid.centre_y(F.col("row"))})
    if grid.epsg is None:
        cells = cells.withColumns({"lon": F.col("east"), "lat": F.col("north")})
    else:
        cells = utm_to_gps(cells, grid.epsg)
    dx, dy = F.col("lon") - F.col("gt0"), F.col("lat") - F.col("gt3")
    det = F.col("gt1") * F.col("gt5") - F.col("gt2") * F.col("gt4")
    cells = cells.withColumns({
        "src_col": F.floor((dx * F.col("gt5") - dy * F.col("gt2")) / det).cast("int"),
        "src_row": F.floor((dy * F.col("gt1") - dx * F.col("gt4")) / det).cast("int")})
    cells = settle(cells, "src_row", "src_col")
    return cells.where((F.col("src_col") >= 0) & (F.col("src_col") < F.col("width"))
                       & (F.col("src_row") >= 0) & (F.col("src_row") < F.col("height"))).select(
        "raster_id", "row", "col", "src_row", "src_col")


def warp_nearest(raster: DataFrame, images: DataFrame, grid: Grid) -> DataFrame:
    """Source pixels on the target grid, nearest neighbour; nodata stays nodata."""
    source = raster.select(*LINE, F.col("row").alias("src_row"), F.col("col").alias("src_col"), "value")
    return warp_cells(images, grid).join(source, ["raster_id", "src_row", "src_col"]).select(
        *LINE, "row", "col", "value")


def footprint_overlap(boxes_a: DataFrame, boxes_b: DataFrame, cell: float) -> DataFrame:
    """Pairs (id_a, id_b) of boxes that overlap or touch.

    Both have id, xmin, ymin, xmax, ymax.  Boxes are spread over square cells of side ``cell`` and meet in
    the cell that holds the lower corner of their common area, so each pair comes out once.
    """

    def spread(df: DataFrame, tag: str) -> DataFrame:
        named = df.select(*[F.col(c).alias(f"{c}_{tag}") for c in ("id", "xmin", "ymin", "xmax", "ymax")])

        def span(lo: str, hi: str) -> Column:
            return F.explode(F.sequence(F.floor(F.col(f"{lo}_{tag}") / cell), F.floor(F.col(f"{hi}_{tag}") / cell)))

        return named.withColumn("gx", span("xmin", "xmax")).withColumn("gy", span("ymin", "ymax"))

    # a few files of boxes can make very many pairs: deal one side over all tasks before they meet
    parts = int(boxes_a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = spread(boxes_a.repartition(parts, "id"), "a").join(spread(boxes_b, "b"), ["gx", "gy"])
    x, y = F.greatest("xmin_a", "xmin_b"), F.greatest("ymin_a", "ymin_b")
    return met.where((x <= F.least("xmax_a", "xmax_b")) & (y <= F.least("ymax_a", "ymax_b"))
                     & (F.floor(x / cell) == F.col("gx")) & (F.floor(y / cell) == F.col("gy"))).select("id_a", "id_b")


def heading_groups(captures: DataFrame) -> DataFrame:
    """Two passes by heading (out: within 90 degrees of north), mean reflectance per pass and its CV."""
    turn = F.pmod(F.col("yaw_deg"), F.lit(360.0))
    tagged = captures.withColumn("heading", F.when((turn < 90) | (turn >= 270), "out").otherwise("back"))
    per = tagged.groupBy("flight", "heading").agg(
        F.count("*").alias("images"), F.avg("mean").alias("mean"), F.stddev_pop("mean").alias("std"))
    return per.withColumn("cv", F.col("std") / F.nullif(F.col("mean"), F.lit(0.0)))
