"""Hillshade, slope and edge filters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathline.operators.grid import LINE
from swathline.operators.neighbours import nearest_valid, stencil


def sobel_x() -> Column:
    return (F.col("ne") + 2 * F.col("e") + F.col("se")) - (F.col("nw") + 2 * F.col("w") + F.col("sw"))


def sobel_y() -> Column:
    return (F.col("sw") + 2 * F.col("s") + F.col("se")) - (F.col("nw") + 2 * F.col("n") + F.col("ne"))


def _completed(around: DataFrame) -> DataFrame:
    """Missing neighbours: carried on in a straight line through the centre; failing that a side takes the
    centre's value and a corner the plane through the centre and its two sides."""
    sides = {"n": "s", "s": "n", "w": "e", "e": "w"}
    df = around.withColumns({a: F.coalesce(F.col(a), 2 * F.col("c") - F.col(b), F.col("c")) for a, b in sides.items()})
    corners = {"nw": "se", "ne": "sw", "sw": "ne", "se": "nw"}
    return df.withColumns({
        a: F.coalesce(F.col(a), 2 * F.col("c") - F.col(b), F.col(a[0]) + F.col(a[1]) - F.col("c"))
        for a, b in corners.items()})


def hillshade(raster: DataFrame, res: float, azimuth: float = 315.0, altitude: float = 45.0,
              vert_exag: float = 1.0) -> DataFrame:
    """Dense elevations -> shade 1..255 with Horn's gradient; edges are computed, nodata is kept."""
    df = _completed(stencil(raster))
    az, alt = math.radians(azimuth), math.radians(altitude)
    k = vert_exag / (8.0 * res)
    x, y = -sobel_x() * k, sobel_y() * k
    cang = (F.lit(math.sin(alt)) - math.cos(alt) * (y * math.cos(az) - x * math.sin(az))) / F.sqrt(1 + x * x + y * y)
    shade = F.when(cang <= 0, 1.0).otherwise(1.0 + 254.0 * cang)
    return df.select(*LINE, "row", "col", F.when(F.col("value").isNotNull(), shade).alias("value"))


def hillshade_view(raster: DataFrame, res: float, azimuth: float = 315.0, altitude: float = 45.0,
                   vert_exag: float = 1.5) -> DataFrame:
    """Display shade 0..1: central differences on nearest-filled holes, stretched to the raster's range."""
    around = stencil(nearest_valid(raster, 2), keep=("was_hole",))
    az, alt = math.radians(90 - azimuth), math.radians(altitude)

    def slope(lo: str, hi: str) -> Column:
        lo_c, hi_c = F.col(lo), F.col(hi)
        step = F.when(lo_c.isNotNull() & hi_c.isNotNull(), 2.0).otherwise(1.0)
        return (F.coalesce(hi_c, F.col("c")) - F.coalesce(lo_c, F.col("c"))) / step * (vert_exag / res)

    gx, gy = slope("w", "e"), -slope("n", "s")
    light = (-gx * (math.cos(az) * math.cos(alt)) - gy * (math.sin(az) * math.cos(alt)) + math.sin(alt)) \
        / F.sqrt(gx * gx + gy * gy + 1)
    shaded = around.where(~F.col("was_hole")).select(*LINE, "row", "col", light.alias("light"))
    span = shaded.groupBy(*LINE).agg(F.min("light").alias("lo"), F.max("light").alias("hi"))
    scaled = F.when(F.col("hi") - F.col("lo") > 1e-6, (F.col("light") - F.col("lo")) / (F.col("hi") - F.col("lo"))
                    ).otherwise(F.col("light"))
    return shaded.join(span, LINE).select(
        *LINE, "row", "col", F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)).alias("value"))


def slope(raster: DataFrame, res: float) -> DataFrame:
    """Dense elevations -> slope in degrees; holes are nearest-filled for the gradient and masked again.

    Only holes beside a valid cell matter for a 3x3 gradient, so a search of two cells is exact.
    """
    around = stencil(nearest_valid(raster, 2), border="mirror", keep=("was_hole",))
    gx, gy = sobel_x() / (8 * res), sobel_y() / (8 * res)
    steep = F.degrees(F.atan(F.sqrt(gx * gx + gy * gy)))
    return around.where(~F.col("was_hole")).select(*LINE, "row", "col", steep.alias("value"))


def laplacian(raster: DataFrame) -> DataFrame:
    around = stencil(raster, border="mirror")
    lap = F.col("n") + F.col("s") + F.col("w") + F.col("e") - 4 * F.col("c")
    return around.select(*LINE, "row", "col", lap.alias("value"))


def sobel(raster: DataFrame) -> DataFrame:
    """Gradients and their size |gx| + |gy|."""
    around = stencil(raster, border="mirror")
    return around.select(*LINE, "row", "col", sobel_x().alias("gx"), sobel_y().alias("gy"),
                         (F.abs(sobel_x()) + F.abs(sobel_y())).alias("magnitude"))
