"""Raster grids: header, cell numbering, tiles, and dense long form.

A raster in long form has raster_id, band, row, col, value, with NULL for nodata.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swathline.functions import constants as K

LINE = ["raster_id", "band"]
CELL = ["raster_id", "band", "row", "col"]


def finite(v: Column) -> Column:
    """True for a number that is neither NULL, NaN nor infinite."""
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def clean(raster: DataFrame, nodata: float | None = K.NODATA, value: str = "value") -> DataFrame:
    """Declared nodata and values that are not finite become NULL; every raster operator begins with this."""
    v = F.col(value).cast("double")
    good = finite(v) if nodata is None else finite(v) & (v != nodata)
    return raster.withColumn(value, F.when(good, F.col(value)))


@dataclass(frozen=True)
class Grid:
    """Axis-aligned grid; row = floor((y - y0) / dy), so ``dy`` is negative for north-up rasters."""

    raster_id: str
    width: int
    height: int
    x0: float
    y0: float
    dx: float
    dy: float
    epsg: int | None = None

    @property
    def transform(self) -> list[float]:
        return [self.x0, self.dx, 0.0, self.y0, 0.0, self.dy]

    def centre_x(self, col: Column) -> Column:
        return F.lit(self.x0) + (col + F.lit(0.5)) * F.lit(self.dx)

    def centre_y(self, row: Column) -> Column:
        return F.lit(self.y0) + (row + F.lit(0.5)) * F.lit(self.dy)

    def cells(self, spark: SparkSession) -> DataFrame:
        """Every cell of the grid, spread over the cluster."""
        return spark.range(self.width * self.height).select(
            F.floor(F.col("id") / self.width).cast("int").alias("row"),
            (F.col("id") % self.width).cast("int").alias("col"))

    def inside(self) -> Column:
        return F.col("row").between(0, self.height - 1) & F.col("col").between(0, self.width - 1)


def densify(raster: DataFrame, grid: Grid, bands: Sequence[str] | None = None) -> DataFrame:
    """Add the missing cells of one raster as nodata, for every band it has.

    Without ``bands`` the handful of band names is found first by a partial aggregate.
    """
    have = raster.select("band", "row", "col", "value")
    cells = grid.cells(raster.sparkSession)
    if bands:
        spread = cells.select(F.explode(F.array(*[F.lit(b) for b in bands])).alias("band"), "row", "col")
    else:
        listed = raster.agg(F.collect_set("band").alias("bands")).withColumn("_k", F.lit(0))
        spread = (cells.withColumn("_k", F.lit(0)).join(F.broadcast(listed), "_k")  # one row: the band names
                  .select(F.explode("bands").alias("band"), "row", "col"))
    return (spread.join(have, ["band", "row", "col"], "left")
            .select(F.lit(grid.raster_id).alias("raster_id"), "band", "row", "col", "value"))


def tile_of(tile: int = K.TILE) -> dict[str, Column]:
    return {"tr": F.floor(F.col("row") / tile).cast("int"), "tc": F.floor(F.col("col") / tile).cast("int")}


def raster_metadata(headers: DataFrame) -> DataFrame:
    """Bounds, pixel size and centre from the grid header (raster_id, width, height, gt, epsg)."""
    gt, w, h = F.col("gt"), F.col("width"), F.col("height")

    def corner(cx: Column | int, cy: Column | int) -> tuple[Column, Column]:
        return gt[0] + cx * gt[1] + cy * gt[2], gt[3] + cx * gt[4] + cy * gt[5]

    zero = F.lit(0)
    pts = [corner(zero, zero), corner(w, zero), corner(w, h), corner(zero, h)]
    return headers.withColumns({
        "xmin": F.least(*[p[0] for p in pts]), "xmax": F.greatest(*[p[0] for p in pts]),
        "ymin": F.least(*[p[1] for p in pts]), "ymax": F.greatest(*[p[1] for p in pts]),
        "pixel_x": F.abs(gt[1]), "pixel_y": F.abs(gt[5])})


def resolution_cm(gt: Column) -> Column:
    return F.round(F.abs(gt[1]) * 100, 4)
